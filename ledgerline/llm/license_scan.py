"""License detection by ordered signature rules over whole texts.

A text is reduced to its words: ASCII letters lowered, words are runs of ASCII letters and
digits and of all characters beyond ASCII, joined by one blank. Rules are
regular expressions over that form, which begin and end at word boundaries.
Every rule names a keyword that all its matches contain; a rule runs only on
texts that have its keyword.

Overlapping detections are resolved by priority and containment: in order of
priority, then length, then place, a detection stays unless it lies within one
that stays already (so "cc by" within "cc by nc", and the title within the
notice that quotes it, go). The base phrases are rules like the others, but
their places count whether or not a longer rule covers them, and their labels
always stay.

The score is the priority of the strongest detection that stays, as a share of
100; 0 without any.

Defined results: a null or empty text has no words, no detections and score 0.
Repeated rows are scanned each. An empty table gives no rows. Each row is
handled on its own, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_of

# Phrases that always count, with their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Fixed values, one family a line: label, keyword, title, short name, address, notice ('' where there is none).
# Titles, short names, addresses and notices are regular expressions over words; the keyword stands in every match of
# the title and of the notice.
FAMILIES = [
    ("mit", "mit", r"(the )?mit license", r"mit", r"opensource org licenses mit( license)?", r""),
    ("mit", "granted", r"", r"", r"",
     r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "expat", r"expat license", r"expat", r"", r""),
    ("mit-0", "attribution", r"mit no attribution( license)?", r"mit 0", r"", r""),
    ("x11", "x11", r"x11 license", r"x11", r"", r""),
    ("x11", "consortium", r"", r"", r"", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("isc", "isc", r"isc license", r"isc", r"opensource org licenses isc( license)?", r""),
    ("isc", "permission", r"", r"", r"",
     r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2-clause", "bsd", r"(simplified bsd license|bsd 2 clause( license)?|2 clause bsd license|freebsd license)", r"bsd 2 clause",
     r"opensource org licenses bsd 2 clause", r""),
    ("bsd-3-clause", "bsd", r"(new bsd license|modified bsd license|revised bsd license|bsd 3 clause( license)?|3 clause bsd license)", r"bsd 3 clause",
     r"opensource org licenses bsd 3 clause", r""),
    ("bsd-3-clause", "neither", r"", r"", r"",
     r"neither the name of ([^ ]+ ){1,12}nor the names of (its|their) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "bsd", r"(original bsd license|bsd 4 clause( license)?|4 clause bsd license)", r"bsd 4 clause", r"", r""),
    ("bsd", "redistribution", r"", r"", r"",
     r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "bsd", r"(bsd style license|bsd license)", r"", r"", r""),
    ("bsd", "berkeley", r"berkeley software distribution license", r"", r"", r""),
    ("apache-1.1", "apache", r"apache (software )?license (version |v )?1 1", r"apache 1 1", r"apache org licenses license 1 1", r""),
    ("apache-2", "apache", r"apache (software )?license (version |v )?2( 0)?", r"apache 2( 0)?", r"apache org licenses license 2 0",
     r"licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache", "apache", r"apache (software )?license", r"", r"apache org licenses", r""),
    ("mpl-1.1", "mozilla", r"mozilla public license (version |v )?1 1", r"mpl 1 1", r"mozilla org mpl 1 1", r""),
    ("mpl-2.0", "mozilla", r"mozilla public license (version |v )?2( 0)?", r"mpl 2 0", r"mozilla org mpl 2 0",
     r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public license (version |v )?1( 0)?", r"epl 1 0", r"eclipse org legal epl v10", r""),
    ("epl-2.0", "eclipse", r"eclipse public license (version |v )?2( 0)?", r"epl 2 0", r"eclipse org legal epl (2 0|v20)", r""),
    ("edl-1.0", "eclipse", r"eclipse distribution license (version |v )?1( 0)?", r"edl 1 0", r"eclipse org org documents edl v10", r""),
    ("cddl-1.0", "cddl", r"cddl (version |v )?1( 0)?", r"cddl 1 0", r"", r""),
    ("cddl-1.0", "distribution", r"common development and distribution license (version |v )?1( 0)?", r"", r"", r""),
    ("cpl-1.0", "common", r"common public license (version |v )?1( 0)?", r"cpl 1 0", r"", r""),
    ("ms-pl", "microsoft", r"microsoft public license", r"ms pl", r"", r""),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", r"ms rl", r"", r""),
    ("artistic-1.0", "artistic", r"artistic license (version |v )?1( 0)?", r"artistic 1 0", r"", r""),
    ("artistic-2.0", "artistic", r"artistic license (version |v )?2( 0)?", r"artistic 2 0", r"", r""),
    ("zlib", "zlib", r"zlib( libpng)? license", r"zlib", r"zlib net zlib license", r""),
    ("zlib", "misrepresented", r"", r"", r"", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1.0", "boost", r"boost software license( (version |v )?1( 0)?)?", r"bsl 1 0", r"boost org license 1 0 txt", r""),
    ("busl-1.1", "business", r"business source license (version |v )?1 1", r"busl 1 1", r"", r""),
    ("wtfpl", "wtfpl", r"wtfpl( license)?", r"wtfpl", r"wtfpl net", r""),
    ("wtfpl", "public", r"do what the f[^ ]+ you want to public license", r"", r"", r""),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense", r"unlicense org", r""),
    ("unlicense", "unencumbered", r"", r"", r"", r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "cc0", r"(creative commons )?cc0( 1 0)?( universal)?", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0", r""),
    ("public-domain", "domain", r"(dedicated to|released into|placed in|in) the public domain", r"", r"creativecommons org publicdomain mark 1 0", r""),
    ("ofl-1.1", "sil", r"sil open font license( (version |v )?1 1)?", r"ofl 1 1", r"scripts sil org ofl", r""),
    ("odbl-1.0", "open", r"open (data commons open )?database license( (version |v )?1 0)?", r"odbl 1 0", r"opendatacommons org licenses odbl", r""),
    ("odc-by-1.0", "open", r"open data commons attribution license( (version |v )?1 0)?", r"odc by 1 0", r"opendatacommons org licenses by", r""),
    ("pddl-1.0", "public", r"public domain dedication and license( (version |v )?1 0)?", r"pddl 1 0", r"opendatacommons org licenses pddl", r""),
    ("eupl-1.2", "european", r"european union public licen[cs]e (version |v )?1 2", r"eupl 1 2", r"joinup ec europa eu [^ ]+ eupl", r""),
    ("eupl-1.1", "european", r"european union public licen[cs]e (version |v )?1 1", r"eupl 1 1", r"", r""),
    ("afl-3.0", "academic", r"academic free license (version |v )?3( 0)?", r"afl 3 0", r"", r""),
    ("osl-3.0", "open", r"open software license (version |v )?3( 0)?", r"osl 3 0", r"", r""),
    ("psf-2.0", "python", r"python software foundation license (version |v )?2", r"psf 2 0", r"", r""),
    ("ruby", "ruby", r"ruby license", r"", r"", r""),
    ("perl", "perl", r"(same terms as perl itself|perl license)", r"", r"", r""),
    ("php-3.01", "php", r"php license (version |v )?3 01", r"php 3 01", r"php net license 3 01", r""),
    ("openssl", "openssl", r"openssl license", r"openssl", r"", r""),
    ("ncsa", "ncsa", r"university of illinois ncsa open source license", r"ncsa", r"", r""),
    ("postgresql", "postgresql", r"postgresql license", r"postgresql", r"", r""),
    ("vim", "vim", r"vim license", r"vim", r"", r""),
    ("json", "evil", r"", r"", r"", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"beer ?ware license", r"beerware", r"", r""),
    ("upl-1.0", "universal", r"universal permissive license( (version |v )?1 0)?", r"upl 1 0", r"", r""),
    ("bluoak-1.0.0", "blue", r"blue oak model license( 1 0 0)?", r"blueoak 1 0 0", r"blueoakcouncil org license 1 0 0", r""),
    ("sspl-1.0", "server", r"server side public license( (version |v )?1)?", r"sspl 1 0", r"", r""),
    ("elastic-2.0", "elastic", r"elastic license (version |v )?2( 0)?", r"elastic 2 0", r"elastic co licensing elastic license", r""),
    ("commons-clause", "commons", r"commons clause( license condition)?( v 1 0| v1 0)?", r"", r"commonsclause com", r""),
    ("proprietary", "reserved", r"", r"", r"", r"all rights reserved"),
    ("proprietary", "confidential", r"(proprietary and confidential|confidential and proprietary)", r"", r"", r""),
]

# Versions of the GNU licenses and the kinds of Creative Commons licenses: their families follow by rule.
GNU = [
    ("gpl", "general", r"(gnu )?general public license", ("1", "2", "3")),
    ("lgpl", "general", r"(gnu )?(lesser|library) general public license", ("2", "2 1", "3")),
    ("agpl", "affero", r"(gnu )?affero general public license", ("1", "3")),
    ("gfdl", "documentation", r"(gnu )?free documentation license", ("1 1", "1 2", "1 3")),
]
CREATIVE_COMMONS = [
    ("cc-by", "by", r"attribution"),
    ("cc-by-sa", "by sa", r"attribution share ?alike"),
    ("cc-by-nd", "by nd", r"attribution no ?deriv(ative|s|atives)"),
    ("cc-by-nc", "by nc", r"attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", r"attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", r"attribution non ?commercial no ?deriv(ative|s|atives)"),
]
CREATIVE_COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Kinds of rules, by priority.
BASE, NOTICE, TAG, ADDRESS, GRANT, TITLE, SHORT = 45, 95, 90, 75, 70, 55, 40
GRANTED = (r"(licensed|released|distributed|available|provided|published|covered|redistributed|shared) "
           r"(only )?under (the )?(terms of )?(the )?(conditions of the )?")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    priority: int
    base: bool
    pattern: re.Pattern


def _rule(label: str, keyword: str, priority: int, pattern: str, base: bool = False) -> Rule:
    return Rule(label, keyword.encode(), priority, base, re.compile(rf"(?<= )(?:{pattern})(?= )".encode()))


def _family(label: str, keyword: str, title: str, short: str, address: str, notice: str) -> list[Rule]:
    rules = []
    if notice:
        rules.append(_rule(label, keyword, NOTICE, notice))
    if short:
        rules.append(_rule(label, "spdx", TAG, rf"spdx license identifier {short}"))
        rules.append(_rule(label, "license", SHORT, rf"({short} licensed|license {short}|license under {short})"))
    if address:
        rules.append(_rule(label, address.split()[0] if address[0].isalpha() else keyword, ADDRESS,
                           rf"(https? )?(www )?{address}"))
    if title:
        rules.append(_rule(label, keyword, GRANT, GRANTED + title))
        rules.append(_rule(label, keyword, TITLE, title))
    return rules


def signature_rules() -> list[Rule]:
    """All rules, in order: base phrases, families, GNU versions, Creative Commons kinds and versions."""
    rules = [_rule(label, label.split("-")[0], BASE, phrase, True) for phrase, label in BASE_PHRASES]
    for family in FAMILIES:
        rules += _family(*family)
    for label, keyword, title, versions in GNU:
        for v in versions:
            number, short = v.replace(" ", "."), f"{label} {v}( 0)?"
            at = rf"{title} (as published by the free software foundation )?((either )?version |v )?{v}( 0)?"
            later = r"( of the license)?( or( at your option)? any later version| or later)"
            rules += _family(f"{label}-{number}", keyword, at, f"{short}( only)?", "", "")
            rules += _family(f"{label}-{number}+", keyword, at + later, f"{short} or later", "", "")
            rules.append(_rule(f"{label}-{number}", label, TITLE, rf"{label} ?v?{v}"))
        rules.append(_rule(label, keyword, SHORT, title))
    for label, short, title in CREATIVE_COMMONS:
        for v in CREATIVE_COMMONS_VERSIONS:
            rules += _family(f"{label}-{v.replace(' ', '.')}", "commons",
                             rf"creative commons {title} {v}( international| unported)?( (public )?license)?", f"cc {short} {v}",
                             f"creativecommons org licenses {short} {v}", "")
            rules.append(_rule(f"{label}-{v.replace(' ', '.')}", "cc", TITLE, f"cc {short} {v}"))
        rules.append(_rule(label, "cc", SHORT, f"cc {short}"))
        rules.append(_rule(label, "commons", SHORT, rf"creative commons {title}"))
    return rules


# Letters are lowered, digits and bytes beyond ASCII stay, the rest becomes a blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule, bool]]:
    """Detections (start, end, rule) in order of place, with whether each stays.

    A detection goes if one with a higher priority, or a longer one or an equal
    one of an earlier label with the same priority, contains it. Containment is
    transitive, so whether that one stays itself doesn't matter, and a sweep by
    start with the largest end so far finds it: once per priority for its own
    detections and once against all higher ones.
    """
    order = sorted(range(len(found)), key=lambda i: (found[i][0], -found[i][1], found[i][2].label))
    start = np.array([found[i][0] for i in order], np.int64)
    end = np.array([found[i][1] for i in order], np.int64)
    priority = np.array([found[i][2].priority for i in order], np.int64)
    stays = np.zeros(len(order), bool)
    for level in np.unique(priority):
        own = np.flatnonzero(priority == level)
        before = np.concatenate([[-1], np.maximum.accumulate(end[own])[:-1]])
        higher = np.flatnonzero(priority > level)
        if len(higher):
            reach = np.concatenate([[-1], np.maximum.accumulate(end[higher])])
            before = np.maximum(before, reach[np.searchsorted(start[higher], start[own], "right")])
        stays[own] = before < end[own]
    out = [(*found[i], bool(kept)) for i, kept in zip(order, stays, strict=True)]
    return sorted(out, key=lambda d: (d[0], d[1], -d[2].priority, d[2].label))


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.by_keyword: dict[bytes, list[Rule]] = {}
        for rule in rules:
            self.by_keyword.setdefault(rule.keyword, []).append(rule)

    def scan(self, raw: bytes) -> tuple[int, list[dict]]:
        """The number of words, and the detections with their words' places (end exclusive)."""
        words = raw.translate(_WORD_BYTES).split()
        text = b" " + b" ".join(words) + b" "
        found = [(m.start(), m.end(), rule) for keyword, rules in self.by_keyword.items() if keyword in text
                 for rule in rules for m in rule.pattern.finditer(text)]
        # Places in words: blanks before a place in the text.
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        resolved = resolve(found)
        first = np.searchsorted(blanks, [d[0] for d in resolved]) - 1
        last = np.searchsorted(blanks, [d[1] for d in resolved])
        return len(words), [
            {"label": rule.label, "priority": rule.priority, "base": rule.base, "stays": stays,
             "start": int(a), "end": int(b), "matched": text[start:end].decode("utf-8", "replace")}
            for (start, end, rule, stays), a, b in zip(resolved, first, last, strict=True)]


DETECTION = "struct<label:string,priority:int,base:boolean,stays:boolean,start:long,end:long,matched:string>"


def _scan(batches):
    import pyarrow as pa

    scanner = Scanner(signature_rules())
    kind = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("base", pa.bool_()),
                               ("stays", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()),
                               ("matched", pa.string())]))
    for batch in batches:
        scans = [scanner.scan(raw) for raw in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([n for n, _ in scans], pa.int64()),
             pa.array([found for _, found in scans], kind)], names=["doc_id", "n_words", "detections"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, and detections in order of place."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("raw"))
    return rows.mapInArrow(_scan, f"doc_id long, n_words long, detections array<{DETECTION}>")


def summarise(scans: DataFrame) -> DataFrame:
    """Counts, places, labels and score of each document's detections."""
    base = F.expr("filter(detections, d -> d.base)")
    stays = F.expr("filter(detections, d -> d.stays)")
    rows = scans.withColumns({"b": base, "s": stays})
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(found)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"),
        F.array_min("b.start").alias("first_word"), F.array_max("b.start").alias("last_word"),
        joined(F.col("b.label")).alias("base_labels"),
        joined(F.concat("b.label", "s.label")).alias("labels"),
        F.coalesce(F.array_max("s.priority") / F.lit(100.0), F.lit(0.0)).alias("score"))
