import random
import re

from ledgerline.llm import license_scan as s

from .helpers import awkward, clashing, documents

SCANNER = s.Scanner(s.signature_rules())


def labels(text):
    return {d["label"] for d in SCANNER.scan(text.encode())[1] if d["stays"]}


def test_hundreds_of_rules_each_with_its_keyword():
    rules = s.signature_rules()
    assert len(rules) > 400
    assert all(rule.keyword and b" " not in rule.keyword for rule in rules)


def test_notices_titles_tags_and_addresses():
    assert labels("Released under the MIT License.") == {"mit"}
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == {"gpl-2+"}
    assert labels("the GNU General Public License, version 3.") == {"gpl-3"}
    assert labels("GNU General Public License as published by the Free Software Foundation; either version 2 of the "
                  "License, or (at your option) any later version.") == {"gpl-2+"}
    assert labels("https://creativecommons.org/licenses/by-sa/4.0/") == {"cc-by-sa-4.0"}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"}
    assert labels("see http://www.apache.org/licenses/LICENSE-2.0") == {"apache-2"}
    assert labels("nothing of the kind, mitigating licences") == set()


def test_the_prefilter_changes_nothing():
    # A text that quotes every plain title, scanned with and without the keywords.
    text = " ".join(f[2].replace("(the )?", "") for f in s.FAMILIES if f[2] and "(" not in f[2].replace("(the )?", ""))
    free = s.Scanner([s.Rule(r.label, b" ", r.priority, r.base, r.pattern) for r in s.signature_rules()])
    assert SCANNER.scan(text.encode()) == free.scan(text.encode())


def strings(tree):
    """The strings that a parsed pattern matches; what repeats stands once, any character is a NUL."""
    out = [""]
    for op, of in tree:
        match str(op):
            case "LITERAL":
                found = [chr(of)]
            case "NOT_LITERAL":
                found = ["\0"]
            case "IN":
                found = [chr(c) for _, c in of]
            case "SUBPATTERN":
                found = strings(of[3])
            case "BRANCH":
                found = [x for part in of[1] for x in strings(part)]
            case "MAX_REPEAT":
                found = [""] * (of[0] == 0) + strings(of[2])
            case "ASSERT":
                found = [""]
        out = [a + b for a in out for b in found]
    return out


def test_every_match_of_a_rule_has_its_keyword():
    for rule in s.signature_rules():
        found = strings(re._parser.parse(rule.pattern.pattern.decode()))
        assert found and all(rule.keyword.decode() in x for x in found), (rule.label, rule.keyword)
        text = f"x {found[0].replace(chr(0), 'y')} x"
        assert any(d["label"] == rule.label for d in SCANNER.scan(text.encode())[1]), text


def test_texts_without_the_short_name():
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files") == {"mit"}
    assert labels("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                  "is hereby granted") == {"isc"}
    assert labels("Except as contained in this notice, the name of the X Consortium shall not be used") == {"x11"}
    assert labels("Common Development and Distribution License 1.0") == {"cddl-1.0"}
    assert labels("under the Do What The Fxck You Want To Public License") == {"wtfpl"}
    assert labels("the Berkeley Software Distribution License") == {"bsd"}


def test_containment_goes_by_priority():
    low, high = (s.Rule(n, b"x", p, False, re.compile(b"x")) for n, p in (("low", 10), ("high", 90)))
    kept = {(a, b, r.label): stays for a, b, r, stays in s.resolve([(0, 10, low), (2, 5, high), (3, 4, low), (9, 12, low)])}
    assert kept == {(0, 10, "low"): True, (2, 5, "high"): True, (3, 4, "low"): False, (9, 12, "low"): True}


def brute_force(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places, found = [], set()
    for phrase, label in s.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                found.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)))


def test_base_columns_match_brute_force(spark):
    rng = random.Random(1)
    parts = ["MIT", "License", "Apache", "license", "Version", "2", "cc", "BY", "-nc", "é", "K", ",", "\n", "x", "2.0", "mitlicense"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(200)]
    docs = documents(spark, rows).union(awkward(spark))
    got = s.summarise(s.scan_licenses(clashing(docs))).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((i, *brute_force(t)) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    assert s.scan_licenses(docs.limit(0)).collect() == []


def test_only_the_whole_base_phrase_counts(spark):
    docs = documents(spark, [(1, "The MIT License"), (2, "Use it under the MIT-License, under the mit license."),
                             (3, "under the MITs license")])
    got = {r.doc_id: tuple(r) for r in s.summarise(s.scan_licenses(docs)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()}
    assert got[1] == (1, 3, 0, None, None, "", "mit")
    assert got[2] == (2, 10, 2, 2, 6, "mit", "mit")
    assert got[3] == (3, 4, 0, None, None, "", "")


def test_resolving_matches_brute_force():
    rng = random.Random(8)
    rules = [s.Rule(f"l{i % 3}", b"x", p, False, re.compile(b"x")) for i, p in enumerate((10, 40, 40, 90, 90, 70))]
    for _ in range(200):
        found = [(a, a + rng.randrange(1, 12), rng.choice(rules)) for a in (rng.randrange(30) for _ in range(rng.randrange(40)))]
        found = list(dict.fromkeys(found))
        stays, want = [], []
        for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
            inside = any(a <= start and end <= b for a, b in stays)
            if not inside:
                stays.append((start, end))
            want.append((start, end, rule.priority, rule.label, not inside))
        # Of equal places, priorities and labels one stays; which of them makes no difference.
        got = [(a, b, r.priority, r.label, kept) for a, b, r, kept in s.resolve(found)]
        assert sorted(got) == sorted(want)


def test_time_is_linear_in_the_detections():
    import time

    for line in (b"mit license ", b"licensed under the apache license version 2 0 or the mit license\n"):
        text = line * (1_000_000 // len(line))
        began = time.process_time()
        n, found = SCANNER.scan(text)
        assert len(found) > 15_000 and found[-1]["end"] == n
        assert time.process_time() - began < 20
