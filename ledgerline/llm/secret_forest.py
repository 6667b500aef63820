"""Secret detection: broad candidates, then a random forest that removes the false positives.

Candidates, anywhere in a text, are

* runs of at least ``LEAST_LENGTH`` characters of ``[A-Za-z0-9+/_-]`` with a digit or with capitals among small letters;
* such runs without either, if their letters cost ``UNLIKELY`` or more under the corpus's character model;
* what has a known key format, or a prefix like name_pat_ or name_live_;
* the password in an address (``://user:password@``), and a private key block as a whole, in place of its lines;
* what is assigned to a name like password, of any length and with any signs (to the closing quote, or to white space).

Spans that two of these give count once. The features of a candidate are its length and make-up, how often
its characters change class, the mean cost of its letters' transitions under a
character model of the corpus, the share of it that dictionary words cover, the
path (source) that the text comes from, and the words and signs around it. A
random forest (Spark's) over these features gives the probability that the candidate is a
secret.

The forest is fitted on labelled findings, at most ``LABELLED_ROWS`` of them
(those with the smallest hashes), the bounded sample that a classifier may use. Where no
table of labels is given, ``label_findings`` labels the sure cases by rule: known
key formats and values assigned to a name like api_key are secrets; card-like
numbers, parts of addresses, checksums called so and readable compounds are
not; all others stay open, and only the forest decides on them. Words and transitions
are counted over all documents. The dictionary has every word of 4 to
``LONGEST_WORD`` letters that stands in ``DICTIONARY_SHARE`` of the documents at
least, copies included: no word is pushed out by others,
and as a document has a limited number of words, their number is at most the mean
number of words of a document divided by that share.

Defined results: null and empty texts have no findings. Without labelled findings
of both kinds no forest can be fitted: the score is the share of secrets among
the labelled ones (0 without any). Repeated rows give their findings each. An
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_of, written
from ledgerline.llm.language_spans import CELLS, _cells, _codes, held_out
from ledgerline.llm.toxicity_decode import SMOOTHING, CharacterModel

LEAST_LENGTH = 12
LABELLED_ROWS = 20_000
DICTIONARY_SHARE = 1 / 2000
LEAST_WORD, LONGEST_WORD = 4, 32
# Mean cost of a letter, in nats, from which a run is no word of the corpus: three quarters of what a letter costs under a
# model that knows nothing but the alphabet.
UNLIKELY = 0.75 * math.log(26)
TREES, DEPTH, SEED = 40, 8, 11
KEEP_FROM = 0.5

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{%d,}" % LEAST_LENGTH)
_DIGIT = re.compile(r"[0-9]")
_SMALL, _CAPITAL_WITHIN = re.compile(r"[a-z]"), re.compile(r"[A-Za-z][A-Z]")
_NAME = re.compile(r"([\w\-]+)\W*$")
_NEXT = re.compile(r"\W*([\w\-]+)")
_LETTERS = re.compile(r"[a-z]+")
_MARKS = ".,;:!?\"'()"

# Names that secrets are given to, names of harmless values, and path words of samples.
SECRET_NAMES = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "credential", "bearer", "access", "private")
HARMLESS_NAMES = ("sha", "sha1", "sha256", "md5", "checksum", "commit", "hash", "uuid", "guid", "digest", "etag", "isbn",
                  "card", "phone", "iban", "id", "version", "build")
SAMPLE_PATHS = ("test", "example", "sample", "doc", "mock", "fixture", "demo")
# Formats of well-known keys.
KEY_FORMATS = re.compile(
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}"
    r"|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_\-]{20}|npm_[A-Za-z0-9]{36}|SK[0-9a-f]{32}")

_PREFIXED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2,12}_(?:pat|key|live|test|prod|secret|token|tok|sk|pk)_[A-Za-z0-9_\-]{8,}")
_CREDENTIAL = re.compile(r"://[^\s/:@\"'<>]{0,256}:([^\s/@\"'<>]{1,256})@")
_BLOCK_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")

# A name, what assigns, and the opening quote; the value begins where the match ends.
_ASSIGNED = re.compile(rf"(?:{'|'.join(SECRET_NAMES)})[\w\-]{{0,64}}[\"'`\])]{{0,2}}\s{{0,8}}(?::=|=>|={{1,3}}|:)\s{{0,8}}"
                       r"(?:(?:bearer|basic|token)\s{1,8})?([\"'`]?)", re.IGNORECASE)
_UNTIL_QUOTE = {quote: re.compile(rf"[^{quote}\r\n]+(?={quote})") for quote in "\"'`"}
_UNTIL_BLANK = re.compile(r"(?:(?!&\w+=)[^\s\"'`])+")

FEATURES = ["length", "digits", "uppers", "lowers", "signs", "entropy", "changes", "hex", "transition", "coverage",
            "path_depth", "path_sample", "path_bucket", "quoted", "assigned", "address", "name_secret", "name_harmless",
            "name_bucket", "next_bucket", "words_before"]


def _bucket(word: str, buckets: int = 16) -> float:
    import zlib

    return float(zlib.crc32(word.encode()) % buckets + 1) if word else 0.0


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def coverage(text: str, dictionary: frozenset[str], longest: int) -> float:
    """Largest share of the text that dictionary words can cover without overlap."""
    best = [0] * (len(text) + 1)
    longest = min(longest, LONGEST_WORD)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1]
        for size in range(LEAST_WORD, min(longest, end) + 1):
            if text[end - size:end] in dictionary:
                best[end] = max(best[end], best[end - size] + size)
    return best[-1] / len(text)


def _key_blocks(text: str) -> list[tuple[int, int]]:
    """Private key blocks: each begins at the last beginning before an end."""
    begins = [m.start() for m in _BLOCK_BEGIN.finditer(text)] if "PRIVATE KEY" in text else []
    blocks, after = [], 0
    for m in _BLOCK_END.finditer(text) if begins else ():
        at = bisect_right(begins, m.start()) - 1
        if at >= 0 and begins[at] >= after:
            blocks.append((begins[at], m.end()))
            after = m.end()
    return blocks


def spans(text: str, unlikely: Callable[[str], bool] = lambda run: False) -> list[tuple[int, int]]:
    """Where the candidates of a text are, in order of place; ``unlikely`` decides on plain runs of letters."""
    found = set()
    for m in _CANDIDATE.finditer(text):
        if _DIGIT.search(m[0]) or _SMALL.search(m[0]) and _CAPITAL_WITHIN.search(m[0]) or unlikely(m[0]):
            found.add(m.span())
    runs = sorted(found)
    for known in (KEY_FORMATS, _PREFIXED):
        for m in known.finditer(text):  # in a run that is a candidate it isn't one of its own
            at = bisect_right(runs, (m.start(), len(text))) - 1
            if at < 0 or runs[at][1] < m.end():
                found.add(m.span())
    for m in _ASSIGNED.finditer(text):
        quoted = m[1] and _UNTIL_QUOTE[m[1]].match(text, m.end())
        if quoted:
            found.add(quoted.span())
        elif plain := _UNTIL_BLANK.match(text, m.end()):
            if value := plain[0].rstrip(",;.)]}>"):
                found.add((plain.start(), plain.start() + len(value)))
    if "://" in text:
        found.update(m.span(1) for m in _CREDENTIAL.finditer(text))
    if blocks := _key_blocks(text):
        starts = [start for start, _ in blocks]
        within = lambda span: (i := bisect_right(starts, span[0]) - 1) >= 0 and span[1] <= blocks[i][1]
        found = {span for span in found if not within(span)} | set(blocks)
    return sorted(found)


def plain_runs(text: str) -> list[str]:
    """Runs of candidate length without digits or capitals among small letters."""
    return [m[0] for m in _CANDIDATE.finditer(text)
            if not (_DIGIT.search(m[0]) or _SMALL.search(m[0]) and _CAPITAL_WITHIN.search(m[0]))]


def unlikely_runs(runs: list[str], model: CharacterModel) -> set[str]:
    """Those of the runs whose letters cost more than ``UNLIKELY`` in the mean, all at once."""
    words, owner = [], []
    for i, run in enumerate(runs):
        for word in _LETTERS.findall(run.lower()):
            words.append(word)
            owner.append(i)
    if not words:
        return set()
    triple, context, word = _cells(*_codes(words))
    at = np.array(owner)[word]

    def others(cells: np.ndarray, logs: np.ndarray, least: float) -> np.ndarray:
        """Logarithms of the corpus's counts without those of the run itself."""
        _, place, own = np.unique(at * CELLS + cells, return_inverse=True, return_counts=True)
        return np.log(np.maximum(np.exp(logs[cells]) - own[place], least))

    cost = others(context, model.contexts, 40 * SMOOTHING) - others(triple, model.triples, SMOOTHING)
    total, letters = np.bincount(at, cost, len(runs)), np.bincount(at, minlength=len(runs))
    return {run for run, high in zip(runs, total > UNLIKELY * letters, strict=True) if high}


def candidate_features(text: str, start: int, end: int, path: str, model: CharacterModel,
                       dictionary: frozenset[str], longest: int) -> list[float]:
    value, n = text[start:end], end - start
    lower = value.lower()
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    costs = [model.cost(run[i], run[i + 1], run[i + 2]) for run in (f"\0{r}\0" for r in _LETTERS.findall(lower))
             for i in range(len(run) - 2)]
    before, after = text[max(0, start - 80):start], text[end:end + 40]
    name = (m[1].lower() if (m := _NAME.search(before)) else "")
    following = (m[1].lower() if (m := _NEXT.match(after)) else "")
    parts = [p for p in re.split(r"[/\\.]+", path.lower()) if p]
    return [
        float(n), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(all(c in "0123456789abcdef" for c in lower)),
        sum(costs) / len(costs) if costs else 0.0, coverage(lower, dictionary, longest),
        float(len(parts)), float(any(w in path.lower() for w in SAMPLE_PATHS)), _bucket(path),
        float(before[-1:] in "\"'`" and before != ""), float(bool(re.search(r"[=:]\s*[\"'`]?$", before))),
        float("@" in before[-1:] + after[:1] or (after[:1] == "." and after[1:2].isalnum())),
        float(any(w in name for w in SECRET_NAMES)), float(any(w == name for w in HARMLESS_NAMES)),
        _bucket(name), _bucket(following), float(len(before.split()))]


def _word_counter(batches):
    import pyarrow as pa

    for batch in batches:
        counts: Counter = Counter()
        documents: Counter = Counter()
        for text in batch.column("text").to_pylist():
            tokens = text.lower().split()
            counts.update(tokens)
            documents.update({token.strip(_MARKS) for token in set(tokens)})
        words: Counter = Counter()
        for token, n in counts.items():
            if (word := token.strip(_MARKS)).isalpha():
                words[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()),
                                          pa.array([documents[w] for w in words], pa.int64())],
                                         names=["word", "n", "documents"])


def _cell_counter(batches):
    import pyarrow as pa

    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        triple, context, owner = _cells(*_codes(words))
        weight = batch.column("n").to_numpy().astype(np.float64)[owner]
        for kind, cells in enumerate((triple, context)):
            n = np.bincount(cells, weight, CELLS).astype(np.int64)
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cell), kind), pa.int32()), pa.array(cell, pa.int32()), pa.array(n[cell])],
                names=["kind", "cell", "n"])


def corpus_models(docs: DataFrame) -> tuple[CharacterModel, frozenset[str]]:
    """Character transitions over the words of all documents, and the words that many documents have."""
    texts = docs.select(text_of(docs).alias("text"))
    words = texts.mapInArrow(_word_counter, "word string, n long, documents long")
    words = written(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "secret-words")
    counts = words.mapInArrow(_cell_counter, "kind int, cell int, n long").groupBy("kind", "cell")
    model = CharacterModel.of(counts.agg(F.sum("n").alias("n")).collect())  # 2 * CELLS rows at most
    least = max(1, math.ceil(DICTIONARY_SHARE * docs.count()))
    # Bounded: a document has so many words, and each of these stands in a share of all documents.
    common = words.where(F.length("word").between(LEAST_WORD, LONGEST_WORD) & (F.col("documents") >= least))
    return model, frozenset(r["word"] for r in common.select("word").collect())


def _finder(shared, batches):
    import pyarrow as pa

    model, dictionary = shared.value
    longest = max(map(len, dictionary), default=0)
    for batch in batches:
        rows: list[tuple] = []
        texts = batch.column("text").to_pylist()
        unlikely = unlikely_runs(sorted({run for text in texts for run in plain_runs(text)}), model)
        for doc_id, text, path in zip(batch.column("doc_id").to_pylist(), texts, batch.column("path").to_pylist(), strict=True):
            for start, end in spans(text, unlikely.__contains__):
                rows.append((doc_id, start, end, text[start:end], text[max(0, start - 80):start], text[end:end + 40],
                             candidate_features(text, start, end, path, model, dictionary, longest)))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["doc_id", "start", "end", "value", "before", "after", "features"])


def find_candidates(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """One row per candidate: doc_id, start, end, value, before, after (what stands around it), features."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_models(docs))
    where = F.lit("") if path is None else F.coalesce(path.cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), where.alias("path"))
    return rows.mapInArrow(partial(_finder, shared), "doc_id long, start long, end long, value string, before string, "
                           "after string, features array<double>")


def label_findings(found: DataFrame) -> Column:
    """1 for sure secrets, 0 for sure others, null for the rest."""
    value, before, after = found["value"], found["before"], found["after"]
    feature = lambda name: F.element_at(found["features"], FEATURES.index(name) + 1)
    mixed = (feature("digits") > 0) & (feature("digits") < 1)
    named = F.lower(before).rlike(rf"({'|'.join(SECRET_NAMES)})[\w\-]*\s*[=:]\s*[\"'`]?$")
    harmless = F.lower(before).rlike(rf"\b({'|'.join(HARMLESS_NAMES)})\W{{0,3}}$")
    return (F.when(value.rlike(rf"^({KEY_FORMATS.pattern})$") | value.startswith("-----BEGIN "), 1)
            .when(before.rlike(r"://[^\s/:@]*:$") & after.startswith("@"), 1)
            .when(named & mixed, 1)
            .when(feature("digits") == 1, 0)
            .when((feature("address") == 1) | after.startswith("@") | before.endswith("@"), 0)
            .when(harmless, 0)
            .when(feature("coverage") > 0.6, 0))


def fit_forest(labelled: DataFrame):
    """A forest over ``vector`` and ``label``; None unless both labels occur."""
    from pyspark.ml.classification import RandomForestClassifier

    if labelled.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="vector", labelCol="label", probabilityCol="probability", numTrees=TREES,
                                  maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8, featureSubsetStrategy="sqrt",
                                  maxBins=64).fit(labelled)


def score_findings(found: DataFrame, label: Column, sample: int = LABELLED_ROWS) -> DataFrame:
    """``found`` plus label, held_out, score (probability of a secret) and is_secret."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = found.withColumns({"label": label.cast("double"), "held_out": held_out(found["doc_id"])})
    rows = written(rows.withColumn("vector", array_to_vector("features")), "secret-findings")
    known = (rows.where(F.col("label").isNotNull() & ~F.col("held_out"))
             .orderBy(F.xxhash64("doc_id", "start", "value"), "doc_id", "start").limit(sample))
    # A fixed layout, so that the forest's draws are the same on any cluster.
    known = written(known.repartition(4, "doc_id", "start").sortWithinPartitions("doc_id", "start"), "secret-labelled")
    forest = fit_forest(known)
    if forest is None:
        share = known.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        scored = rows.withColumn("score", F.lit(float(share)))
    else:
        scored = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("score") >= KEEP_FROM).select(
        *[c for c in rows.columns if c != "vector"], "score", "is_secret")


def find_secrets(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """One row per candidate of all documents, with its score and decision; labels by rule."""
    found = find_candidates(docs, path)
    return score_findings(found, label_findings(found))
