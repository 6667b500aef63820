"""Toxicity of whole texts: a noisy-channel decoder for disguised words, then a classifier on the restored text.

1. A character trigram model is counted over the plain words of all documents.
2. A token that isn't plain letters, stretches a letter, or stands in a row of
   single characters becomes a lattice: look-alike characters may stand for
   letters, signs between letters may be noise, a stretched letter may be one or two.
   Viterbi (over the last two letters) finds the reading that the character
   model and the channel's costs make likeliest. Short tokens in a row, and the
   parts of a token between signs, are one lattice too, in which each blank or
   sign may be a word's end, at the price of the character model, or noise; all words
   on readings that are not much worse than the best are restored words.
3. The restored words (for a disguised word also the next best readings), and
   their 4- and 5-grams, are features of a text if they occur in it. Single features
   that find toxic texts become rules, and the score is the noisy-or of the
   rules that a text meets, so one sure word is enough. They are learned on at
   most ``LABEL_ROWS`` labelled texts (those with the smallest hashes of doc_id, of near
   copies about one), the bounded sample that a classifier may use; the driver
   reads at most ``MAX_FEATURES`` features and the sample's rows over these.

Defined results: null and empty texts have no features and get the base score.
Without labels of both kinds the score is 0 for every document. Labels with a
null doc_id or null toxic aren't used; a doc_id with labels of both kinds counts
as toxic. A null doc_id counts as held out. Repeated rows are scored each. An
empty table gives no rows. Labels, languages, sources and ids are no inputs of a
score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import partial
from itertools import chain, groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_of, written
from ledgerline.llm.jaccard_forest import shingles
from ledgerline.llm.language_spans import CELLS, _cells, _codes, held_out

LABEL_ROWS = 12_000
MAX_FEATURES = 20_000
LEAST_DOCUMENTS = 3  # toxic texts of the sample that have a feature
LEAST_EVIDENCE = 25.0  # likelihood-ratio statistic of a rule
CANDIDATE_EVIDENCE = 9.0  # of a feature that may become one
LEAST_PRECISION = 0.97
LEAST_GAIN = 1.5
SMOOTHING = 0.2
KEPT_TOKENS = 300_000
READINGS = 8  # of a disguised word that count as features
SLACK = 6.0  # nats that they may be worse than the best
PART = 64  # steps of a long run after which the beginning of its best reading is settled
SETTLED_BEFORE = 32  # letters at its end that stay open
SHORT = 3  # characters of tokens that may be parts of one word
READ_PIECES, OVERLAP = 512, 32
KEPT_RUNS = 100_000
LEAST_CORE = 3  # letters at the beginning of a feature by which runs without it are told

# Letters that a look-alike may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
# Costs of the channel, in nats.
LOOK_ALIKE_COST, NOISE_COST, LOST_DIGIT_COST, STRETCH_COST, DOUBLE_COST = 1.0, 2.5, 4.0, 0.7, 6.0
JOIN_COST = 1.0  # of a blank or sign between two parts of a word

# Odd multipliers of the sketches that tell near copies.
_SKETCHES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

_PLAIN_EDGE = ".,;:?\"'()[]{}<>…«»¿"
_EDGE_RUN = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
_SEPARATORS = re.compile(r"[.\-_/:,;~=?\"'\[\]{}<>]+")
_STRETCHED = re.compile(r"(.)\1\1")
_DOUBLED = re.compile(r"(.)\1+")
_SHORT_RUN = re.compile(b"\1{2,}")


@dataclass
class CharacterModel:
    triples: np.ndarray
    contexts: np.ndarray
    letter_cost: float  # mean cost of a letter, which emitting one earns back

    @classmethod
    def of(cls, counts) -> CharacterModel:
        """``counts``: rows (kind, cell, n); kind 0 trigrams, 1 contexts."""
        tables = [np.zeros(CELLS), np.zeros(CELLS)]
        cost = 0.0
        for kind, cell, n in counts:
            tables[kind][cell] = n
        triples, contexts = np.log(tables[0] + SMOOTHING), np.log(tables[1] + 40 * SMOOTHING)
        if tables[0].sum():
            used = tables[1] > 0  # entropy of a letter given its context
            cost = float((np.dot(tables[1][used], contexts[used]) - np.dot(tables[0], triples)) / tables[0].sum())
        return cls(triples, contexts, max(cost, 0.5))

    def cost(self, a: str, b: str, c: str) -> float:
        """Nats of ``c`` after ``a`` and ``b``; "\\0" ends a word."""
        triple, context, _ = _cells(np.array([ord(a), ord(b), ord(c)], dtype=np.int64), np.zeros(1, dtype=np.int64))
        return float(self.contexts[context[0]] - self.triples[triple[0]])


def lattice(run: str) -> list[list[tuple[str, float]]]:
    """Readings of each stretch of equal characters, with their costs."""
    steps = []
    for c, group in groupby(run):
        n = len(list(group))
        if c.isalpha():
            if n == 1:
                steps.append([(c, 0.0)])
            elif n == 2:
                steps.append([(c + c, 0.0), (c, DOUBLE_COST)])
            else:
                steps.append([(c, STRETCH_COST), (c + c, STRETCH_COST)])
            continue
        readings = [(x * k, LOOK_ALIKE_COST * min(n, 2)) for x in LOOK_ALIKES.get(c, "") for k in {1, min(n, 2)}]
        readings.append(("", LOST_DIGIT_COST if c.isdigit() else NOISE_COST))
        steps.append(readings)
    return steps


class Decoder:
    """Restored words of tokens, each worked out once."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.costs: dict[tuple[str, str, str], float] = {}

    def _cost(self, a: str, b: str, c: str) -> float:
        key = (a, b, c)
        if key not in self.costs:
            if len(self.costs) > 200_000:
                self.costs.clear()
            self.costs[key] = self.model.cost(a, b, c)
        return self.costs[key]

    def restore(self, run: str) -> list[str]:
        """The likeliest words behind a run of characters, best first: READINGS at most, none much worse."""
        earn = self.model.letter_cost
        best = {("", "\0"): [(0.0, "")]}
        settled = ""
        for at, readings in enumerate(lattice(run), 1):
            after: dict[tuple[str, str], list[tuple[float, str]]] = {}
            for (a, b), paths in best.items():
                for letters, extra in readings:
                    x, y, more = a, b, extra
                    for c in letters:
                        if x:
                            more += self._cost(x, y, c) - earn
                        x, y = y, c
                    after.setdefault((x, y), []).extend((cost + more, text + letters) for cost, text in paths)
            best = {state: sorted(paths)[:READINGS] for state, paths in after.items()}
            if at % PART == 0:
                head = min(chain.from_iterable(best.values()))[1][:-SETTLED_BEFORE]
                settled += head
                best = {state: kept for state, paths in best.items()
                        if (kept := [(cost, text[len(head):]) for cost, text in paths if text.startswith(head)])}
        ends = sorted((cost + (self._cost(a, b, "\0") if a else 0.0), text)
                      for (a, b), paths in best.items() for cost, text in paths)
        return [settled + text for cost, text in ends[:READINGS] if settled + text and cost <= ends[0][0] + SLACK]

    def read(self, pieces: list[str]) -> list[str]:
        """Words that the pieces may be, joined or apart. Long lists are read in parts that overlap by OVERLAP pieces.

        Of a piece with more than PART characters only the beginning and the end can be parts of a word with others.
        """
        runs: list[list[str]] = [[]]
        for piece in pieces:
            if len(piece) <= PART:
                runs[-1].append(piece)
            else:
                runs[-1].append(piece[:PART // 2])
                runs.append([piece[-(PART // 2):]])
        found: dict[str, None] = {}
        for run in runs:
            for begin in range(0, max(1, len(run) - OVERLAP), READ_PIECES - OVERLAP):
                found |= dict.fromkeys(self._read(run[begin:begin + READ_PIECES]))
        return list(found)

    def _read(self, pieces: list[str]) -> list[str]:
        """The words of all readings within SLACK of the best.

        Words begin and end at bounds of pieces. One pass over the pieces keeps
        the open words (by where they began and their last two letters) that are within
        twice the slack of the best; what each closed word costs gives, from
        the end, the best reading through it.
        """
        earn, far = self.model.letter_cost, 2 * SLACK
        forward = [0.0] + [float("inf")] * len(pieces)
        closed: list[tuple[int, int, float, str]] = []
        open_ = {(0, "", "\0"): [(0.0, "")]}
        for end, piece in enumerate(pieces, 1):
            for readings in lattice(piece):
                after: dict[tuple[int, str, str], list[tuple[float, str]]] = {}
                for (begin, a, b), paths in open_.items():
                    for letters, extra in readings:
                        x, y, more = a, b, extra
                        for c in letters:
                            if x:
                                more += self._cost(x, y, c) - earn
                            x, y = y, c
                        after.setdefault((begin, x, y), []).extend((cost + more, text + letters) for cost, text in paths)
                least = min(paths[0][0] for paths in map(sorted, after.values())) + far
                open_ = {state: kept for state, paths in after.items()
                         if (kept := [p for p in sorted(paths)[:READINGS] if p[0] <= least])}
            for (begin, a, b), paths in open_.items():
                more = self._cost(a, b, "\0") if a else 0.0
                for cost, text in paths:
                    closed.append((begin, end, cost + more - forward[begin], text))
                    forward[end] = min(forward[end], cost + more)
            open_ = {state: [(cost + JOIN_COST, text) for cost, text in paths] for state, paths in open_.items() if state[1]}
            open_[end, "", "\0"] = [(forward[end], "")]
        backward = [float("inf")] * len(pieces) + [0.0]
        for begin, end, cost, _ in sorted(closed, key=lambda w: -w[1]):
            backward[begin] = min(backward[begin], cost + backward[end])
        return list(dict.fromkeys(text for begin, end, cost, text in closed
                                  if text and forward[begin] + cost + backward[end] <= backward[0] + SLACK))

    def words(self, token: str, readings: int = 1) -> list[str]:
        """Restored words of one token (lower case, no white space), with the next best readings if wanted."""
        token = token.strip(_PLAIN_EDGE)
        if not token.isalpha():
            token = _EDGE_RUN.sub("", token).strip(_PLAIN_EDGE)
        if token.isalpha() and not _STRETCHED.search(token):
            return [token]
        parts = pieces = [p for p in _SEPARATORS.split(token) if p]
        if len(parts) > 2 and all(len(p) == 1 for p in parts):
            parts = ["".join(parts)]
        out = []
        for part in parts:
            plain = part.rstrip("!")
            if plain.isalpha() and not _STRETCHED.search(plain):
                out.append(plain)
            elif any(map(str.isalpha, part)):
                out += self.restore(part)[:readings]
        if readings > 1 and len(pieces) > 1 and any(map(str.isalpha, token)):
            out += [word for word in self.read(pieces) if word not in out]
        return out


def _single(token: str) -> bool:
    return len(token) == 1 and (token.isalpha() or token in LOOK_ALIKES)


def tokens_of(text: str) -> list[str]:
    """Tokens of a text; three or more single characters in a row are one token."""
    return _spaced(text.lower().split())


def _spaced(tokens: list[str]) -> list[str]:
    flags = bytes(map(_single, tokens))
    if b"\1\1\1" not in flags:
        return tokens
    out, at = [], 0
    for one, group in groupby(flags):
        n = len(list(group))
        run = tokens[at:at + n]
        out += ["".join(run)] if one and n > 2 else run
        at += n
    return out


def _short(token: str) -> bool:
    return len(token) <= SHORT or len(token.strip(_PLAIN_EDGE)) <= SHORT


def runs_of(tokens: list[str], short: set[str]) -> set[str]:
    """Two or more short tokens in a row, without signs at their edges, joined by blanks."""
    out = set()
    for m in _SHORT_RUN.finditer(bytes(map(short.__contains__, tokens))):
        pieces = [p for token in tokens[m.start():m.end()] if (p := token.strip(_PLAIN_EDGE))]
        if len(pieces) > 1:
            out.add(" ".join(pieces))
    return out


def features_of(word: str) -> set[str]:
    """The word and its 4- and 5-grams, with marks at both ends."""
    whole = f"^{word}$"
    return {whole} | {whole[i:i + n] for n in (4, 5) for i in range(len(whole) - n + 1)}


class TokenFeatures:
    """Features of a text, from the features of its tokens; only those in ``wanted`` unless it is None."""

    def __init__(self, decoder: Decoder, wanted: dict[str, int] | None):
        self.decoder, self.wanted = decoder, wanted
        self.known: dict[str, frozenset] = {}
        self.short: set[str] = set()  # the short ones of the known tokens
        self.runs: dict[str, frozenset] = {}
        self.nothing: frozenset = frozenset()
        # What a run of plain letters must have for one of the features that are wanted, doubled letters once.
        self.cores: dict[str, list[str]] | None = None if wanted is None else {}
        for core in {_DOUBLED.sub(r"\1", f.strip("^$")) for f in wanted or ()}:
            self.cores.setdefault(core[:LEAST_CORE], []).append(core)
        self.sizes = sorted(set(map(len, self.cores or ())))

    def _may_have(self, glued: str) -> bool:
        if self.cores is None or not glued.isalpha():
            return any(map(str.isalpha, glued))
        once = _DOUBLED.sub(r"\1", glued)
        return any(core in once for size in self.sizes for i in range(len(once) - size + 1)
                   for core in self.cores.get(once[i:i + size], ()))

    def _run_features(self, run: str) -> frozenset:
        if not self._may_have(run.replace(" ", "")):
            return self.nothing
        if run not in self.runs:
            if len(self.runs) >= KEPT_RUNS:
                self.runs.clear()
            self.runs[run] = self._kept(self.decoder.read(run.split(" ")))
        return self.runs[run]

    def _features(self, token: str) -> frozenset:
        return self._kept(self.decoder.words(token, READINGS))

    def _kept(self, words: list[str]) -> frozenset:
        found = set().union(*map(features_of, words))
        if self.wanted is not None:
            found = {self.wanted[f] for f in found if f in self.wanted}
        return frozenset(found) if found else self.nothing

    def of(self, text: str) -> set:
        known, words = self.known, text.lower().split()
        self.short.update(filter(_short, set(words).difference(known)))
        found = set().union(*map(self._run_features, runs_of(words, self.short)))
        distinct = set(_spaced(words))
        for token in distinct.difference(known):
            if len(known) >= KEPT_TOKENS:
                known.clear()
                self.short.clear()
                found.update(*map(self._features, distinct))
                return found
            known[token] = self._features(token)
        return found.union(*[f for f in map(known.get, distinct) if f])


def _character_counter(batches):
    import pyarrow as pa

    for batch in batches:
        counts = Counter(chain.from_iterable(text.lower().split() for text in batch.column("text").to_pylist()))
        words: Counter = Counter()
        for token, n in counts.items():
            if (word := token.strip(_PLAIN_EDGE)).isalpha():
                words[word] += n
        if not words:
            continue
        flat, starts = _codes(list(words))
        triple, context, owner = _cells(flat, starts)
        weight = np.fromiter(words.values(), np.float64, len(words))[owner]
        for kind, cells in enumerate((triple, context)):
            n = np.bincount(cells, weight, CELLS).astype(np.int64)
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cell), kind), pa.int32()), pa.array(cell, pa.int32()), pa.array(n[cell])],
                names=["kind", "cell", "n"])


def character_model(docs: DataFrame) -> CharacterModel:
    """Counts over the words of all documents; the driver reads 2 * CELLS counts at most."""
    rows = docs.select(text_of(docs).alias("text"))
    counts = rows.mapInArrow(_character_counter, "kind int, cell int, n long")
    return CharacterModel.of(counts.groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect())


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """At most ``rows`` texts (toxic, text) with labels that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    found = texts.join(F.broadcast(known), "doc_id")  # LABEL_ROWS small rows at most
    return found.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _feature_counter(shared, batches):
    import pyarrow as pa

    features = TokenFeatures(Decoder(shared.value), None)
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts[int(toxic > 0)].update(features.of(text))
        for toxic, found in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([toxic] * len(found), pa.int32()), pa.array(list(found), pa.string()),
                 pa.array(list(found.values()), pa.int64())], names=["toxic", "feature", "n"])


def _feature_rows(shared, wanted, batches):
    import pyarrow as pa

    features = TokenFeatures(Decoder(shared.value), wanted.value)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = [sorted(features.of(text)) for text in texts]
        sketches = []
        for text in texts:
            parts = shingles(text.encode().split())
            sketches.append([int((parts * a >> np.uint64(1)).min()) if len(parts) else 0 for a in _SKETCHES])
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(found, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))],
            names=["toxic", "features", "sketches"])


def independent(sketches: list[list[int]]) -> list[bool]:
    """Whether each text shares no sketch value with one that was kept before it: of near copies about one stays."""
    seen: set[tuple[int, int]] = set()
    out = []
    for values in sketches:
        marks = set(enumerate(values))
        out.append(not marks & seen)
        if out[-1]:
            seen |= marks
    return out


def _evidence(a: np.ndarray, b: np.ndarray, rate: float) -> np.ndarray:
    """Likelihood-ratio statistic of ``a`` toxic and ``b`` other texts against a rate of toxic texts."""
    share = np.maximum(a / np.maximum(a + b, 1), 1e-9)
    return 2 * (a * np.log(share / max(rate, 1e-9)) + b * np.log(np.maximum(1 - share, 1e-9) / (1 - rate + 1e-9)))


def fit_rules(rows: list[list[int]], labels: np.ndarray, names: list[str]) -> tuple[np.ndarray, float]:
    """Strength of each feature (0: no rule) and the rate of toxic texts that no rule finds.

    Whole words that are precise and whose evidence can't be chance are rules,
    and so are n-grams that find ``LEAST_GAIN`` times as many toxic texts as any
    such word that they are a part of (the common part of many forms). Then words and n-grams are taken one by one for the toxic texts that no rule
    finds yet: the feature that most of these have, with evidence against their
    lower rate (ties to the longer feature, which is the more specific). A
    rule's strength is its smoothed precision.
    """
    width, lengths = len(names), [len(n) for n in names]
    whole = np.array([n.startswith("^") and n.endswith("$") for n in names], dtype=bool)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.fromiter(chain.from_iterable(rows), np.int64, len(owner))
    toxic = labels > 0
    rate = float(toxic.mean())
    bad = np.bincount(column[toxic[owner]], minlength=width)
    good = np.bincount(column[~toxic[owner]], minlength=width)
    usable = bad >= np.maximum(LEAST_PRECISION * (bad + good), LEAST_DOCUMENTS)
    precision = (bad + rate) / (bad + good + 1)
    sure = usable & (_evidence(bad, good, rate) >= LEAST_EVIDENCE)
    words = [(names[i], int(bad[i])) for i in np.flatnonzero(sure & whole)]
    for i in np.flatnonzero(sure & ~whole):  # a part must find clearly more than any one word that it is a part of
        sure[i] = bad[i] >= LEAST_GAIN * max([n for word, n in words if names[i] in word], default=0)
    strength = np.where(sure, precision, 0.0)
    open_ = toxic.copy()
    open_[owner[strength[column] > 0]] = False
    while True:
        left = float(open_.sum() / max(1, open_.sum() + (~toxic).sum()))
        new = np.bincount(column[open_[owner]], minlength=width)
        fit = usable & (strength == 0) & (new >= LEAST_DOCUMENTS) & (_evidence(new, good, left) >= LEAST_EVIDENCE)
        if not fit.any():
            return strength, left
        best = int(np.lexsort((-np.arange(width), lengths, np.where(fit, new, -1)))[-1])
        strength[best] = precision[best]
        open_[owner[column == best]] = False


@dataclass
class ToxicityModel:
    characters: CharacterModel
    features: dict[str, int]
    strength: np.ndarray  # of the rule that each feature makes
    base: float | None  # rate of toxic texts that no rule finds; None: nothing to learn from

    def score(self, found: set[int]) -> float:
        """Chance that at least one of the rules is right, or the base rate holds."""
        if self.base is None:
            return 0.0
        return float(1 - (1 - self.base) * np.prod(1 - self.strength[sorted(found)]))


def train(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> ToxicityModel:
    context = docs.sparkSession.sparkContext
    characters = character_model(docs)
    sample = written(labelled_sample(docs, labels, rows), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return ToxicityModel(characters, {}, np.zeros(0), None)
    shared = context.broadcast(characters)
    counts = (sample.mapInArrow(partial(_feature_counter, shared), "toxic int, feature string, n long")
              .groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
                                      F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")))
    part = lambda x, n: F.when(x > 0, x * F.log(x * (bad + good) / ((F.col("a") + F.col("b")) * n))).otherwise(0.0)
    evidence = 2 * (part(F.col("a"), bad) + part(F.col("b"), good))
    chosen = (counts.where((F.col("a") >= LEAST_DOCUMENTS) & (F.col("a") * good > 2 * F.col("b") * bad))
              .withColumn("evidence", evidence).where(F.col("evidence") >= CANDIDATE_EVIDENCE)
              .orderBy(F.desc("evidence"), "feature").limit(MAX_FEATURES).collect())
    features = {r["feature"]: i for i, r in enumerate(chosen)}
    wanted = context.broadcast(features)
    found = sample.mapInArrow(partial(_feature_rows, shared, wanted),
                              "toxic int, features array<int>, sketches array<long>").collect()
    found.sort(key=lambda r: (r["toxic"], r["features"], r["sketches"]))
    found = [r for r, alone in zip(found, independent([r["sketches"] for r in found]), strict=True) if alone]
    y = np.array([float(r["toxic"] > 0) for r in found])
    strength, base = fit_rules([r["features"] for r in found], y, list(features))
    rules = {f: i for i, (f, x) in enumerate((f, x) for f, x in zip(features, strength, strict=True) if x)}
    return ToxicityModel(characters, rules, strength[strength > 0], base)


def _scorer(shared, batches):
    import pyarrow as pa

    model = shared.value
    features = TokenFeatures(Decoder(model.characters), model.features)
    for batch in batches:
        scores = []
        for text in batch.column("text").to_pylist():
            scores.append(model.score(features.of(text)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())],
                                         names=["doc_id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    made = rows.mapInArrow(partial(_scorer, shared), "doc_id long, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def restore_texts(docs: DataFrame, model: CharacterModel | None = None) -> DataFrame:
    """doc_id and the restored words of each text, joined by blanks."""
    shared = docs.sparkSession.sparkContext.broadcast(character_model(docs) if model is None else model)

    def restore(batches):
        import pyarrow as pa

        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [" ".join(chain.from_iterable(map(decoder.words, tokens_of(text))))
                     for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "restored"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(restore, "doc_id long, restored string")
