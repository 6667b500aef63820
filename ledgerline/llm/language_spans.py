"""Language identification by spans: script ranges, per-word scores and Viterbi with a switching penalty.

A word is a run of letters (lowered). The range that its first letter lies in
narrows the candidates to the languages that use that range; each candidate
scores the word by a character trigram model. Viterbi over the words of a text
finds the best sequence of languages, where every switch costs ``SWITCH`` nats,
so stretches in another language become spans and stray words don't. The
language of the text is the one with most letters; the score is its share of
the letters.

A constant sequence is proven best without the recursion when no other language
gains more than half a switch over any stretch of words; most texts end there. The other texts of
a batch go through the recursion together, word by word.

The model is fitted on about ``SAMPLE_PER_LANGUAGE`` labelled documents per language (those
with the smallest hashes of doc_id), the bounded sample that a classifier may use. Its
n-gram counts are added up by Spark; the driver reads at most ``2 * CELLS``
counts per language and at most ``MAX_LANGUAGES`` languages (more is an error).

Defined results: null text, and text without a letter, is "und" with score 0.
Text whose letters no learned language uses gets the language with most
training documents, with score 0. With no labelled document every text is "und". A null
doc_id counts as held out. Repeated rows are labelled each. An empty table
gives no rows. Labels, sources and ids are no inputs of a prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_of

SAMPLE_PER_LANGUAGE = 1500
MAX_LANGUAGES = 500
CELLS = 1 << 16
SMOOTHING = 0.2
SWITCH = 14.0
KEPT_WORDS = 400_000
CHUNK_WORDS = 400_000
UNKNOWN = "und"
# A language uses a range if at least this share of its training letters lie in it.
LEAST_SHARE = 0.001
EXCLUDED = np.float32(-60.0)

# First code points of the script ranges.
SCRIPT_STARTS = np.array([
    0x0000,  # basic Latin
    0x0080,  # Latin with diacritics
    0x0250,  # phonetic
    0x0370,  # Greek
    0x0400,  # Cyrillic
    0x0530,  # Armenian
    0x0590,  # Hebrew
    0x0600,  # Arabic
    0x0900,  # Devanagari
    0x0980,  # Bengali
    0x0A00,  # Gurmukhi, Gujarati
    0x0B00,  # Oriya, Tamil
    0x0C00,  # Telugu, Kannada
    0x0D00,  # Malayalam, Sinhala
    0x0E00,  # Thai
    0x0E80,  # Lao
    0x0F00,  # Tibetan
    0x1000,  # Myanmar
    0x10A0,  # Georgian
    0x1100,  # Hangul jamo
    0x1200,  # Ethiopic and others
    0x1E00,  # Latin additional
    0x1F00,  # Greek extended
    0x2000,  # symbols
    0x3040,  # kana
    0x3130,  # Hangul compatibility
    0x3400,  # Han
    0xA000,  # Yi and others
    0xAC00,  # Hangul syllables
    0xD7B0,  # rest
])
_WORDS = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two zeros, and where each word begins."""
    joined = "\0\0".join(words)
    flat = np.frombuffer(f"\0{joined}\0".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return flat, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _cells(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells, their context cells, and which word each belongs to (windows that lie in one word)."""
    word = np.zeros(len(flat), dtype=np.int64)
    word[starts[1:]] = 1
    word = np.cumsum(word)
    inside = np.flatnonzero(word[:-2] == word[2:])
    a, b, c = flat[inside], flat[inside + 1], flat[inside + 2]
    context = (a * 1_000_003 + b * 8_191 + 17) * 0x9E3779B1
    triple = (context + c * 0x85EBCA77) & 0xFFFFFFFFFFFF
    return (triple ^ (triple >> 21)) % CELLS, ((context & 0xFFFFFFFFFFFF) ^ (context >> 19)) % CELLS, word[inside]


@dataclass
class LanguageModel:
    languages: list[str]
    prior: int  # the language with most training documents
    shares: np.ndarray  # log share of each language of the training documents
    triples: np.ndarray  # CELLS x languages, log counts
    contexts: np.ndarray
    allowed: np.ndarray  # script ranges x languages

    @classmethod
    def of(cls, languages: list[str], documents: list[int], counts) -> LanguageModel:
        """``counts``: rows (kind, language, cell, n); kind 0 trigrams, 1 contexts, 2 letters by script."""
        n = len(languages)
        tables = [np.zeros((size, n)) for size in (CELLS, CELLS, len(SCRIPT_STARTS))]
        for kind, language, cell, count in counts:
            tables[kind][cell, language] = count
        triples = np.log(tables[0] + SMOOTHING).astype(np.float32)
        contexts = np.log(tables[1] + 40 * SMOOTHING).astype(np.float32)
        allowed = tables[2] >= LEAST_SHARE * np.maximum(tables[2].sum(axis=0), 1)
        shares = np.log(np.maximum(np.array(documents, dtype=np.float64), 1) / max(1, sum(documents)))
        return cls(languages, int(np.argmax(documents)) if n else 0, shares, triples, contexts, allowed)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word in each language, and its number of letters (0: no information)."""
        flat, starts = _codes(words)
        triple, context, owner = _cells(flat, starts)
        each = self.triples[triple] - self.contexts[context]
        total = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        begins = np.searchsorted(owner, np.arange(len(words)))
        total[:] = np.add.reduceat(each, begins, axis=0)
        script = np.searchsorted(SCRIPT_STARTS, flat[starts + 1], side="right") - 1
        allowed = self.allowed[script]
        total = np.where(allowed, total, total.min(axis=1, keepdims=True) + EXCLUDED)
        total -= total.max(axis=1, keepdims=True)
        none = ~allowed.any(axis=1)
        total[none] = 0
        letters = np.fromiter((sum(map(str.isalpha, w)) for w in words), np.int64, len(words))
        return total, np.where(none, -letters, letters)


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best sequence of columns for each matrix (words x languages); ties stay, then go to the first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    flat = np.concatenate([scores[i] for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    back = np.zeros(flat.shape, dtype=np.int16)
    best = flat[starts].astype(np.float64)
    own = np.arange(flat.shape[1])
    for t in range(1, int(lengths[0])):
        k = int(np.searchsorted(-lengths, -t, side="left"))  # texts with more than t words
        now = best[:k]
        top = now.argmax(axis=1)
        other = now[np.arange(k), top] - switch
        moves = other[:, None] > now
        back[starts[:k] + t] = np.where(moves, top[:, None], own)
        best[:k] = np.where(moves, other[:, None], now) + flat[starts[:k] + t]
    paths = [np.zeros(n, dtype=np.int16) for n in lengths]
    state = best.argmax(axis=1)
    every = np.zeros(len(flat), dtype=np.int16)
    for t in range(int(lengths[0]) - 1, -1, -1):
        k = int(np.searchsorted(-lengths, -t, side="left"))
        at = starts[:k] + t
        every[at] = state[:k]
        state[:k] = back[at, state[:k]]
    for j, (a, n) in enumerate(zip(starts, lengths, strict=True)):
        paths[j] = every[a:a + n]
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(scores)
    for j, i in enumerate(order):
        out[i] = paths[j]
    return out


class Labeller:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def _learn(self, lists: list[list[str]]) -> None:
        new = list(set().union(*lists).difference(self.place))
        if len(self.place) + len(new) > KEPT_WORDS:
            new = list(set().union(*lists))
            self.place, self.table, self.letters = {}, self.table[:0], self.letters[:0]
        if new:
            table, letters = self.model.scores(new)
            self.place.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, table])
            self.letters = np.concatenate([self.letters, letters])

    def label(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Spans of each text: first word, end, language (-1: none known), letters."""
        out: list = []
        at = 0
        while at < len(texts):
            lists, n = [], 0
            while at < len(texts) and (not lists or n < CHUNK_WORDS):
                lists.append(words_in(texts[at]))
                n += len(lists[-1])
                at += 1
            out += self._chunk(lists, n)
        return out

    def _chunk(self, lists, n):
        if not self.model.languages or not n:
            return [[(0, len(words), -1, sum(map(str.isalpha, "".join(words))))] if words else [] for words in lists]
        self._learn(lists)
        ids = np.fromiter(map(self.place.__getitem__, chain.from_iterable(lists)), np.int64, n)
        scores, letters = self.table[ids], self.letters[ids]
        ends = np.cumsum([len(words) for words in lists])
        firsts = [end - len(words) for end, words in zip(ends, lists, strict=True) if words]
        scores[firsts] += self.model.shares
        paths: list = []
        hard = []
        for i, words in enumerate(lists):
            own = scores[ends[i] - len(words):ends[i]]
            paths.append(None)
            if not len(words):
                continue
            best = int(own.sum(axis=0, dtype=np.float64).argmax())
            gain = np.zeros((len(words) + 1, own.shape[1]))
            np.cumsum(own - own[:, best:best + 1], axis=0, out=gain[1:], dtype=np.float64)
            if (gain - np.minimum.accumulate(gain, axis=0)).max() <= SWITCH / 2:
                paths[i] = best
            else:
                hard.append(i)
        if hard:
            for i, path in zip(hard, viterbi([scores[ends[i] - len(lists[i]):ends[i]] for i in hard]), strict=True):
                paths[i] = path
        return [self._spans(path, letters[ends[i] - len(lists[i]):ends[i]]) for i, path in enumerate(paths)]

    @staticmethod
    def _spans(path, letters: np.ndarray) -> list[tuple[int, int, int, int]]:
        if path is None:
            return []
        known = letters > 0
        if not known.any():
            return [(0, len(letters), -1, int(-letters.sum()))]
        if isinstance(path, int):
            return [(0, len(letters), path, int(np.abs(letters).sum()))]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        return [(int(a), int(b), int(path[a]), int(np.abs(letters[a:b]).sum()))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _counter(languages: list[str]):
    index = {language: i for i, language in enumerate(languages)}

    def count(batches):
        import pyarrow as pa

        def rows(kind: int, language: int, cells: np.ndarray):
            cell, n = np.unique(cells, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cell), kind), pa.int32()), pa.array(np.full(len(cell), language), pa.int32()),
                 pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["kind", "language", "cell", "n"])

        for batch in batches:
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if words := words_in(text):
                    flat, starts = _codes(words)
                    triple, context, _ = _cells(flat, starts)
                    scripts = np.searchsorted(SCRIPT_STARTS, flat[flat > 0], side="right") - 1
                    for kind, cells in enumerate((triple, context, scripts)):
                        yield rows(kind, index[language], cells)

    return count


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on the labelled documents that are not held out."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].cast("string").alias("lang"),
                       text_of(docs).alias("text")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    totals = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    totals.sort(key=lambda r: r["lang"])
    languages = [r["lang"] for r in totals]
    if not languages:
        return LanguageModel.of([], [], [])
    steps = 1 << 30
    rates = docs.sparkSession.createDataFrame(
        [(r["lang"], min(steps, sample * steps // r["count"] + 1)) for r in totals], "lang string, below long")
    chosen = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < F.col("below"))
    counts = (chosen.select("lang", "text")
              .mapInArrow(_counter(languages), "kind int, language int, cell int, n long")
              .groupBy("kind", "language", "cell").agg(F.sum("n").alias("n")).collect())
    return LanguageModel.of(languages, [r["count"] for r in totals], counts)


def _labeller(shared):
    def label(batches):
        import pyarrow as pa

        model = shared.value
        labeller = Labeller(model)
        names = model.languages
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()),
                                   ("letters", pa.int64())]))
        for batch in batches:
            predicted, scores, spans = [], [], []
            for found in labeller.label(batch.column("text").to_pylist()):
                total = np.zeros(len(names) + 1, dtype=np.int64)
                for _, _, language, letters in found:
                    total[language] += letters
                if not names or not total.sum():
                    predicted.append(UNKNOWN)
                    scores.append(0.0)
                elif total[-1] == total.sum():
                    predicted.append(names[model.prior])
                    scores.append(0.0)
                else:
                    best = int(total[:-1].argmax())
                    predicted.append(names[best])
                    scores.append(float(total[best] / total.sum()))
                spans.append([{"start": a, "end": b, "lang": names[k] if k >= 0 else UNKNOWN, "letters": n}
                              for a, b, k, n in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(predicted, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return label


def label_languages(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, spans (of words) in order."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    made = rows.mapInArrow(_labeller(shared), "doc_id long, lang_pred string, score double, "
                           "spans array<struct<start:long,end:long,lang:string,letters:long>>")
    return made.withColumn("held_out", held_out(F.col("doc_id")))
