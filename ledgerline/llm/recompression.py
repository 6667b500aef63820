"""Substring deduplication by recompression: words of repeated 13-word windows go, their first place stays.

Texts are recompressed in rounds. The first round names maximal runs of one
word; each of the ``ROUNDS`` rounds after it names pairs: a hash of a symbol's
name puts it into the left or the right class, and a left symbol with a right
one behind it becomes one symbol. A name is a hash of what it stands for, so
all tasks give the same words the same name without a dictionary that would
grow with the corpus, and equal substrings get the same symbols inside.

Which words decide about a symbol is kept beside it: a symbol of the left class
that stays single depends on the one behind it, one of the right class on
the one before it, a run on both neighbours, a pair on nothing else. So every
symbol knows its context, the smallest stretch of words that gives the same
symbol wherever it stands. A window stands for the symbol of the highest round
whose context lies within the window, of several the one with the smallest
hash; a window without any (inside long runs) stands for its own words. Equal
windows thus choose equal symbols, and one symbol stands for several windows
side by side: about one in five words has a chosen symbol.

Rounds on Spark: 1. chosen symbols of all texts meet by name; those of at least
two different texts are shared. 2. Texts with shared symbols get them back, and
the windows that chose one of them meet by a fingerprint of all their words
(two independent 64-bit sums over 128-bit word hashes), which verifies the
repeat and finds the smallest doc_id it starts in. 3. Windows of larger
doc_ids return to their texts and cover the words that go.

Equal texts are known by SHA-256 of their words: only the copy with the
smallest doc_id goes through rounds 1 to 3, the others lose all words if
there is a window at all. Names, fingerprints and digests are reduced before
they are shuffled, and joined by keys whose skew Spark splits; a task holds
one text's windows at most, and cuts texts into stretches of ``STRETCH`` words.

Defined results: null text has no words. A null doc_id is neither smaller nor
larger than another: its words stay and cause no removal. Repeated rows of a doc_id do not
remove each other's words. Windows never cross documents. An empty table gives
no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_of, written

WINDOW = 13
# Rounds of pairs after the round of runs.
ROUNDS = 3
# Words that are recompressed at once; bytes of text that are hashed at once; bytes of texts that are held at once
# (a longer text is held alone).
STRETCH, PIECE, GROUP = 1 << 16, 1 << 17, 1 << 19
# Digests of texts that a task remembers, so as not to name the same text again and again.
REMEMBERED = 100_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(s) for s in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]

NAMES = "name long, text_id long"
COPIES = "doc_id long, digest binary, text_id long"
TEXTS = "doc_id long, text binary, digest binary, n_words long"
MARKED = "doc_id long, n_words long, n_removed long, kept_sha256 string, text binary, places array<int>, " \
         "print1 array<long>, print2 array<long>"
REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in parts of about ``PIECE`` bytes, cut at blanks only."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end] if at or cut else data
        at = end


def split_words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists."""
    for piece in pieces(data):
        if words := piece.split():  # bytes split at exactly the six ASCII blanks
            yield words


def words_digest(data: bytes) -> tuple[int, bytes]:
    """Number of words and SHA-256 of the words joined by blanks."""
    n, digest = 0, hashlib.sha256()
    for words in split_words(data):
        digest.update((b" " if n else b"") + b" ".join(words))
        n += len(words)
    return n, digest.digest()


def _mixed(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * salt
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=None)
def _all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base modulo 2^64."""
    return _all_powers(base, 1 << 19)[:n] if n <= 1 << 19 else _all_powers.__wrapped__(base, n)


def _sums(values: np.ndarray, base: int):
    """Function (low, high) -> hashes of values[low:high], by prefix sums with powers of ``base``."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=prefix[1:])
    inverse = _powers(pow(base, -1, 1 << 64), len(values) + 1)
    return lambda low, high: (prefix[high] - prefix[low]) * inverse[low]


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
# A random value for each byte, for each of the two hashes of a word.
_BYTES = [np.random.RandomState(seed).randint(0, 1 << 64, 256, np.uint64) for seed in (11, 13)]
# Longer words are hashed one by one: sums of powers modulo 2^64 are weak for long patterned words.
LONG_WORD = 64


def _hashed(data: bytes, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes, shape (words, hashes), of the words of some bytes."""
    flat = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_IS_WORD[flat], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    out = np.empty((hashes, len(start)), np.uint64)
    for i, base in zip(range(hashes), (_BASE, 0xD1342543DE82EF95), strict=False):
        out[i] = _mixed(_sums(_BYTES[i][flat], base)(start, end) + (end - start).astype(np.uint64), _SALTS[i])
    for word in np.flatnonzero(end - start > LONG_WORD):
        out[:, word] = np.frombuffer(xxhash.xxh3_128_digest(data[start[word]:end[word]]), "<u8")[:hashes]
    return start, out.T


def word_hashes(texts: list[bytes], hashes: int = 2) -> list[np.ndarray]:
    """Independent 64-bit hashes (one or two) of each word of each text: shape (words, hashes)."""
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def flush() -> None:
        start, found = _hashed(b" ".join(group), hashes)
        ends = np.cumsum([len(t) + 1 for t in group])
        out.extend(np.split(found, np.searchsorted(start, ends[:-1])))
        group.clear()

    held = 0
    for text in texts:
        if len(text) > PIECE:
            if group:
                flush()
                held = 0
            out.append(np.concatenate([_hashed(piece, hashes)[1] for piece in pieces(text)]))
            continue
        group.append(text)
        held += len(text)
        if held >= PIECE:
            flush()
            held = 0
    if group:
        flush()
    return out


def fingerprints(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums for the window that starts at each word."""
    out = []
    for column, base in ((0, 0x9FB21C651E98DF25), (1, 0xC2B2AE3D27D4EB4F)):
        h, weights = np.ascontiguousarray(hashes[:, column]), _powers(base, window)
        total = np.zeros(max(0, len(h) - window + 1), np.uint64)
        for j in range(window):
            total += h[j:j + len(total)] * weights[j]
        out.append(total)
    return out[0], out[1]


class Symbols:
    """The symbols of one round over stretches of words laid end to end.

    ``low`` and ``high``: the words from low up to, not including, high are the
    context. Where it would go beyond the stretch, low is a few less than the
    stretch's start or high a few more than its end (one for each round), so no
    window contains it. Within a stretch both never fall from symbol to symbol.
    """

    def __init__(self, names: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.names, self.first, self.low, self.high = names, first, low, high

    @classmethod
    def of_words(cls, hashes: np.ndarray, sizes: np.ndarray) -> Symbols:
        first = np.zeros(len(hashes), bool)
        starts = np.cumsum(sizes) - sizes
        first[starts[sizes > 0]] = True
        at = np.arange(len(hashes))
        return cls(hashes, first, at, at + 1)

    def runs(self) -> Symbols:
        """Maximal runs of one name become one symbol, named by the name and the length."""
        start = self.first.copy()
        start[1:] |= self.names[1:] != self.names[:-1]
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(start))
        names = self.names[at]
        long = np.flatnonzero(end - at > 1)
        names[long] = _mixed(names[long] + (end - at)[long].astype(np.uint64), _SALTS[0])
        first = self.first[at]
        last = np.append(first[1:], True)
        low = np.where(first, self.low[at] - 1, self.low[at - 1])
        high = np.where(last, self.high[end - 1] + 1, self.high[np.minimum(end, len(start) - 1)])
        return Symbols(names, first, low, high)

    def pairs(self, salt: np.uint64) -> Symbols:
        """A symbol of the left class and one of the right class behind it become one symbol."""
        right = (self.names * salt).view(np.int64) < 0
        opens = np.flatnonzero(~right[:-1] & right[1:] & ~self.first[1:])
        names, low, high = self.names.copy(), self.low.copy(), self.high.copy()
        names[opens] = _mixed(names[opens] * _MIX + names[opens + 1], salt)
        single = right.copy()
        single[opens + 1] = False
        alone = np.flatnonzero(single)
        low[alone] = np.where(self.first[alone], self.low[alone] - 1, self.low[alone - 1])
        single = ~right
        single[opens] = False
        alone = np.flatnonzero(single)
        behind = np.minimum(alone + 1, len(names) - 1)
        high[alone] = np.where(self.first[behind] | (behind == alone), self.high[alone] + 1, self.high[behind])
        high[opens] = self.high[opens + 1]
        keep = np.ones(len(names), bool)
        keep[opens + 1] = False
        return Symbols(names[keep], self.first[keep], low[keep], high[keep])


def chosen_names(hashes: np.ndarray, sizes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The name of the symbol that each window stands for.

    ``hashes``: words (first hash) of stretches of ``sizes`` words laid end to
    end; ``starts``: the first words of the windows, each within one stretch.
    """
    n = len(hashes)
    words = _sums(hashes, _BASE)
    rounds = [Symbols.of_words(hashes, sizes).runs()]
    for r in range(ROUNDS):
        rounds.append(rounds[-1].pairs(_SALTS[2 + r]))
    names = np.zeros(len(starts), np.uint64)
    open_ = np.arange(len(starts))
    for number in range(ROUNDS, 0, -1):
        found = rounds[number]
        # Symbols with a context from a word p on, and up to a word q: places in order of both.
        begin = np.cumsum(np.bincount(np.maximum(found.low + 1, 0), minlength=n + 2))[starts[open_]]
        end = np.cumsum(np.bincount(np.minimum(found.high, n + 1), minlength=n + 2))[starts[open_] + window]
        has = end > begin
        which, begin, end = open_[has], begin[has], end[has]
        if len(which):
            # The context's words and the symbol's round make its name in the index.
            low, high = np.maximum(found.low, 0), np.minimum(found.high, n)
            index = _mixed(words(low, np.maximum(high, low)) + found.names, _SALTS[0] + np.uint64(2 * number))
            best = index[begin]
            for step in range(1, int((end - begin).max())):
                np.minimum(best, index[np.minimum(begin + step, end - 1)], out=best)
            names[which] = best
        open_ = open_[~has]
    # Windows without a symbol stand for their own words.
    names[open_] = _mixed(words(starts[open_], starts[open_] + window), _SALTS[1])
    return names


def _stretches(hashes: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
    """(place, words) of the stretches of a text; each window lies within one of them and starts in one only."""
    for at in range(0, max(1, len(hashes) - window + 1), STRETCH):
        yield at, hashes[at:at + STRETCH + window - 1]


def names_of_texts(texts: list[np.ndarray], window: int = WINDOW) -> list[np.ndarray]:
    """For each text (word hashes, shape (n, 2)) the name of each of its windows."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, np.ndarray]] = []

    def recompress() -> None:
        sizes = np.array([len(part) for _, part in waiting])
        begin = np.cumsum(sizes) - sizes
        counts = sizes - window + 1
        starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        names = chosen_names(np.concatenate([part for _, part in waiting]), sizes, starts, window)
        for (text, _), part in zip(waiting, np.split(names, np.cumsum(counts)[:-1]), strict=True):
            out[text].append(part)
        waiting.clear()

    held = 0
    for text, hashes in enumerate(texts):
        for _, part in _stretches(hashes[:, 0], window):
            if len(part) < window:
                continue
            waiting.append((text, part))
            held += len(part)
            if held >= STRETCH:
                recompress()
                held = 0
    if waiting:
        recompress()
    return [np.concatenate(parts) if parts else np.zeros(0, np.uint64) for parts in out]


def _id_of(digest: bytes) -> int:
    """Eight bytes of a text's digest, as a signed integer."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The digest of each text, and the text itself if ``whole``."""
    for batch in batches:
        digests = [words_digest(text.as_py()) for text in batch["text"]]
        columns = {"doc_id": batch["doc_id"]} | ({"text": batch["text"]} if whole else {})
        columns["digest"] = pa.array([d for _, d in digests], pa.binary())
        if whole:
            columns["n_words"] = pa.array([n for n, _ in digests], pa.int64())
        else:
            columns["text_id"] = pa.array([_id_of(d) for _, d in digests], pa.int64())
        yield pa.RecordBatch.from_pydict(columns)


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``GROUP`` bytes of text each, or one text."""
    sizes = np.cumsum([len(text.as_buffer() or b"") for text in batch["text"]])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP, "right")))
        yield batch.slice(at, end - at)
        at = end


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen symbols of each text; a text that comes again soon in the same task is left out."""
    seen: set[int] = set()
    for batch in batches:
        for group in _groups(batch):
            ids, texts = [], []
            for text in group["text"]:
                data = text.as_py()
                n, digest = words_digest(data)
                if n < WINDOW or (text_id := _id_of(digest)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(text_id)
                ids.append(text_id)
                texts.append(data)
            if not texts:
                continue
            # Windows side by side mostly choose the same symbol.
            names = [x[np.append(True, x[1:] != x[:-1])] for x in names_of_texts(word_hashes(texts, 1))]
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(names)), pa.array(
                np.repeat(np.array(ids, np.int64), [len(x) for x in names]))], names=["name", "text_id"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of copies and of texts without a shared symbol; the others with the windows that chose one."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()),
             pa.list_(pa.int64())]
    columns = [c.split()[0] for c in MARKED.split(", ")]
    for batch in batches:
        for group in _groups(batch):
            rows, texts, wanted = [], [], []
            for doc_id, text, digest, n, first_id, names in zip(*[group[c] for c in (
                    "doc_id", "text", "digest", "n_words", "first_id", "names")], strict=True):
                doc_id, n, names = doc_id.as_py(), n.as_py(), names.values
                if doc_id is not None and doc_id > first_id.as_py() and n >= WINDOW:
                    rows.append((doc_id, n, n, NOTHING, None, None, None, None))
                elif doc_id is None or names is None or doc_id > first_id.as_py():
                    rows.append((doc_id, n, 0, digest.as_py().hex(), None, None, None, None))
                else:
                    texts.append(text.as_py())
                    wanted.append((len(rows), names.to_numpy().view(np.uint64)))
                    rows.append((doc_id, n))
            hashes = word_hashes(texts)
            for (row, names), text, words, chosen in zip(wanted, texts, hashes, names_of_texts(hashes), strict=True):
                at = np.flatnonzero(np.isin(chosen, names)).astype(np.int32)
                one, two = fingerprints(words)
                rows[row] += (None, None, text, at, one[at].view(np.int64), two[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=columns)


def covered(places: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words the windows at ``places`` cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of texts whose windows at ``places`` go."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = []
        for doc_id, n, text, places in zip(*[batch[c] for c in ("doc_id", "n_words", "text", "places")], strict=True):
            n = n.as_py()
            at = np.zeros(0, np.int64) if places.values is None else places.values.to_numpy().astype(np.int64)
            gone, digest, seen, kept = covered(at, n), hashlib.sha256(), 0, 0
            for words in split_words(text.as_py()):
                stay = [w for w, g in zip(words, gone[seen:seen + len(words)].tolist(), strict=True) if not g]
                if stay:
                    digest.update((b" " if kept else b"") + b" ".join(stay))
                seen, kept = seen + len(words), kept + len(stay)
            rows.append((doc_id.as_py(), n, n - kept, digest.hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                         names=[c.split()[0] for c in REMOVED.split(", ")])


def marked_windows(docs: DataFrame) -> DataFrame:
    """One written row per document: MARKED plus ``row_id``; ``places`` and their fingerprints are the windows to verify."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    names = plain.where("doc_id IS NOT NULL").select("text").mapInArrow(_names, NAMES)
    # Round 1: the symbols of two different texts at least.
    shared = names.groupBy("name").agg(F.min("text_id").alias("one"), F.max("text_id").alias("other")).where("one < other")
    shared = written(shared.select("name"), "recompression-shared")
    # Round 2: back to the texts that have them.
    by_text = names.join(shared, "name", "left_semi").groupBy("text_id").agg(F.collect_set("name").alias("names"))
    copies = plain.mapInArrow(lambda it: _texts(it, False), COPIES)
    firsts = copies.groupBy("digest", "text_id").agg(F.min("doc_id").alias("first_id"))
    known = written(firsts.join(by_text, "text_id", "left").drop("text_id"), "recompression-texts")
    texts = plain.mapInArrow(lambda it: _texts(it, True), TEXTS)
    marked = texts.join(known, "digest").mapInArrow(_marked, MARKED)
    return written(marked.withColumn("row_id", F.monotonically_increasing_id()), "recompression-windows")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    marked = marked_windows(docs)
    open_ = marked.where("text IS NOT NULL")
    windows = open_.select("doc_id", "row_id", F.inline(F.arrays_zip("print1", "print2", F.col("places").alias("place"))))
    repeated = windows.groupBy("print1", "print2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    repeated = written(repeated.where("least < most").drop("most"), "recompression-repeats")
    # Round 3: back to the texts in which they go.
    gone = (windows.join(repeated, ["print1", "print2"]).where("doc_id > least")
            .groupBy("row_id").agg(F.collect_list("place").alias("places")))
    left = open_.drop("places", "print1", "print2").join(gone, "row_id", "left").select("doc_id", "n_words", "text", "places")
    return left.mapInArrow(_without, REMOVED).unionByName(
        marked.where("text IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256"))
