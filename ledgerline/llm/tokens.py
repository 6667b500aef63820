"""Token ids of whole texts, by a fixed public tokenizer, inside Arrow batches.

A byte-level BPE of the usual kind splits a text before it merges: no token
spans from a visible character to white space after it. White space with the
visible characters that follow it, up to the next white space, can therefore
be encoded on its own, and the ids of a text are the ids of such pieces in a
row. Pieces repeat a lot: a batch of texts is split and its distinct pieces are
found by Arrow, each worker remembers the ids of pieces it has met (a bounded
number), and the tokenizer sees only new ones. Texts with other than single
blanks and line feeds between their words go to the tokenizer whole, as do texts
in which an added token of the tokenizer file (such as <|endoftext|>) stands: it
gets the id that the file gives it.
"""

from __future__ import annotations

import re
from itertools import chain, compress, repeat

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
# Pieces whose ids a worker keeps; beyond it, the half that it met in the fewest runs of texts goes.
KEPT_PIECES = 800_000
# Texts are encoded together up to this many characters.
BATCH_CHARS = 4_000_000
# Words that go to the tokenizer as one text (its working memory is many times the text, and should stay in the cache).
JOINED_WORDS = 200

# Marks the first piece of a text, which has no blank before it.
_FIRST = "\0"
_FIRST_OR_LINE = (_FIRST, "\n")
_EMPTY = ("", _FIRST, "\n")
_encoders: dict[tuple[str, int | None], TextEncoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The part of a count of runs that is left when others go: what was met long ago makes room.
FADE = 0.75

# White space other than blanks and line feeds.
_OTHER_SPACE = re.compile(r"[^\S \n]")
# White space to Python, not to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")


def _plain(piece: str) -> bool:
    """Whether a piece, found between blanks, may be encoded on its own."""
    body = piece[1:] if piece[:1] == "\n" else piece
    return body.isalpha() or bool(body and not body[0].isspace() and not body[-1].isspace() and not _ODD.search(body))


class TextEncoder:
    """texts -> little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, kept: int | None = None):
        import os

        self.kept = KEPT_PIECES if kept is None else kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that begin with a blank
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.place: dict[str, int] = {}  # piece -> row of the tables below
        self.sizes = np.zeros(0, dtype=np.int64)  # ids of a piece; -1: not to be encoded on its own
        self.starts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")
        self.met = np.zeros(0, dtype=np.float32)  # runs of texts that had the piece

    def _has_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words with a blank before each, many as one text: only first ids begin with a blank."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for begin in range(0, len(words), JOINED_WORDS):
            part = words[begin:begin + JOINED_WORDS]
            joined, _ = self._encode([" " + " ".join(part)])
            at = np.flatnonzero(self.opens[joined])
            if len(at) == len(part):
                ids.append(joined)
                sizes.append(np.diff(np.append(at, len(joined))))
            else:  # another kind of vocabulary
                joined, own = self._encode([f" {w}" for w in part])
                ids.append(joined)
                sizes.append(own)
        return np.concatenate(ids), np.concatenate(sizes)

    def _forget(self) -> np.ndarray:
        """Keeps the half of the room that was met in most runs; the new row of each row, -1 for those that go."""
        rows = np.sort(np.argsort(-self.met, kind="stable")[:self.kept // 2])
        moved = np.full(len(self.met), -1, dtype=np.int64)
        moved[rows] = np.arange(len(rows))
        self.place = dict(zip(compress(self.place, (moved >= 0).tolist()), range(len(rows)), strict=True))
        sizes = np.maximum(self.sizes[rows], 0)
        starts = np.cumsum(sizes) - sizes
        self.ids = self.ids[np.repeat(self.starts[rows] - starts, sizes) + np.arange(int(sizes.sum()))]
        self.sizes, self.starts, self.met = self.sizes[rows], starts, self.met[rows] * np.float32(FADE)
        return moved

    def _learn(self, new: list[str]) -> np.ndarray:
        """Rows of the tables for new pieces."""
        # Those after a blank, then those after a line feed or nothing, then those not to be encoded alone.
        joined = " ".join(new)  # one look for all of them
        if _OTHER_SPACE.search(joined):
            kind = np.array([0 if p.isalpha() else 2 if not _plain(p.removeprefix(_FIRST)) else int(p[0] in "\0\n")
                             for p in new], dtype=np.int8)
        else:  # a line feed stands first in a piece or nowhere, so all but empty ones are plain
            kind = np.fromiter([2 if p in _EMPTY else p[0] in _FIRST_OR_LINE for p in new], np.int8, len(new))
        if self._has_added(joined):
            kind[[self._has_added(p) for p in new]] = 2
        order = np.argsort(kind, kind="stable")
        ordered = [new[i] for i in order]
        a, b = np.searchsorted(kind[order], [1, 2])
        words, word_sizes = self._encode_words(ordered[:a])
        rest, rest_sizes = self._encode([p.removeprefix(_FIRST) for p in ordered[a:b]])
        sizes = np.concatenate([word_sizes, rest_sizes, np.full(len(new) - b, -1, dtype=np.int64)])
        first = len(self.sizes)
        ends = len(self.ids) + np.cumsum(np.maximum(sizes, 0))
        self.place.update(zip(ordered, range(first, first + len(new)), strict=True))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.concatenate([self.starts, ends - np.maximum(sizes, 0)])
        self.ids = np.concatenate([self.ids, words, rest])
        self.met = np.concatenate([self.met, np.ones(len(new), dtype=np.float32)])
        rows = np.empty(len(new), dtype=np.int64)
        rows[order] = np.arange(first, first + len(new))
        return rows

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):  # in runs of bounded length, or one text
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            out += self._run(texts[at:end])
            at = end
        return out

    def _run(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pa.array([f"{_FIRST}{t.replace(chr(10), ' ' + chr(10))}" for t in texts],
                                          pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.met[known[known >= 0]] += 1
        new = np.flatnonzero(known < 0)
        if len(self.place) + len(new) > self.kept and len(self.place):  # those that go are learned anew
            known = np.where(known < 0, -1, self._forget()[known])
            new = np.flatnonzero(known < 0)
        known[new] = self._learn([pieces[i] for i in new])
        rows = known[coded.indices.to_numpy()]
        sizes = self.sizes[rows]
        bounds = split.offsets.to_numpy()
        odd = np.zeros(len(texts), dtype=bool)
        odd[np.searchsorted(bounds, np.flatnonzero(sizes < 0), side="right") - 1] = True
        sizes = np.maximum(sizes, 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(self.starts[rows] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        marks = (ends[bounds] * 4).tolist()
        out = [flat[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]
        for i in np.flatnonzero(odd | np.array([_FIRST in t or self._has_added(t) for t in texts], dtype=bool)):
            out[i] = self._encode([texts[i]])[0].tobytes()
        return out


def encoder(path: str, kept: int | None = None) -> TextEncoder:
    """The worker's encoder for a tokenizer file, which keeps ``kept`` pieces."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = TextEncoder(path, kept)
    return _encoders[path, kept]
