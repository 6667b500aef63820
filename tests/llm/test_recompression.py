import hashlib
import random

import numpy as np

from ledgerline.llm import recompression

from .helpers import awkward, clashing, documents, prose, words_of


def expected(rows, window=13):
    least, out = {}, []
    for doc_id, text in rows:
        words = words_of(text)
        for p in range(len(words) - window + 1 if doc_id is not None else 0):
            key = tuple(words[p:p + window])
            least[key] = min(least.get(key, doc_id), doc_id)
    for doc_id, text in rows:
        words = words_of(text)
        gone = [False] * len(words)
        for p in range(len(words) - window + 1 if doc_id is not None else 0):
            if least[tuple(words[p:p + window])] < doc_id:
                gone[p:p + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def removed(docs):
    found = recompression.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
    return sorted(map(tuple, found.collect()), key=str)


def plagiarised(seed, n_docs=60):
    """Texts with shared passages, near copies, exact copies, runs of one word and shared runs."""
    rng = random.Random(seed)
    passages = [prose(seed * 100 + i, rng.randrange(5, 60), 60) for i in range(8)]
    rows = []
    for doc_id in range(n_docs):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice([prose(rng.random(), rng.randrange(0, 40), 60), rng.choice(passages),
                                     "x " * rng.randrange(0, 40), "x y " * rng.randrange(0, 20)]))
        rows.append((doc_id, " ".join(parts)))
    rows += [(n_docs + i, rows[rng.randrange(n_docs)][1]) for i in range(10)]
    near = [(n_docs + 20 + i, text.replace("w7", "changed")) for i, (_, text) in enumerate(rows[:15])]
    return rows + near


def test_passages_copies_and_runs_match_brute_force(spark):
    for seed in (1, 2):
        rows = plagiarised(seed)
        want = expected(rows)
        assert sum(r[2] for r in want) > 500
        assert removed(documents(spark, rows)) == want


def test_awkward_rows_match_brute_force(spark):
    extra = documents(spark, [(70, prose(1, 40)), (70, prose(1, 40)), (71, prose(1, 40) + " end"), (None, prose(1, 40)),
                              (72, "é ß 漢字 " * 9), (73, "\x0b".join("é ß 漢字".split(" ") * 9)),
                              (74, "z" * 5000 + " " + prose(3, 20)), (75, "y" * 5000 + " " + prose(3, 20))])
    docs = awkward(spark).unionByName(extra)
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert removed(docs) == want
    assert removed(clashing(docs)) == want


def test_stretches_and_pieces_change_nothing(spark, monkeypatch):
    rows = plagiarised(3, 20)
    rows.append((500, " ".join(text for _, text in rows)))
    texts = [text.encode() for _, text in rows]
    names = recompression.names_of_texts(recompression.word_hashes(texts))
    monkeypatch.setattr(recompression, "STRETCH", 37)
    monkeypatch.setattr(recompression, "PIECE", 50)
    again = recompression.names_of_texts(recompression.word_hashes(texts))
    assert all((a == b).all() for a, b in zip(names, again, strict=True))


def test_equal_windows_choose_equal_symbols():
    """The promise that loses no repeat: a window's name depends on its own words alone."""
    rng = random.Random(5)
    for _ in range(300):
        window = [rng.choice("abcd") * rng.choice([1, 1, 1, 2]) for _ in range(13)]
        if rng.random() < 0.3:
            window[3:10] = ["a"] * 7
        names = set()
        for _ in range(4):
            before = [rng.choice("abcd") for _ in range(rng.randrange(30))]
            after = [rng.choice("abcd") for _ in range(rng.randrange(30))]
            text = " ".join(before + window + after).encode()
            names.add(int(recompression.names_of_texts(recompression.word_hashes([text]))[0][len(before)]))
        assert len(names) == 1


def test_contexts_decide_symbols():
    """The words from low up to high give the same symbol wherever they stand."""
    rng = np.random.default_rng(6)
    vocabulary = rng.integers(1, 1 << 63, 4).astype(np.uint64)
    texts = [rng.integers(0, 4, rng.integers(1, 30)).tolist() for _ in range(200)]
    rounds = [[] for _ in range(recompression.ROUNDS + 1)]
    for ids in texts:
        found = recompression.Symbols.of_words(vocabulary[ids], np.array([len(ids)])).runs()
        for r in range(recompression.ROUNDS + 1):
            rounds[r].append(set(zip(found.names.tolist(), found.low.tolist(), found.high.tolist(), strict=True)))
            if r < recompression.ROUNDS:
                found = found.pairs(recompression._SALTS[2 + r])
    for symbols in rounds:
        contexts = {(name, tuple(ids[low:high])) for ids, found in zip(texts, symbols, strict=True)
                    for name, low, high in found if low >= 0 and high <= len(ids)}
        assert len(contexts) > 50
        for name, words in contexts:
            for ids, found in zip(texts[:60], symbols, strict=False):
                for at in range(len(ids) - len(words) + 1):
                    if tuple(ids[at:at + len(words)]) == words:
                        assert (name, at, at + len(words)) in found


def test_word_hashes_tell_words_apart():
    texts = [b"", b" \t ", b"ab ba aab aba baa " + b"q" * 100 + b" " + b"q" * 101]
    one, two, three = recompression.word_hashes(texts)
    assert len(one) == len(two) == 0 and len(three) == 7
    assert len({tuple(x) for x in three.tolist()}) == 7


def test_hot_passage_and_empty_table(spark):
    passage = prose(9, 30, 1000)
    rows = [(i, f"a{i} {passage} b{i}") for i in range(600)]
    found = removed(documents(spark, rows))
    assert [r[2] for r in sorted(found)] == [0] + [30] * 599
    assert removed(documents(spark, rows).limit(0)) == []
