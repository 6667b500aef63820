import math
import re
from collections import Counter

import pytest
import xxhash

from ledgerline.llm import quality_llr as q

from .helpers import awkward, clashing, documents, prose, words_of

LABELS = "doc_id long, quality int, toxic int"


def hashed(token):
    value = xxhash.xxh64_intdigest(token.encode(), 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def buckets(text):
    h = [hashed(t) for t in words_of(text)]
    marks = re.findall(r"(?:[^\w\s]|_){2,}|(?<!\S)(?:[^\w\s]|_)(?!\S)", text)
    mask = q.BUCKETS - 1
    return ([x & mask for x in h] + [((a >> 20) ^ (b >> 7)) & mask for a, b in zip(h, h[1:])]
            + [hashed(m) & mask for m in marks])


def base_counts(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), sum(text.count(s) for s in q.SYMBOLS), len(lines) - len(set(lines)),
            len(covered))


def rows_of(scored):
    return {r.doc_id: r.quality_rules for r in scored.collect()}


def corpus(spark):
    good = [(i, prose(i, 80) + ".") for i in range(20)]
    junk = [(100 + i, " ".join(f"{w}&&&" for w in prose(i, 80).split())) for i in range(5)]
    odd = [(200, None), (201, ""), (202, "a b c " * 40), (203, "a b c\n" * 30), (204, "% $\n\n x\ty"), (205, "a b a b a b")]
    docs = documents(spark, good + junk + odd)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100, 0, 0), (None, 1, 0), (101, None, 0)], LABELS)
    return docs, labels


def test_counts_and_ratio_match_brute_force(spark):
    docs, labels = corpus(spark)
    got = rows_of(q.score_documents(docs, labels))
    texts = {r.doc_id: r.text for r in docs.collect()}
    raw, target = Counter(), Counter()
    for i, text in texts.items():
        raw.update(buckets(text or ""))
        target.update(buckets(text) if i < 20 else [])
    scale = target.total() / raw.total()
    weight = {b: math.log((target[b] + q.ALPHA) / (raw[b] * scale + q.ALPHA)) for b in raw}
    for i, text in texts.items():
        r, want = got[i], base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        mine = buckets(text or "")
        assert r.llr == pytest.approx(sum(weight[b] for b in mine) / max(1, len(mine)), abs=1e-9)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.llr >= q.THRESHOLD)
    assert all(got[i].kept for i in range(20)) and not any(got[100 + i].kept for i in range(5))


def test_stage_keeps_rows_and_columns(spark):
    docs, labels = corpus(spark)
    kept = q.keep_documents(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))


def test_awkward_rows_no_labels_and_empty(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], LABELS)
    got = q.score_documents(clashing(docs), none).collect()
    assert len(got) == docs.count() and all(r.quality_rules["llr"] == 0 for r in got)
    assert q.score_documents(docs.limit(0), none).collect() == []
