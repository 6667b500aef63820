import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import source_mix as m

from .helpers import awkward, clashing, documents, prose, words_of


def seat_by_seat(weights, seats, most):
    got = [0] * len(weights)
    for _ in range(seats):
        quotients = [w / (2 * a + 1) if a < c and w > 0 else -1 for w, a, c in zip(weights, got, most)]
        if max(quotients, default=-1) < 0:
            break
        got[quotients.index(max(quotients))] += 1
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 60), st.integers(1, 40))
def test_apportionment_equals_highest_quotients_seat_by_seat(weights, seats, cap):
    most = [cap] * len(weights)
    assert m.sainte_lague([float(w) for w in weights], seats, most) == seat_by_seat(weights, seats, most)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_share_everything_and_respect_the_cap(sizes):
    targets = m.capped_targets(sizes, [m.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert sum(targets) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s + 1e-9 for t, s in zip(targets, sizes))


def corpus(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randrange(0, 60)), "en", rng.choice(["s0"] * 6 + ["s1", "é", "", None])) for i in range(300)]
    return documents(spark, rows)


def test_taken_words_meet_the_targets(spark):
    docs = corpus(spark)
    mixed, plan = m.mix_documents(docs)
    got = mixed.collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {r.doc_id: len(words_of(r.text)) for r in docs.collect()}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    sizes = [sum(size[i] for i in size if source[i] == s) for s in names]
    targets = m.capped_targets(sizes, [m.WEIGHTS[i % 3] for i in range(len(names))])
    taken = Counter()
    assert len(got) == 300
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        assert (r.source_size, r.target) == (sizes[names.index(r.source)], pytest.approx(targets[names.index(r.source)]))
        taken[r.source] += r.taken
    for s, t in zip(names, targets):
        assert abs(taken[s] - t) <= 2 * m.BLOCK_WORDS
    again = {r.doc_id: r.taken for r in m.mix_documents(docs.repartition(7))[0].collect()}
    assert again == {r.doc_id: r.taken for r in got}
    quotas = plan.shard_quotas(spark).collect()
    whole = Counter()
    for r in quotas:
        whole[r.source] += r.blocks
    assert [whole[s] for s in plan.sources] == plan.blocks


def test_shard_quotas_add_up_over_many_shards(spark):
    plan = m.MixPlan(["a", "b", "c"], [500, 300, 200], [500.0, 300.0, 200.0], [50, 30, 20], 10, 7)
    rows = plan.shard_quotas(spark).collect()
    per_shard, next_block = Counter(), defaultdict(int)
    for r in sorted(rows, key=lambda r: r.shard):
        per_shard[r.shard] += r.blocks
        assert r.first_block == next_block[r.source]
        next_block[r.source] += r.blocks
    assert dict(next_block) == {"a": 50, "b": 30, "c": 20}
    assert [per_shard[i] for i in range(15)] == [7] * 14 + [2]


def test_rows_of_the_mix(spark):
    docs = clashing(corpus(spark))
    rows = m.mixed_rows(docs)
    assert rows.columns == docs.columns
    words = Counter()
    for r in rows.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] += len(words_of(r.text))
    taken = {r.doc_id: r.taken for r in m.mix_documents(docs)[0].collect() if r.taken}
    assert words == taken


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = m.mix_documents(clashing(docs))[0].collect()
    assert len(got) == docs.count()
    assert all(r.taken == 0 for r in got if r.size == 0)
    total = sum(len(words_of(r.text)) for r in m.mixed_rows(docs).collect())
    assert total == sum(r.taken for r in m.mix_documents(docs)[0].collect())
    assert m.mix_documents(docs.limit(0))[0].collect() == []
    assert m.mixed_rows(docs.limit(0)).collect() == []
