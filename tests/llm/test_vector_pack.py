from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import tokens
from ledgerline.llm import vector_pack as v

from .helpers import awkward, clashing, documents, prose

pytest.importorskip("public_tokenizers")


def check(loss, limits, pieces):
    at = defaultdict(int)
    used = defaultdict(lambda: [0, 0, 0])
    for i, start, length, sequence, offset in sorted(pieces):
        assert length > 0 and start == at[i]
        at[i] += length
    assert all(at[i] == len(run) - 1 for i, run in enumerate(loss))
    for i, start, length, sequence, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == used[sequence][0]
        used[sequence][0] += length
        used[sequence][1] += 1
        used[sequence][2] += int(loss[i][start + length] - loss[i][start])
    assert all(u <= m for use in used.values() for u, m in zip(use, limits))
    return used


def runs(sizes, flags):
    return [np.concatenate([[0], np.cumsum([(k * 7 + i) % flags == 0 for k in range(n)])]) for i, n in enumerate(sizes)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=25), st.integers(1, 4),
       st.tuples(st.integers(1, 32), st.integers(1, 5), st.integers(1, 20)))
def test_every_limit_holds_and_every_token_is_placed_once(sizes, flags, limits):
    loss = runs(sizes, flags)
    check(loss, limits, v.pack_vectors(loss, limits))


def test_only_the_last_sequence_has_room(spark):
    loss = [np.arange(n + 1) for n in (700, 1500, 90, 5000, 3, 2048, 1200, 800)]
    used = check(loss, (2048, 64, 2048), v.pack_vectors(loss, (2048, 64, 2048)))
    assert sum(u[0] < 2048 for u in used.values()) <= 1


def test_dot_product_prefers_what_is_left():
    # Room for loss is scarce, so the piece with few loss tokens goes beside the one with many.
    loss = [np.arange(51), np.concatenate([np.zeros(50, int), [1]]), np.arange(51)]
    pieces = v.pack_vectors(loss, (100, 10, 60))
    first = {p[0] for p in pieces if p[3] == 0}
    assert len(first) == 2 and 1 in first


def test_pieces_hold_the_ids(spark):
    docs = documents(spark, [(i, prose(i, 40 * i)) for i in range(40)])
    got = v.pack_documents(clashing(docs)).collect()
    encode = tokens.encoder(tokens.tokenizer_path())
    whole = defaultdict(dict)
    for r in got:
        whole[r.example][r.start] = bytes(r.ids)
        assert len(r.ids) == 4 * r.length and r.loss_tokens == r.length
    for r in docs.collect():
        want = np.array(encode.tokenizer.encode(r.text, add_special_tokens=False).ids + [v.END_ID], dtype="<u4").tobytes()
        assert b"".join(whole[r.doc_id][s] for s in sorted(whole[r.doc_id])) == want
    again = {(r.example, r.start, r.sequence_id, r.offset) for r in v.pack_documents(docs.repartition(5)).collect()}
    assert again == {(r.example, r.start, r.sequence_id, r.offset) for r in got}


def test_conversations_bear_loss_in_assistant_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "good day"), (1, 2, None, None),
                                   (2, 0, "user", "only me")], "conv_id long, turn long, role string, text string")
    got = {r.example: r for r in v.pack_conversations(turns).collect()}
    encode = tokens.encoder(tokens.tokenizer_path())
    n = lambda text: len(encode.encode([text])[0]) // 4
    assert got[1].loss_tokens == n("good day") + 1 and got[2].loss_tokens == 1
    assert got[1].length == n("hello there") + n("good day") + 1


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = v.pack_documents(docs)
    assert got.where("start = 0").count() == docs.count()
    assert v.pack_documents(docs.limit(0)).collect() == []


def test_encoder_keeps_what_is_met_in_most_runs(monkeypatch):
    e, learned = tokens.TextEncoder(tokens.tokenizer_path(), 100), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda new: learned.append(set(new)) or learn(new))
    often = [f"often{k}" for k in range(20)]
    e.encode([" ".join(f"first{k}" for k in range(80))])
    for run in range(12):
        text = " ".join(["x", *often, *(f"once{run}n{k}" for k in range(30))])
        assert e.encode([text]) == [np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert sum(len(new & set(often)) for new in learned[3:]) == 0 and len(e.place) <= 100
