import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import rans_tokens as r
from ledgerline.llm import tokens

from .helpers import awkward, clashing, documents, prose

pytest.importorskip("public_tokenizers")


def as_bytes(ids):
    return np.array(ids, dtype="<u4").tobytes()


def read(raw):
    file = r.TokenFile(pa.BufferReader(raw))
    found = [file.block(k) for k in range(len(file.index))]
    return [d for ids, _, _ in found for d in ids], [x for _, runs, _ in found for x in runs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60_000), min_size=1, max_size=60), min_size=1, max_size=12))
def test_round_trip_of_any_ids(docs):
    names = [None if i == 0 else -i * 10**12 for i in range(len(docs))]
    runs = [as_bytes(d) for d in docs]
    assert read(r.file_bytes(names, runs)[0]) == (names, runs)


def test_many_blocks_checkpoints_and_skew(monkeypatch):
    monkeypatch.setattr(r, "BLOCK_TOKENS", 5000)
    monkeypatch.setattr(r, "CHECKPOINT_STEPS", 2)
    rng = np.random.default_rng(0)
    runs = [as_bytes(rng.zipf(1.3, n) % 50_000) for n in (1, 30_000, 4_000, 1_500, 9_000, 2)] + [as_bytes([7] * 9000)]
    names = list(range(len(runs)))
    raw, blocks = r.file_bytes(names, runs)
    assert blocks > 2 and read(raw) == (names, runs)


def test_files_are_small():
    ids = np.random.default_rng(0).zipf(1.3, 200_000) % 50_000
    raw, _ = r.file_bytes([1], [as_bytes(ids)])
    share = np.bincount(ids) / len(ids)
    bits = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert len(raw) < 1.05 * len(ids) * bits / 8 + 8 * (share > 0).sum() + 9 * r.LANES


def test_decoding_may_begin_at_any_checkpoint(monkeypatch):
    monkeypatch.setattr(r, "CHECKPOINT_STEPS", 4)
    places = np.random.default_rng(1).integers(0, 300, 5000)
    table = r.Table.of(np.bincount(places, minlength=300))
    words, states, at = r.encode_stream(places, table, 64)
    for k in range(len(states)):
        rest = places[k * 4 * 64:]
        got = r.decode_run(words.astype(np.uint64), states[k], int(at[k]), len(rest), table, table.slots())
        assert (got == rest).all()


def test_damage_is_found():
    raw, _ = r.file_bytes([1, 2], [as_bytes(range(500)), as_bytes([5] * 300)])
    for at in (len(raw) // 2, 40, len(raw) - 30):
        broken = bytearray(raw)
        broken[at] ^= 1
        with pytest.raises(r.CorruptFile):
            read(bytes(broken))


def test_files_give_back_all_documents_in_order(spark, monkeypatch):
    docs = documents(spark, [((i * 37) % 200, prose(i, i)) for i in range(200)])
    folder = r.write_files(clashing(docs))
    got = sorted(r.read_files(spark, folder).collect(), key=lambda x: x.doc_id)
    encode, start = tokens.encoder(tokens.tokenizer_path()), 0
    texts = {x.doc_id: x.text for x in docs.collect()}
    for x in got:
        want = as_bytes(encode.tokenizer.encode(texts[x.doc_id], add_special_tokens=False).ids + [r.END_ID])
        assert (x.start, x.n_tokens, bytes(x.ids)) == (start, len(want) // 4, want)
        start += x.n_tokens
    assert len(got) == 200


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = r.read_files(spark, r.write_files(docs)).collect()
    assert len(got) == docs.count()
    starts = sorted((x.start, x.n_tokens) for x in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert r.read_files(spark, r.write_files(docs.limit(0))).collect() == []


def test_encoder_equals_the_tokenizer_on_any_text():
    import random

    rng, e = random.Random(5), tokens.encoder(tokens.tokenizer_path())
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "é", "漢字", "1", "23", ".", "!!", "'s", " x", "\x1c", "\xa0",
             "　", "<|endoftext|>", "\0", "-", "\r\n", "½", "😀", "\x85", " ", "​"]
    texts = ["", " ", "\n", "a ", "\na"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    got = e.encode(texts)
    assert got == [as_bytes(e.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_added_tokens_have_the_ids_of_the_tokenizer_file():
    from tokenizers import Tokenizer

    fresh, e = Tokenizer.from_file(tokens.tokenizer_path()), tokens.TextEncoder(tokens.tokenizer_path())
    texts = ["ab <|endoftext|> cd", "<|endoftext|>", "a<|endoftext|>\n<|endoftext|> b", "<|endoftext |>", "plain words\nonly"]
    got = e.encode(texts) + e.encode(texts)
    assert got == [as_bytes(fresh.encode(t, add_special_tokens=False).ids) for t in texts * 2]
    assert np.frombuffer(got[0], "<u4").tolist() == [397, 220, 50256, 22927]


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    e = tokens.TextEncoder(tokens.tokenizer_path())
    for seed in range(6):
        texts = [prose(seed * 10 + i, 60, 90) for i in range(4)]
        assert e.encode(texts) == [as_bytes(e.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pieces_of_plain_texts_are_not_looked_at_one_by_one(monkeypatch):
    import random

    monkeypatch.setattr(tokens, "_plain", lambda piece: pytest.fail("a look at one piece"))
    rng, e = random.Random(6), tokens.TextEncoder(tokens.tokenizer_path())
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "é", "漢字", "1", "23", ".", "!!", "'s", " x", "\0", "-", "½", "😀", "\u200b"]
    texts = ["", " ", "\n", "a ", "\na", "\0", "\0\n"] + [
        "".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)]
    assert e.encode(texts) == [as_bytes(e.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
