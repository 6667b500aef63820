import inspect
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerline.llm import registry, source_mix, tokens

from .helpers import DOCS, awkward, prose, words_of
from .test_jaccard_forest import brute_force

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with clean, junk, equal and near-equal texts, and labels."""
    rows = []
    for i in range(60):
        rows.append((i, prose(i, 70 + i), "en", f"s{i % 4}", None))
    for i in range(5):
        rows.append((100 + i, prose(i, 70 + i).replace(" ", "\n"), "en", "s0", None))  # equal but for white space
        rows.append((200 + i, prose(i, 70 + i) + " end", "en", None, None))  # nearly equal
        rows.append((300 + i, " ".join(f"{w}&&&" for w in prose(i, 90).split()), "en", "s1", None))
        rows.append((400 + i, None if i else "", "en", "s1", None))
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(
        f"{at}/labels.parquet")
    return at


def test_stages_in_order_and_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        ids.append(sorted(set(r.doc_id for r in docs.collect())))
    clean = [*range(60), *range(100, 105), *range(200, 205)]
    assert ids[0] == clean
    assert ids[1] == [i for i in clean if not 100 <= i < 105]
    texts = {i: prose(i, 70 + i) for i in range(60)} | {200 + i: prose(i, 70 + i) + " end" for i in range(5)}
    assert ids[2] == sorted({c for _, c, _ in brute_force(sorted(texts.items()))}) == list(range(60))
    assert set(ids[3]) <= set(ids[2])


def test_run_packs_what_the_mix_takes(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
    taken = Counter()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in source_mix.mix_documents(docs)[0].collect():
        taken[r.doc_id] = r.taken
    encode, want = tokens.encoder(tokens.tokenizer_path()), Counter()
    for i, n in taken.items():
        words = words_of(texts[i])
        while n > 0:
            text = texts[i] if n >= len(words) else " ".join(words[:n])
            want[(i, len(encode.encode([text])[0]) // 4 + 1)] += 1
            n -= len(words)
    got, whole = Counter(), defaultdict(int)
    for r in corpus_pipeline.run(spark, folder).collect():
        assert 0 < r.length <= 2048
        got[(r.doc_id, r.doc_tokens)] += r.start == 0
        whole[(r.doc_id, r.doc_tokens)] += r.length
    assert +got == want
    assert all(whole[k] == k[1] * n for k, n in want.items())


def test_empty_table_passes(spark, folder, tmp_path):
    awkward(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered_once():
    names = list(registry.queries())
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)
    for query in registry.queries().values():
        assert not re.search(r"limit\(|sample\(|% ", inspect.getsource(query))


def test_packed_checksums(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    encode = tokens.encoder(tokens.tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    checked = 0
    for r in rows:
        ids = np.frombuffer(encode.encode([texts[r.doc_id]])[0] + np.array([1], "<u4").tobytes(), "<u4")
        if len(ids) == r.doc_tokens:
            checked += 1
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert checked
