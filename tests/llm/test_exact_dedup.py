import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup

from .helpers import awkward, clashing, documents


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(norm.encode()).hexdigest()))
            kept = kept or i == keep
    return sorted(out, key=str)


def marked(docs, **kw):
    found = exact_dedup.mark_duplicates(docs, **kw)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in found.collect()), key=str)


def test_awkward_rows_match_brute_force(spark):
    docs = awkward(spark)
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert marked(docs) == want
    assert marked(clashing(docs)) == want


def test_a_weak_digest_never_merges_texts(spark):
    docs = documents(spark, [(i, f"text {i % 7}") for i in range(60)])
    weak = marked(docs, digest=lambda text: F.lit(b"same"))
    strong = marked(docs)
    assert [r[:4] for r in weak] == [r[:4] for r in strong]
    assert sum(r[3] for r in strong) == 7


def test_hot_group_is_spread_over_salts(spark):
    docs = documents(spark, [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)])
    groups = exact_dedup.duplicate_groups(docs).where("group_size > 1").collect()
    assert len(groups) == 1 and groups[0].keep_id == 1 and groups[0].group_size == 2000
    assert bin(groups[0].salts).count("1") == exact_dedup.SALTS


def test_drop_keeps_one_row_per_text_with_all_columns(spark):
    docs = clashing(awkward(spark))
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in left.collect()]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()})
    assert [r.doc_id for r in left.where("text like 'one%'").collect()] == [1]


def test_empty_table(spark):
    empty = awkward(spark).limit(0)
    assert exact_dedup.mark_duplicates(empty).collect() == []
    assert exact_dedup.drop_duplicates(empty).collect() == []
