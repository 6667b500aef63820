import hashlib
import zlib

import duckdb

from ledgerline.llm import merkle_manifest
from ledgerline.llm.oracle import ORACLES

from .helpers import awkward, clashing, documents

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Root, and for each leaf the runs above it as (before, after)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, path in enumerate(paths):
            run, place = at[i] // 16 * 16, at[i] % 16
            path.append(("".join(level[run:run + place]), "".join(level[run + place + 1:run + 16])))
            at[i] //= 16
        level = [h(*level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def expected(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row.source, []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for source in sources:
        group = sorted(by_source[source], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        parts.append((group, *tree([leaf_of(r, r.text) for r in group])))
    root, above = tree([p[1] for p in parts])
    out = []
    for (group, subroot, paths), over in zip(parts, above, strict=True):
        for row, path in zip(group, paths, strict=True):
            leaf, text = leaf_of(row, row.text), row.text
            if row.doc_id is not None and text is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(row, text)
            for before, after in path + over:
                folded = h(before, folded, after)
            out.append((row.doc_id, leaf, subroot, root, h(*[b + a for b, a in path + over]), folded, folded == root))
    return sorted(out, key=str)


def audited(docs):
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle_manifest.audit(docs).collect()), key=str)


def test_awkward_rows_match_brute_force(spark):
    docs = awkward(spark)
    want = expected(docs.collect())
    assert audited(docs) == want
    assert audited(clashing(docs).toDF(*docs.columns, *[f"pos{i}" for i in range(16)], "tree")) == want


def test_trees_of_every_height_and_the_sql(spark):
    # Sources of 1, 2, 16, 17, 257 and 300 leaves; capitals in some texts; 20 sources make two top levels.
    sizes = [("s%02d" % i, 1 + i % 3) for i in range(15)] + [(None, 17), ("", 16), ("Ä", 257), ("b", 300), ("c", 33)]
    rows, doc_id = [], 0
    for source, n in sizes:
        for _ in range(n):
            rows.append((doc_id * 7 % 1009, f"Text {doc_id} ABC É", "en" if doc_id % 3 else None, source))
            doc_id += 1
    docs = documents(spark, rows)
    want = expected(docs.collect())
    assert audited(docs) == want
    assert {r[6] for r in want} == {True, False} and len({r[3] for r in want}) == 1
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_merkle_manifest']})").fetchall()
    assert sorted(found, key=str) == want


def test_a_lone_leaf_is_the_root(spark):
    docs = documents(spark, [(3, "Alone", "en", "a")])
    (row,) = merkle_manifest.audit(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == h("")


def test_the_path_of_the_operator_proves_each_leaf(spark):
    docs = documents(spark, [(i, f"t{i}", "en", f"s{i % 3}") for i in range(60)])
    for row in merkle_manifest.manifest(docs).collect():
        digest = row.leaf
        for step in row.path:
            digest = h(step.before, digest, step.after)
        assert digest == row.root
        assert row.source == f"s{row.doc_id % 3}"


def test_empty_table(spark):
    assert merkle_manifest.audit(awkward(spark).limit(0)).collect() == []
