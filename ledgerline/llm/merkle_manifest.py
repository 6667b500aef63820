"""Merkle manifest of a document table by time-forward processing.

Every row is a leaf; every source has a tree over its leaves in order of
doc_id, and a top tree stands over the sources' subroots. A node is labelled
(level, tree, run): ``ARITY`` consecutive nodes of a level are the children of
one node of the next level. Digests are hex SHA-256, inputs are concatenated.

Time-forward processing goes through the nodes in the order of their labels.
A node sends its digest, as a message, to the label of its parent; the
priority queue that keeps messages until their label is due is external: the
messages of a level are written to the shared folder, Spark's shuffle brings
those of one label together (at most ``ARITY``), and a node whose tree is
already down to one waits in the written tables until the top tree takes it.
Every level is a sixteenth of the one before, so the rounds cost about as much
as the first. A second sweep runs through the labels in reverse: a parent
sends to its children the proof of what lies above them, and each child puts
its own siblings before it. Proofs of inner nodes travel once per run of
sixteen; those of the leaves are made where they are read and never shuffled.

Ranks in a tree come from a range partition by (source, doc_id, leaf) with
totals carried over its partitions, so a source with a third of all rows is
many tasks. Nothing passes through the driver but the size of the largest tree.

Defined results: a null in any of the five columns is written as ``-``. Null
sources are a tree of their own, which comes first; null doc_ids come first in
their tree. Rows with equal doc_id are leaves of their own, in order of their
digests; wholly repeated rows are equal leaves side by side. An empty table
gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import written

ARITY = 16
# The columns of a leaf, in this order.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _framed(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows give the same input."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf of a row of ``docs``, or the one that it would have with another ``text``."""
    values = {c: docs[c] for c in LEAF_COLUMNS} | ({} if text is None else {"text": text})
    return sha256(*[_framed(values[c]) for c in LEAF_COLUMNS])


def _ranked(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` (tree, ...) plus ``pos``, the rank in the tree by ``order``, and ``n``, the size of the tree.

    Also returns the largest ``n``.
    """
    by = [F.col(c).asc_nulls_first() for c in ["tree", *order]]
    dealt = written(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), name)
    totals = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("tree", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"),
                           F.sum("rows").over(tree).alias("n"))
    inside = Window.partitionBy("tree", "part").orderBy(*by[1:])
    ranked = (dealt.withColumn("at", F.row_number().over(inside) - 1).join(totals, ["tree", "part"])
              .withColumn("pos", F.col("base") + F.col("at")).drop("part", "at", "base"))
    return ranked, totals.agg(F.max("n")).first()[0] or 0


def _climb(nodes: DataFrame, largest: int, payload: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The forward sweep over ``nodes`` (tree, pos, n, digest, payload...), at most ``largest`` in a tree.

    Returns the runs of each level (tree, run, slots: the children in order)
    and the root of each tree (tree, height, digest, and the payload where a
    tree is one node).
    """
    payload_of = {f.name: f.dataType for f in nodes.schema if f.name in payload}
    levels: list[DataFrame] = []
    roots: DataFrame | None = None
    while True:
        done = nodes.where("n = 1").select(
            "tree", F.lit(len(levels)).alias("height"), "digest",
            *[(F.col(c) if c in nodes.columns else F.lit(None).cast(kind)).alias(c) for c, kind in payload_of.items()])
        roots = done if roots is None else roots.unionByName(done)
        if largest <= 1:
            return levels, roots
        slot = F.struct("pos", "digest", *[c for c in payload if c in nodes.columns])
        runs = written(nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("run")).agg(
            F.array_sort(F.collect_list(slot)).alias("slots"), F.first("n").alias("n")), f"{name}-level{len(levels)}")
        levels.append(runs)
        nodes = runs.select("tree", F.col("run").alias("pos"),
                            F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"),
                            sha256(F.array_join("slots.digest", "")).alias("digest"))
        largest = -(-largest // ARITY)


def _descend(levels: list[DataFrame], roots: DataFrame, carried: list[str], payload: list[str]) -> DataFrame:
    """The reversed sweep: level-0 nodes with the ``path`` to where ``roots`` begin (tree, height, path, carried...).

    ``path``: from the node upwards, the digests before and after it in its run.
    """
    above = roots.where(F.col("height") == len(levels)).select("tree", F.lit(0).cast("long").alias("pos"), "path", *carried)
    for level in range(len(levels) - 1, -1, -1):
        around = F.struct(F.array_join(F.slice("slots.digest", 1, F.col("i")), "").alias("before"),
                          F.array_join(F.slice("slots.digest", F.col("i") + 2, ARITY), "").alias("after"))
        met = levels[level].join(above.withColumnRenamed("pos", "run"), ["tree", "run"])
        each = met.select("tree", "slots", "path", *carried, F.posexplode("slots").alias("i", "slot"))
        nodes = each.select("tree", F.col("slot.pos").alias("pos"), F.concat(F.array(around), "path").alias("path"), *carried,
                            *([F.col("slot.digest").alias("digest")] + [F.col(f"slot.{c}") for c in payload] if level == 0 else []))
        if level:
            above = nodes.unionByName(roots.where(F.col("height") == level).select(
                "tree", F.lit(0).cast("long").alias("pos"), "path", *carried))
        else:
            above = nodes
    columns = ["tree", "digest", "path", *carried, *payload]
    alone = roots.where("height = 0").select(*columns)  # trees of one node
    return above.select(*columns).unionByName(alone) if levels else alone


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return sha256(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda digest, s: sha256(s["before"], digest, s["after"]))


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, source, leaf, subroot, root, path, and the ``carried`` columns of its row.

    ``path``: array of (before, after), the concatenated digests of the leaf's
    siblings in the leaf's run, then its parent's, up to the root.
    """
    carried = carried or {}
    extra = {f"c_{c}": column for c, column in carried.items()}
    leaves = docs.select(
        F.struct(docs["source"].isNotNull().alias("known"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("name"))
        .alias("tree"), docs["doc_id"].alias("doc_id"), leaf_digest(docs).alias("digest"),
        *[column.alias(c) for c, column in extra.items()])
    leaves = written(leaves, "manifest-leaves")  # texts are read and hashed once; the sort samples this narrow table
    payload = ["doc_id", *extra]
    levels, subroots = _climb(*_ranked(leaves, ["doc_id", "digest"], "manifest-ranks"), payload, "manifest")
    subroots = written(subroots, "manifest-subroots")

    top = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("source_tree"), "digest")
    top_levels, top_root = _climb(*_ranked(top, ["source_tree"], "manifest-sources"), ["source_tree"], "manifest-top")
    top_root = top_root.select("*", F.col("digest").alias("root"),
                               F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    over = _descend(top_levels, top_root, ["root"], ["source_tree"])
    over = over.select(F.col("source_tree").alias("tree"), "path", "root", F.col("digest").alias("subroot"))
    start = subroots.join(over, "tree")
    found = _descend(levels, start, ["root", "subroot"], payload)
    return found.select("doc_id", F.when(F.col("tree.known"), F.col("tree.name")).alias("source"),
                        F.col("digest").alias("leaf"), "subroot", "root", "path",
                        *[F.col(c).alias(c[2:]) for c in extra])


def is_tampered(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the id in decimal; a null id is never tampered with."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest, and the root that each leaf gives after some texts were tampered with (A-Z to lower case)."""
    small = F.translate(docs["text"].cast("string"), CAPITALS, SMALL)
    changed = F.when(is_tampered(docs["doc_id"]), leaf_digest(docs, small))
    found = manifest(docs, {"changed": changed})
    folded = found.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
