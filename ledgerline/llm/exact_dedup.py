"""Exact duplicate removal by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after every run of ASCII white space became
one blank. The method combines in three steps, each of which groups by the
full normalised text beside its digest, so equal digests of different texts
never merge:

1. each task combines the copies it has read (the map side of the first
   aggregation), 2. the copies of a text meet in ``SALTS`` salted groups,
3. the salt winners (at most ``SALTS`` rows a text) are combined globally.

The hot text of a group with a third of all rows is thus spread over
``SALTS`` tasks in step 2 and is a few rows in step 3. Rows find their group
again by (digest, second digest, salt); a group is expanded only to the salts
that it has, which step 3 keeps as a bit mask.

Defined results: null text counts as empty. Of equal texts the row with the
smallest doc_id stays (a null doc_id stays only if the group has no other);
of repeated rows with that doc_id exactly one. An empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WS_RUN, expand_salts, rows_that_stay, salt_of, text_of

# Salted groups a text may have; fits the bit mask of a long.
SALTS = 32


def normalised(docs: DataFrame) -> Column:
    return F.regexp_replace(text_of(docs), WS_RUN, " ")


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _keyed(docs: DataFrame, digest) -> DataFrame:
    rows = docs.select(docs["doc_id"].alias("doc_id"), normalised(docs).alias("norm"))
    return rows.select("doc_id", "norm", digest(F.col("norm")).alias("digest"),
                       F.xxhash64("norm").alias("digest2"),
                       salt_of(F.col("doc_id"), SALTS).alias("salt"))


def duplicate_groups(docs: DataFrame, digest=_sha256) -> DataFrame:
    """One row per distinct normalised text: digest, digest2, keep_id, group_size, salts (bit mask)."""
    salted = (_keyed(docs, digest).groupBy("digest", "digest2", "salt", "norm")
              .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    bit = F.expr("shiftleft(1L, salt)")
    return (salted.groupBy("digest", "digest2", "norm")
            .agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"), F.sum(bit).alias("salts"))
            .drop("norm"))


def mark_duplicates(docs: DataFrame, digest=_sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    ``digest`` may be any function of the normalised text (tests pass a weak
    one); groups never mix texts, whatever it returns.
    """
    groups = expand_salts(duplicate_groups(docs, digest), SALTS)
    members = (_keyed(docs, digest).drop("norm").repartition("digest", "digest2", "salt")
               .groupBy("digest", "digest2", "salt", "doc_id").agg(F.count(F.lit(1)).alias("copies")))
    joined = members.join(groups, ["digest", "digest2", "salt"])
    # A doc_id is repeated only where whole rows are: the first of them counts as the row.
    return (joined.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    "digest"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    Every document knows its group's winner; the rows whose (doc_id, digest)
    is a winner stay, one of them where rows repeat.
    """
    kept = mark_duplicates(docs).where("kept")
    return rows_that_stay(docs, _sha256(normalised(docs)), kept)
