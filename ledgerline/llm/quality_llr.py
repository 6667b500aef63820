"""Quality rules: base counts of each text and a hashed n-gram likelihood ratio, in DataFrame operations only.

Words are runs of characters other than ASCII white space. The base counts are
word and symbol counts, repeated lines and words in repeated 3-word windows.
The method scores every document by

    (sum over its 1- and 2-grams of log p_target(bucket) - log p_raw(bucket)) / number of n-grams

where the n-grams are the 1- and 2-grams of words and the marks (runs of signs, and
signs that stand alone), hashed to ``BUCKETS`` buckets; ``raw`` counts the n-grams of
all documents and ``target`` those of trusted documents. Both multinomials are
smoothed by ``ALPHA`` pseudo-counts a bucket, the raw one at the target's size, so
a bucket seen a few times by chance says little. A document is kept when it
passes the base rules and its score is at least ``THRESHOLD``: the same test for
every document.

The target multinomial is fitted on at most ``TARGET_ROWS`` trusted labels (those
with the smallest hash of doc_id); everything else covers all rows. Both counts
are one aggregation to at most ``BUCKETS`` rows, combined before the shuffle;
the weights are one array of ``BUCKETS`` doubles, a scalar subquery. Texts are
never shuffled.

Repeated windows are found within the row: each window's hash carries its
position in the low bits, so sorting an array of longs brings equal windows
together, and equal neighbours are then compared by their words.

Defined results: null text has no words and fails the base rules; with no
trusted label the score is 0 for every document, and the base rules decide. An empty
table gives no rows. Labels with a null doc_id or quality are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_of, words_of

BUCKETS = 1 << 14
ALPHA = 4.0
THRESHOLD = -0.3
TARGET_ROWS = 20_000
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def _once(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``df`` with ``value`` computed once per row (a Generate: no filter on it is pushed below, and so repeats it).

    Plain columns that the next step names more than once are computed once as well.
    """
    return df.withColumn(column, F.explode(F.array(F.struct(value.alias("v"))))).withColumn(column, F.col(f"{column}.v"))


def with_words(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("__w", words_of(text_of(docs)))
    return docs.withColumn("__h", _hashes(F.col("__w")))


def _hashes(strings: Column) -> Column:
    return F.transform(strings, lambda t: F.xxhash64(t))


def _marks(text: Column) -> Column:
    """The runs of two or more signs, and the signs that stand alone."""
    return F.regexp_extract_all(text, F.lit(r"[^\p{L}\p{N}\s]{2,}|(?<!\S)[^\p{L}\p{N}\s](?!\S)"), F.lit(0))


# Buckets of the 1-grams and 2-grams of words (__h: their hashes) and of the marks (__m), and their number.
_BUCKETS = (f"concat(transform(__h, h -> int(h & {BUCKETS - 1})), "
            f"zip_with(slice(__h, 1, greatest(size(__h) - 1, 0)), slice(__h, 2, size(__h)), "
            f"(a, b) -> int((shiftright(a, 20) ^ shiftright(b, 7)) & {BUCKETS - 1})), "
            f"transform(__m, h -> int(h & {BUCKETS - 1})))")
_GRAMS = "greatest(size(__h) + greatest(size(__h) - 1, 0) + size(__m), 1)"


def trusted_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` trusted doc_ids: the bounded sample that the target is fitted on."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    return ids.orderBy(F.xxhash64("__id"), "__id").limit(rows)


def bucket_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ``weights``, the log ratio of target to raw of each bucket."""
    target = F.broadcast(trusted_ids(labels))  # TARGET_ROWS longs at most
    rows = docs.select(docs["doc_id"].alias("__id"), text_of(docs).alias("text"))
    rows = rows.join(target.withColumn("__t", F.lit(1)), "__id", "left")
    rows = rows.select("__t", _hashes(words_of(F.col("text"))).alias("__h"), _hashes(_marks(F.col("text"))).alias("__m"))
    grams = rows.select(F.coalesce("__t", F.lit(0)).alias("t"), F.explode(F.expr(_BUCKETS)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    table = counts.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"),
                       F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    # The raw counts are scaled to the target's total, so both have the same pseudo-counts and normaliser.
    return table.select(F.expr(
        f"transform(c, x -> if(targets = 0, 0D, ln((x.target + {ALPHA}D) / (x.raw * (targets / raws) + {ALPHA}D))))"
    ).alias("weights"))


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds ``__rep``: how many words lie in a 3-word window that the text has twice or more."""
    bits = F.expr("case when size(__w) < 1024 then 10 when size(__w) < 16384 then 14 "
                  "when size(__w) < 1048576 then 20 else 31 end")
    df = df.withColumn("__b", bits)
    df = df.withColumn("__s", F.sort_array(F.expr(
        "if(size(__w) < 3, array(), transform(sequence(0, size(__w) - 3), i -> "
        "shiftleft(shiftright(xxhash64(get(__h, i), get(__h, i + 1), get(__h, i + 2)), __b), __b) | i))")))
    at = lambda x: f"int({x} & (shiftleft(1L, __b) - 1))"
    same = lambda x, y: (f"(shiftright({x}, __b) = shiftright({y}, __b) and "
                         + " and ".join(f"get(__w, {at(x)} + {k}) = get(__w, {at(y)} + {k})" for k in range(3)) + ")")
    some = "size(array_distinct(transform(__s, x -> shiftright(x, __b)))) < size(__s)"
    df = df.withColumn("__p", F.sort_array(F.expr(
        f"if({some}, transform(filter(__s, (x, j) -> coalesce({same('x', 'get(__s, j - 1)')}, false) "
        f"or coalesce({same('x', 'get(__s, j + 1)')}, false)), x -> {at('x')}), array())")))
    covered = ("if(size(__p) = 0, 0L, aggregate(transform(slice(__p, 2, size(__p)), (p, i) -> "
               "bigint(least(3, p - get(__p, i)))), 3L, (a, x) -> a + x))")
    return df.withColumn("__rep", F.expr(covered)).drop("__b", "__s", "__p")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one more column ``quality_rules``, a struct of the counts, the score and the decisions.

    (The name takes the place of a column that is called so.)
    """
    weights = bucket_weights(docs, labels).scalar()
    text = text_of(docs)
    df = _repeated_words(with_words(docs.withColumn("__t", text)))
    lines = F.expr("filter(split(__t, '\\n'), x -> length(trim(BOTH "
                   + "' \\t\\n" + "\x0b\f" + "\\r' FROM x)) > 0)")
    # Named only in the next step, the weights are read in place; as a column kept longer, every row would carry a copy.
    df = df.withColumns({"__m": _hashes(_marks(F.col("__t"))), "__weights": weights})
    total = f"aggregate({_BUCKETS}, 0D, (a, b) -> a + coalesce(get(__weights, b), 0D))"
    df = df.withColumn("__llr", F.expr(f"{total} / {_GRAMS}")).drop("__weights", "__h", "__m")
    df = _once(df, "__q", F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.col("__rep").alias("n_repeat_words"),
        F.col("__llr").alias("llr")))
    q = F.col("__q")
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    return df.withColumn("__r", F.struct(
        q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
        (F.size(q["lines"]) - F.size(F.array_distinct(q["lines"]))).cast("long").alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & (q["llr"] >= threshold)).alias("kept"), q["llr"].alias("llr"),
    )).select(*[docs[c] for c in docs.columns if c != "quality_rules"], F.col("__r").alias("quality_rules"))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with all columns of ``docs`` as they were."""
    scored = score_documents(docs.withColumn("__kept_columns", F.struct(*[docs[c] for c in docs.columns])),
                             labels, threshold)
    return scored.where("quality_rules.kept").select("__kept_columns.*")
