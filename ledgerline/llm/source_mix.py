"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Every source has a weight and a target: its share by weight of all words,
   at most ``MAX_EPOCHS`` times its own words; what a capped source can't take goes to
   the others by weight, until none is above its cap.
2. A source's documents, in an order set by the seed, form a cyclic stream of
   words, cut into blocks of ``block_words``. Block ``a`` covers the words from
   ``a * block_words`` on, modulo the source's size.
3. The blocks of the mix are handed out one by one to the source with the highest
   quotient target / (2 a + 1), where it has ``a`` blocks so far (ties to the
   earlier source). The first ``shard_blocks`` of that sequence make shard 0, the
   next shard 1, and so on: integer quotas per shard. A source's blocks are
   used in order, so its quota in a shard is a run of its seeded blocks.

How often a document is taken follows from its place in its source's stream
alone: whole turns of the stream, and the part of the last turn that reaches
it. So no block is ever a row: the job is one count of words, one range
shuffle of (source, seeded hash, doc_id, size) for running sums, and a table
with a row per source, which the driver reads (``MAX_SOURCES`` at most; more is
an error, not a cut). A hot source spreads over the range shuffle like any
other rows.

Defined results: null text has size 0 and nothing is taken from it. Sources
are ordered by code point, null last and a source of its own. Repeated rows
are documents of their own. With no words at all every target is 0. An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import id_key, prefix_sums, text_of, word_count, words_of, written

MAX_EPOCHS = 3
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 8
SHARD_BLOCKS = 1 << 16
MAX_SOURCES = 100_000
SEED = 20_240_613


def capped_targets(sizes: list[int], weights: list[float], epochs: int = MAX_EPOCHS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; none above ``epochs`` times its size."""
    targets = [0.0] * len(sizes)
    free = [i for i, size in enumerate(sizes) if size > 0]
    left = float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > epochs * sizes[i]]
        if not over:
            for i in free:
                targets[i] = unit * weights[i]
            break
        for i in over:
            targets[i] = float(epochs * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in set(over)]
    return targets


def sainte_lague(weights: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients w / (2 a + 1); ties to the earlier; none above ``most``.

    Found by the common divisor of the last quotient instead of seat by seat.
    """
    w = np.asarray(weights, dtype=np.float64)
    cap = np.full(len(w), np.iinfo(np.int64).max // 4) if most is None else np.asarray(most, dtype=np.int64)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(w)

    def at(quotient: float) -> np.ndarray:  # seats with a quotient of at least this
        return np.minimum(np.floor((w / quotient + 1) / 2).astype(np.int64), cap)

    low, high = 0.0, float(w.max()) * 2  # at(high) hands out none, at(low) all
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high) or mid == 0:
            break
        if at(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while got.sum() < seats:  # those whose quotients tie at the divisor
        quotient = np.where(got < cap, w / (2 * got + 1), -1.0)
        got[int(np.argmax(quotient))] += 1
    return [int(x) for x in got]


@dataclass
class MixPlan:
    """What a mix takes from each source, and in which shard."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    block_words: int
    shard_blocks: int

    def shard_quotas(self, spark) -> DataFrame:
        """One row per shard and source: the source's first block there, and its integer quota."""
        total, step = sum(self.blocks), self.shard_blocks
        targets, blocks, names = self.targets, self.blocks, self.sources

        def quotas(batches):
            import pandas as pd

            for batch in batches:
                for shard in batch["id"]:
                    first = sainte_lague(targets, shard * step, blocks)
                    after = sainte_lague(targets, min((shard + 1) * step, total), blocks)
                    yield pd.DataFrame({"shard": shard, "source": names, "first_block": first,
                                        "blocks": [b - a for a, b in zip(first, after, strict=True)]})

        return spark.range(-(-total // step)).mapInPandas(
            quotas, "shard long, source string, first_block long, blocks long")


def _order_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("__h"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of each document, with a hash of its text that orders repeated ids."""
    text = text_of(docs)
    return docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"),
                       word_count(text).alias("size"), F.xxhash64(text).alias("__h"))


def plan_mix(rows: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS,
             shard_blocks: int = SHARD_BLOCKS) -> MixPlan:
    """Targets and quotas from the sizes of the sources (``sized`` rows)."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in totals]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], epochs)
    most = [epochs * n // block_words for n in sizes]
    blocks = sainte_lague(targets, round(sum(targets) / block_words), most)
    return MixPlan([r["source"] for r in totals], sizes, targets, blocks, block_words, shard_blocks)


def mix_documents(docs: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS,
                  seed: int = SEED) -> tuple[DataFrame, MixPlan]:
    """Per document: doc_id, source, size, source_size, target, taken, ``place`` (of its first word in its
    source's stream) and ``__h`` (a hash of its text), with the plan."""
    rows = written(sized(docs), "mix-sizes")  # the texts are read once
    plan = plan_mix(rows, weights, epochs, block_words)
    spark = docs.sparkSession
    before = np.concatenate([[0], np.cumsum(plan.sizes)]).astype(int) if plan.sizes else [0]
    table = spark.createDataFrame(
        [(s, int(n), float(t), int(b) * block_words, int(o)) for s, n, t, b, o in
         zip(plan.sources, plan.sizes, plan.targets, plan.blocks, before, strict=False)],
        "source string, source_size long, target double, words long, before long")
    placed = prefix_sums(rows, [F.col("source").isNull(), F.col("source"), _order_key(seed), F.col("doc_id"),
                                F.col("__h")], "size", "__at", "mix")
    joined = placed.join(F.broadcast(table.withColumnRenamed("source", "__s")),  # MAX_SOURCES rows at most
                         F.col("source").eqNullSafe(F.col("__s")))
    place = F.col("__at") - F.col("before")
    turns = F.expr("if(source_size = 0, 0L, words div source_size)")
    rest = F.expr("if(source_size = 0, 0L, words % source_size)")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("place")))
    taken = joined.withColumn("place", place).withColumn("taken", (turns * F.col("size") + part).cast("long"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "place", "__h"), plan


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken.

    The last turn of a source's stream may end within a document: that row has
    the words that were taken, joined by blanks, and their length as n_chars
    (at most one such document per source). Documents that the mix doesn't
    take are gone.
    """
    taken, _ = mix_documents(docs, **options)
    number = Window.partitionBy("__key", "__h")
    takes = (taken.where("taken > 0")
             .select(id_key(F.col("doc_id")).alias("__key"), "__h", "size", "taken", "place")
             .withColumn("__n", F.row_number().over(number.orderBy("place"))).drop("place"))
    rows = docs.withColumns({"__key": id_key(docs["doc_id"]), "__h": F.xxhash64(text_of(docs))})
    rows = rows.withColumn("__n", F.row_number().over(number.orderBy("__h")))
    each = F.explode(F.expr("transform(sequence(1L, ceil(__take / __size)), "
                            "i -> least(__size, __take - (i - 1) * __size))"))
    joined = rows.join(takes.withColumnsRenamed({"size": "__size", "taken": "__take"}), ["__key", "__h", "__n"])
    joined = joined.withColumn("__words", each)
    whole = F.col("__words") == F.col("__size")
    cut = F.array_join(F.slice(words_of(text_of(joined)), F.lit(1), F.col("__words").cast("int")), " ")
    joined = joined.withColumn("__text", F.when(whole, joined["text"]).otherwise(cut))
    made = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(whole, joined["n_chars"]).otherwise(F.length("__text"))
    return joined.withColumns(made).select(*docs.columns)
