"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A hash of source and id puts the documents of a source into a random order, whose leading bits are blocks of
about BLOCK_DOCS documents. A source is taken in whole passes over its blocks and one partial pass. The blocks that
sources owe are exact quotas; a binary tree over the output shards splits them, each node drawing the left half's counts
from a multivariate hypergeometric distribution, so each shard gets whole blocks in random proportions that add up
exactly. A document is drawn where a shard's quota covers its block. Of the last block of a partial pass those documents
go that fit into what is still owed, one after the other in the block's order; a text that doesn't fit is passed over
for later ones that do, and the smallest one left goes too if that comes nearer to the target. Within a shard the drawn
documents are put into an order by hash.

Only sums by source, and by source and shard, reach the driver; they are as many as there are sources.

Defined cases: a null text has size 0; null sources are one source, the last. Rows with equal source and doc_id share their
place in the order and are taken alike; rows without an id have a place by their text. Sources of size 0 have target 0 and
aren't taken. Very long texts count whole, and are passed over where they don't fit. An empty table gives an empty result.
Extra columns, also those named as the results, don't matter. The same input and seed give the same result, however partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common

BLOCK_DOCS = 2048
TASK_DOCS = 100_000  # drawn documents of a shard that go to one task
PLACES = 1_000_000  # documents of last blocks up to which they are sent to all tasks
PLAN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("passes", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("need", T.DoubleType()),
    ]
)


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> dict[str | None, float]:
    """Words to take of each source: the weights repeat over the sources by code point (null last); what goes
    beyond `most` times a source's size is shared out again by weight."""
    order = common.in_code_point_order(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, left = list(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def place(seed: int) -> Column:
    """A document's place in its source's random order, 63 bits."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), F.col("text").cast("string")))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.coalesce(F.col("source"), F.lit("\0")), own), 1)


def sized(documents: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, place and row (a number of its own) as a written table; the texts are read once."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    docs = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place(seed).alias("place"))
    return common.written(docs.withColumn("row", F.monotonically_increasing_id()))


def plan(docs: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """For each source: size, target, whole passes, bits of a block number, and the block in which the partial pass ends.

    That block is -1 without a partial pass. And (source, place) of the documents that go of these blocks, as a written table.
    """
    spark = docs.sparkSession
    totals = {r.source: (r.size, r.n) for r in docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    goal = targets({k: v[0] for k, v in totals.items()}, weights, share, most)
    rows = []
    for source in common.in_code_point_order(totals):
        size, n = totals[source]
        passes = min(int(most), int(goal[source] // size)) if size else 0
        rows.append((source, size, goal[source], passes, max(0, -(-n // BLOCK_DOCS) - 1).bit_length(), goal[source] - passes * size))
    sources = F.broadcast(spark.createDataFrame(rows, PLAN))  # a row for each source
    joined = docs.join(sources, docs.source.eqNullSafe(sources.source)).select(sources.source, "place", "size", "bits", "need")
    joined = joined.withColumn("block", F.expr("shiftright(place, 63 - bits)"))
    blocks = joined.groupBy("source", "block", "need").agg(F.sum("size").alias("size"))
    cumulative = Window.partitionBy("source").orderBy("block")  # a row for each block
    blocks = blocks.withColumn("upto", F.sum("size").over(cumulative)).where("upto - size < need AND need <= upto").withColumn("left", F.col("need") - (F.col("upto") - F.col("size")))
    last = common.written(blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "left"))  # a row for each source at most
    inside = joined.join(F.broadcast(last), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inside = inside.groupBy("source", "left", "place").agg(F.sum("size").alias("size"))
    inside = inside.groupBy("source", "left").agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias("docs"))  # about BLOCK_DOCS
    chosen = common.written(inside.select(F.col("source").alias("_of"), F.explode(fitting(F.col("docs"), F.col("left"))).alias("_fits")))
    ends = {r.s: r.b for r in last.collect()}
    full = [(s, size, goal, passes, bits, ends.get(s, 1 << bits if size and need >= size else -1)) for s, size, goal, passes, bits, need in rows]
    return spark.createDataFrame(full, T.StructType([*PLAN.fields[:5], T.StructField("last", T.LongType())])), chosen


def fitting(docs: Column, left: Column) -> Column:
    """Places of those docs (place, size), in their order, that fit one after the other into what is left, and of the smallest other if left is nearer to it than to 0."""
    none = F.lit(None).cast("struct<size:bigint,place:bigint>")
    start = F.struct(left.cast("double").alias("left"), F.array().cast("array<bigint>").alias("taken"), none.alias("other"))

    def step(state: Column, doc: Column) -> Column:
        size = F.struct(doc["size"].alias("size"), doc["place"].alias("place"))
        takes = F.struct((state["left"] - doc["size"]).alias("left"), F.array_append(state["taken"], doc["place"]).alias("taken"), state["other"].alias("other"))
        passes = F.struct(state["left"].alias("left"), state["taken"].alias("taken"), F.least(state["other"], size).alias("other"))
        return F.when(doc["size"] <= state["left"], takes).otherwise(passes)

    last = lambda x: F.when(x["other"].isNotNull() & (x["other"]["size"] - x["left"] < x["left"]), F.array_append(x["taken"], x["other"]["place"])).otherwise(x["taken"])
    return F.aggregate(docs, start, step, last)


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts[s] blocks of each source among the shards: an array [shard, source] whose columns add up to counts."""
    total = int(counts.sum())
    sizes = np.array([total * (i + 1) // shards - total * i // shards for i in range(shards)], np.int64)
    out = np.zeros((shards, len(counts)), np.int64)

    def down(low: int, high: int, left: np.ndarray) -> None:
        if high - low == 1:
            out[low] = left
            return
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high])
        part = draw.multivariate_hypergeometric(left, int(sizes[low:middle].sum()), method="marginals") if left.sum() else left
        down(low, middle, part)
        down(middle, high, left - part)

    down(0, shards, np.asarray(counts, np.int64))
    return out


def quotas(plans: DataFrame, shards: int, seed: int) -> DataFrame:
    """plans with limits: for each shard the entry of the source's order of blocks at which its own ones end.

    A partial pass owes its last block whole; which of its documents go is another matter.
    """
    spark = plans.sparkSession
    rows = plans.collect()  # a row for each source
    owed = np.array([r.passes * (1 << r.bits) + min(r.last + 1, 1 << r.bits) for r in rows], np.int64)
    upto = np.cumsum(split(owed, shards, seed), axis=0) if len(rows) else np.zeros((shards, 0), np.int64)
    full = [(*r, upto[:, i].tolist()) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, T.StructType([*plans.schema.fields, T.StructField("limits", T.ArrayType(T.LongType()))]))


def dealt(rows: DataFrame, plans: DataFrame, chosen: DataFrame, shards: int, seed: int) -> DataFrame:
    """rows (with source and place) once for each time that a shard's quota of blocks draws them, with shard and order, dealt out by shard and sorted."""
    renamed = F.broadcast(quotas(plans, shards, seed).select(F.col("source").alias("_source"), "passes", "bits", "last", "limits"))
    joined = rows.join(renamed, rows.source.eqNullSafe(F.col("_source")))
    joined = joined.join(common.sent(chosen, PLACES), F.col("_of").eqNullSafe(F.col("_source")) & (F.col("_fits") == F.col("place")), "left")
    joined = joined.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    joined = joined.withColumn("block", F.expr("shiftright(place, 63 - bits)")).withColumn("n", F.expr("shiftleft(1L, bits)"))
    # Each whole pass has an order of blocks of its own; the partial pass goes by number.
    turned = F.expr(f"block ^ (xxhash64({seed}L, pass) & (n - 1))")
    entry = F.col("pass") * F.col("n") + F.when(F.col("pass") < F.col("passes"), turned).otherwise(F.col("block"))
    drawn = joined.withColumn("entry", entry).withColumn("_shard", F.expr("size(filter(limits, x -> x <= entry))"))
    drawn = drawn.where((F.col("_shard") < shards) & ((F.col("pass") < F.col("passes")) | (F.col("block") < F.col("last")) | ((F.col("block") == F.col("last")) & F.col("_fits").isNotNull())))
    drawn = drawn.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_shard"), F.col("place"), F.col("pass")))
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(8, sum((r.passes + 1) << r.bits for r in plans.collect()) * BLOCK_DOCS // (shards * TASK_DOCS))  # of a shard, as many as it has documents for
    return drawn.select(*rows.columns, "_shard", "_order").repartition(n, "_shard", F.pmod("_order", F.lit(parts))).sortWithinPartitions("_shard", "_order")


def sizes_and_takes(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, shards: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, draws and taken of each document: how often it is in the mixture, and its words there."""
    docs = sized(documents, seed)
    plans, chosen = plan(docs, weights, share, most)
    mixed = common.written(dealt(docs.select("row", "source", "size", "place"), plans, chosen, shards, seed))
    words = mixed.groupBy(F.col("row").alias("_row")).agg(F.count("*").cast("int").alias("draws"), F.sum("size").alias("taken"))
    goals = F.broadcast(plans.select(F.col("source").alias("_source"), "source_size", "target"))
    found = docs.join(goals, docs.source.eqNullSafe(F.col("_source"))).join(words, F.col("row") == F.col("_row"), "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("draws", F.lit(0)).alias("draws"), F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, shards: int = 64, seed: int = 7) -> DataFrame:
    """documents as often as they are drawn, with shard and order, dealt out by shard and sorted by order within it."""
    plans, chosen = plan(sized(documents, seed), weights, share, most)
    inner = documents.select(F.struct(*documents.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").withColumn("place", place(seed)).drop("text")
    return dealt(inner, plans, chosen, shards, seed).select("_row.*", "_shard", "_order")
