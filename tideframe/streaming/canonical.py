"""Canonical bars kept up by a stream of raw bars: a batch reads and writes only the parts of the tables that it touches.

A part is a month of one of BUCKETS shares of the series. store/raw has what each batch brought to a part, store/canonical a build
of a part for each batch that touched it, and store/commits says which parts a batch has built. Only committed builds
count, the newest of each part, so a batch that fails half-way or runs again changes nothing that readers see: it
writes the same folders again. Earlier builds stay on disk until the store's owner removes them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tideframe.operators import canonical
from tideframe.operators.versions import CANONICAL_KEY, SERIES

BUCKETS = 16
COMMITS = T.StructType([T.StructField("part", T.StringType()), T.StructField("build", T.LongType()), T.StructField("batch_id", T.LongType())])


def with_part(bars: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    bucket = F.pmod(F.xxhash64(*SERIES), F.lit(buckets))
    return bars.withColumn("part", F.concat(F.lit("m"), F.date_format("bar_time", "yyyyMM"), F.lit("b"), F.lpad(bucket.cast("string"), 5, "0")))


def _write(rows: DataFrame, path: str, *keys: str) -> None:
    sorted_ = rows.repartition("part").sortWithinPartitions("part", *SERIES, "bar_time")
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def committed(spark: SparkSession, store: str, parts: list[str] | None = None, before: int | None = None) -> dict[str, int]:
    """The build that counts of each part, of some parts and of batches before one if given. There are months times buckets of them, whatever the number of bars."""
    try:
        rows = spark.read.schema(COMMITS).parquet(f"{store}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    if parts is not None:
        rows = rows.where(F.col("part").isin(parts))
    return {r.part: r.build for r in rows.groupBy("part").agg(F.max("build").alias("build")).collect()}


def read_canonical(spark: SparkSession, store: str, parts: list[str] | None = None, before: int | None = None) -> DataFrame | None:
    """The canonical bars as committed; None without any. The builds that count are named to the scan, which reads no other folder."""
    builds = committed(spark, store, parts, before)
    if not builds:
        return None
    named = F.concat_ws("@", "part", F.col("build").cast("string")).isin([f"{k}@{v}" for k, v in builds.items()])
    return spark.read.parquet(f"{store}/canonical").where(named).drop("part", "build")


def refresh(batch: DataFrame, batch_id: int, store: str, buckets: int = BUCKETS) -> None:
    """Take a batch of raw bars in: its keys' canonical bars are built anew, the other rows of the parts that it touches are copied, and the parts are committed."""
    spark = batch.sparkSession
    rows = with_part(batch, buckets)
    names = [r.part for r in rows.select("part").distinct().collect()]
    if not names:
        return
    _write(rows.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{store}/raw", "part", "batch_id")
    held = spark.read.parquet(f"{store}/raw").where(F.col("part").isin(names) & (F.col("batch_id") <= batch_id)).select(*batch.columns)
    before = read_canonical(spark, store, names, batch_id)
    if before is None:  # no batch before this one touched these parts, so all that they hold is its own
        built = canonical.canonical_bars(held).withColumn("version", F.lit(1).cast("long"))
    else:
        keys = rows.select(*CANONICAL_KEY).distinct()
        built = canonical.renewed(before, canonical.canonical_bars(held.join(keys, list(CANONICAL_KEY), "left_semi"), deal=CANONICAL_KEY))
    _write(with_part(built, buckets).withColumn("build", F.lit(batch_id).cast("long")), f"{store}/canonical", "part", "build")
    done = spark.createDataFrame([(n, batch_id, batch_id) for n in names], COMMITS)
    done.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{store}/commits")


def canonical_stream(raw: DataFrame, store: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Each batch of raw bars refreshes the canonical bars below store; read_canonical() has them."""
    return raw.writeStream.foreachBatch(lambda batch, batch_id: refresh(batch, batch_id, store, buckets)).option("checkpointLocation", checkpoint)
