"""Structured Streaming: trade bars with explicit late trades, distinct trades, latest quotes, and the bar sink."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tideframe.operators.realtime import BAR_KEY, window_start
from tideframe.session import ship, stateful

NUMBERS = ("open", "high", "low", "close", "volume")
OUTPUT = T.StructType(
    [T.StructField(k, T.StringType()) for k in BAR_KEY]
    + [T.StructField("kind", T.StringType()), T.StructField("window", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in NUMBERS]
    + [T.StructField("trades", T.LongType()), T.StructField("arrival_seq", T.LongType())]
)
BAR = T.StructType([T.StructField("window", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in NUMBERS] + [T.StructField("trades", T.LongType())])
CLOSED = T.StructType([T.StructField("closed_through", T.LongType())])


def events_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files: int | None = None) -> DataFrame:
    """A typed stream of the files of a folder."""
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


class BarProcessor(StatefulProcessor):
    """A key's open bar, and the end of its last closed one. A newer window closes the bar, and so does the watermark at its end; a trade before either is late.

    Rows come in order of arrival, frame by frame, so a task holds one frame however many trades a key has.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", BAR)
        self.closed = handle.getValueState("closed", CLOSED)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        bar = self.bar.get() if self.bar.exists() else None
        timed = None if bar is None else bar[0]
        floor = self.closed.get()[0] if self.closed.exists() else None
        for frame in rows:
            window, price, size, arrival = (frame[c].to_numpy() for c in ("window", "price", "size", "arrival_seq"))
            bound = np.iinfo(np.int64).min if floor is None else floor
            newest = np.maximum.accumulate(np.concatenate([[max(bound, bound if bar is None else bar[0])], window]))[:-1]
            late = window < newest
            out = [(*key, "late_trade_dropped", int(w), p, p, p, p, s, 1, int(a)) for w, p, s, a in zip(window[late], price[late], size[late], arrival[late], strict=True)]
            window, price, size = window[~late], price[~late], size[~late]
            edges = [0, *(np.flatnonzero(np.diff(window)) + 1).tolist(), len(window)] if len(window) else []
            for low, high in pairwise(edges):
                part, new = price[low:high], int(window[low])
                if bar is not None and new > bar[0]:
                    out.append((*key, "bar", *bar, None))
                    floor, bar = bar[0] + self.seconds, None
                if bar is None:
                    bar = (new, part[0], part.max(), part.min(), part[-1], size[low:high].sum(), high - low)
                else:
                    bar = (new, bar[1], max(bar[2], part.max()), min(bar[3], part.min()), part[-1], bar[5] + size[low:high].sum(), bar[6] + high - low)
            if out:
                yield pd.DataFrame(out, columns=OUTPUT.names)
        if floor is not None:
            self.closed.update((floor,))
        if bar is not None:
            self.bar.update((int(bar[0]), *(float(v) for v in bar[1:6]), int(bar[6])))
            if timed != bar[0]:
                if timed is not None:
                    self.handle.deleteTimer((timed + self.seconds) * 1000)
                self.handle.registerTimer((int(bar[0]) + self.seconds) * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        bar = self.bar.get() if self.bar.exists() else None
        if bar is None or (bar[0] + self.seconds) * 1000 != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.bar.clear()
        self.closed.update((bar[0] + self.seconds,))
        yield pd.DataFrame([(*key, "bar", *bar, None)], columns=OUTPUT.names)

    def close(self) -> None:
        pass


def trade_bar_stream(trades: DataFrame, seconds: int, watermark: str = "0 seconds") -> DataFrame:
    """Closed bars (kind bar) and late trades (kind late_trade_dropped) of a stream of trades; start it with start() or run_to_end().

    A key's own arrivals decide what is late, as in the batch form; a bar also closes when the watermark passes its end, and what comes for it
    then is late too. Batches are to follow the order of arrival; within a batch Spark sorts a key's trades. No late
    trade is dropped unseen: the event time itself doesn't reach the state, so Spark has nothing to compare with the watermark.
    """
    ship(trades.sparkSession)
    rows = trades.withColumn("window", window_start(F.col("ts_event"), seconds)).withColumn("ts_event", F.col("ts_event").cast("timestamp")).withWatermark("ts_event", watermark)
    rows = rows.select(*BAR_KEY, "window", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), F.col("arrival_seq").cast("long").alias("arrival_seq"))
    n = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *BAR_KEY).sortWithinPartitions(*BAR_KEY, "arrival_seq")
    return rows.groupBy(*BAR_KEY).transformWithStateInPandas(BarProcessor(seconds), OUTPUT, "Append", "EventTime")


def closed_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The end of each key's last closed bar, as the state of a trade bar stream has it."""
    state = spark.read.format("statestore").option("stateVarName", "closed").load(checkpoint)
    return state.select(*(F.col(f"key.{k}").alias(k) for k in BAR_KEY), "value.closed_through")


def windowed_bars(trades: DataFrame, seconds: int, watermark: str) -> DataFrame:
    """Bars by Spark's own watermark: all JVM, for streams where a global bound on lateness will do."""
    rows = trades.withColumn("ts_event", F.col("ts_event").cast("timestamp")).withWatermark("ts_event", watermark)
    return rows.groupBy(*BAR_KEY, F.window("ts_event", f"{seconds} seconds").alias("w")).agg(
        F.min_by("price", "arrival_seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "arrival_seq").alias("close"), F.sum("size").alias("volume"), F.count("*").alias("trades"),
    )


def latest_quote_stream(quotes: DataFrame) -> DataFrame:
    """The current quote of each symbol, for update mode."""
    rest = [c for c in quotes.columns if c != "symbol"]
    return quotes.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.struct("ingested_at", "content_rank")).alias("q")).select("symbol", "q.*")


def distinct_trades(trades: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Repeated pushes of a trade_id within the watermark once."""
    return trades.withWatermark("ts_event", watermark).dropDuplicatesWithinWatermark(["trade_id"])


def bars_sink(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends each batch under its own batch_id folder: a batch that is run again overwrites itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a stream with keyed state."""
    with stateful(spark):
        return writer.start()


def run_to_end(writer: DataStreamWriter, spark: SparkSession | None = None) -> StreamingQuery:
    """Runs all that is there, then stops. spark is asked for by streams with keyed state."""
    writer = writer.trigger(availableNow=True)
    query = writer.start() if spark is None else start(writer, spark)
    query.awaitTermination()
    return query
