"""A session with the settings that the operators rely on, and this package for its Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATEFUL = {
    # states with timers and several variables need a store that keeps them apart
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # rows are sorted within a key before they are folded, which the check of streams doesn't know of
    "spark.sql.streaming.unsupportedOperationCheck": "false",
}

_shipped: set[str] = set()


def session(name: str = "tideframe", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; everything else is the cluster's to set."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once: functions go to them by module name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tideframe-")
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tideframe_market"), "zip", top, "tideframe"))


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """The settings that a stream with keyed state is to be started with; the session's own come back after it."""
    before = {key: spark.conf.get(key, None) for key in STATEFUL}
    for key, value in STATEFUL.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
