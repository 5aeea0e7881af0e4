"""One canonical bar for each series and time out of the sources' versions, and its incremental upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tideframe.operators.versions import CANONICAL_KEY, DEAL, RAW_KEY, SERIES, latest_raw

# Source priorities, best first.
PRIORITY = ("tushare", "sina", "eastmoney", "yahoo_chart", "baostock")
RUNTIME_PRIORITY = ("longport", "tushare", "sina", "eastmoney", "yahoo_chart", "baostock")
FEW = 1 << 17  # series whose ranges may be sent to all tasks, some megabytes
COMPARED = ("open", "high", "low", "close", "volume", "amount")
LAST = ("raw_artifact_id", "source_sequence")  # what decides between rows of one source


def is_close(a: Column, b: Column, relative: float = 1e-6, absolute: float = 1e-9) -> Column:
    """Equal within a tolerance; two nulls are close, a null and a number aren't."""
    near = F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def source_rank(source: Column, priority: Sequence[str] = PRIORITY) -> Column:
    """Place in the priority list; unknown sources come after all known ones."""
    rank = F.lit(len(priority))
    for i, name in reversed(list(enumerate(priority))):
        rank = F.when(source == name, F.lit(i)).otherwise(rank)
    return rank


def canonical_bars(raw: DataFrame, priority: Sequence[str] = PRIORITY, relative: float = 1e-6, absolute: float = 1e-9, deduplicated: bool = False, deal: Sequence[str] = DEAL, columns: Sequence[str] | None = None, key: Sequence[str] = CANONICAL_KEY) -> DataFrame:
    """The selected row of each series and time, with source_count, quality_status, input_fingerprint and updated_at.

    A group has a row for each source, so its rows fit an array: one shuffle selects, compares and fingerprints.
    deal: what rows are dealt out by; where joins by the whole key come before or after, that key saves them a shuffle.
    columns: those of the result besides the key that are wanted, if not all; what neither they nor the choice needs isn't shuffled.
    key: the canonical one, or with more columns. The order is priority, newest observation, newest ingestion, source, artifact, sequence;
    the last two can't decide between the newest versions, of which a group has one for each source, and stay behind if they aren't wanted.
    """
    needed = set(raw.columns) if columns is None else _needed(columns, key) | (set(LAST) if deduplicated else set())
    raw = raw.select(*(c for c in raw.columns if c in needed))
    compared = COMPARED if columns is None or "quality_status" in columns else ()
    rows = raw if deduplicated else latest_raw(raw, deal, [c for c in key if c not in CANONICAL_KEY], columns is None or "content_rank" in columns)
    micros = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    order = [
        source_rank(F.col("source"), priority).alias("_rank"),
        micros("observed_at").alias("_observed"),
        micros("ingested_at").alias("_ingested"),
        F.col("source").alias("_source"),
        *(F.coalesce(c, F.lit("")).alias(f"_last_{c}") for c in LAST if c in rows.columns),
    ]
    rest = [c for c in rows.columns if c not in key and (columns is None or c in columns or c in compared)]
    # What decides, field by field and null or not; a number as its shortest exact text.
    fields = [c for c in (*CANONICAL_KEY, "market", *COMPARED, "raw_close", "adjustment_factor", "source", "source_sequence", "raw_artifact_id") if c in rows.columns]
    times = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("observed_at", "ingested_at")]
    text = F.to_json(F.struct(*fields, *times), {"ignoreNullFields": "false"})
    grouped = rows.groupBy(*key).agg(
        F.array_min(F.collect_list(F.struct(*order, *(F.col(c) for c in rest)))).alias("_best"),
        F.collect_list(F.struct("source", *compared)).alias("_rows"),
        F.sort_array(F.collect_list(text)).alias("_texts"),
        F.max("ingested_at").alias("updated_at"),
    )
    close = F.forall("_rows", lambda r: _all_close(r, compared, relative, absolute))
    sources = F.size(F.array_distinct(F.transform("_rows", lambda r: r["source"])))
    quality = F.when(sources == 1, "single_source").when(close, "multi_source_consistent").otherwise("multi_source_ohlcva_difference")
    out = grouped.select(
        *key,
        *(F.col(f"_best.{c}").alias(c) for c in rest),
        sources.alias("source_count"),
        quality.alias("quality_status"),
        F.sha2(F.concat_ws("\n", "_texts"), 256).alias("input_fingerprint"),
        "updated_at",
    )
    return out if columns is None else out.select(*key, *(c for c in columns if c not in key))


def _needed(columns: Sequence[str], key: Sequence[str]) -> set[str]:
    """The columns of raw bars that decide which are selected, and those that the wanted columns come from."""
    found = {*key, "source", "observed_at", "ingested_at", "content_rank", *columns}
    if "quality_status" in columns:
        found |= set(COMPARED)
    if "input_fingerprint" in columns:
        found |= {"market", *COMPARED, "raw_close", "adjustment_factor", *LAST}
    return found


def _all_close(row: Column, compared: Sequence[str], relative: float, absolute: float) -> Column:
    out = F.lit(True)
    for c in compared:
        out = out & is_close(row[c], F.col("_best")[c], relative, absolute)
    return out


def bump_version(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new with version: the stored one where the fingerprint is the same, else one more; 1 for new keys."""
    old = existing.select(*CANONICAL_KEY, F.col("version").alias("_version"), F.col("input_fingerprint").alias("_print"))
    same = F.col("_print") == F.col("input_fingerprint")
    version = F.when(F.col("_version").isNull(), F.lit(1)).when(same, F.col("_version")).otherwise(F.col("_version") + 1)
    return new.join(old, list(CANONICAL_KEY), "left").withColumn("version", version.cast("long")).drop("_version", "_print")


def rebuild_summary(canonical: DataFrame) -> DataFrame:
    """Groups by quality and selected source."""
    return canonical.groupBy("quality_status", F.col("source").alias("selected_source")).agg(F.count("*").alias("groups"), F.sum("source_count").cast("long").alias("source_rows"))


def observed_rebuild(raw: DataFrame, limit: int | None = None, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """rebuild_summary() of a rebuild, with scanned_rows, scanned_groups and truncated, all counted while the one pass runs.

    If more rows than limit are scanned, the rebuild is truncated: it has no groups, and one row says so.
    """
    scan, build = Observation(), Observation()
    scanned = raw.observe(scan, F.count("*").alias("rows"))
    built = canonical_bars(scanned, priority).observe(build, F.count("*").alias("groups"))
    rows = rebuild_summary(built).collect()  # a row for each quality and source
    seen = scan.get["rows"] if rows else 0  # every scanned row is in a group; an empty plan observes nothing
    truncated = limit is not None and seen > limit
    schema = "quality_status string, selected_source string, groups long, source_rows long, scanned_rows long, scanned_groups long, truncated boolean"
    found = [(None, None, 0, 0, seen, 0, True)] if truncated else [(*r, seen, build.get["groups"], False) for r in rows]
    return raw.sparkSession.createDataFrame(found, schema)


def dirty_ranges(new_raw: DataFrame) -> DataFrame:
    """For each series the times that new rows touch, with a task id that depends on the range only."""
    found = new_raw.groupBy(*SERIES).agg(F.min("bar_time").alias("start_time"), F.max("bar_time").alias("end_time"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.withColumn("task_id", F.sha2(F.concat_ws("|", *SERIES, day("start_time"), day("end_time")), 256))


def renewed(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing with the rows of new in their keys' places, versions bumped as by bump_version(); the rest stays. One join by key."""
    key = list(CANONICAL_KEY)
    old_columns, new_columns = ([c for c in df.columns if c not in CANONICAL_KEY] for df in (existing, new))
    both = existing.select(*key, F.struct(*old_columns).alias("_old")).join(new.select(*key, F.struct(*new_columns).alias("_new")), key, "full_outer")
    same = F.col("_old.input_fingerprint") == F.col("_new.input_fingerprint")
    version = F.when(F.col("_new").isNull() | same, F.col("_old.version")).when(F.col("_old").isNull(), F.lit(1)).otherwise(F.col("_old.version") + 1)
    side = lambda name, columns, c: F.col(f"{name}.{c}") if c in columns else F.lit(None)
    rest = [c for c in dict.fromkeys([*old_columns, *new_columns]) if c != "version"]
    return both.select(*key, *(F.when(F.col("_new").isNotNull(), side("_new", new_columns, c)).otherwise(side("_old", old_columns, c)).alias(c) for c in rest), version.cast("long").alias("version"))


def incremental_rebuild(raw: DataFrame, canonical: DataFrame, ranges: DataFrame, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """canonical with the keys inside the ranges built anew and their versions bumped; the rest stays."""
    span = ranges.select(*SERIES, F.col("start_time").alias("_from"), F.col("end_time").alias("_to"))
    inside = F.col("bar_time").between(F.col("_from"), F.col("_to"))
    touched = raw.join(span, list(SERIES)).where(inside).select(*raw.columns)
    return renewed(canonical, canonical_bars(touched, priority))


def rebuilt(raw: DataFrame, late: Column, priority: Sequence[str] = PRIORITY, columns: Sequence[str] | None = None) -> DataFrame:
    """What incremental_rebuild() makes of the canonical bars (version 1) of the rows that aren't late and of the ranges that late ones touch, in one pass.

    A raw row is shuffled once, for both builds: the ranges, one for each series, are sent to all tasks once they are counted to be few. columns: those of the result that are wanted besides the key and version, if not all.
    """
    wanted = None if columns is None else list(dict.fromkeys([*columns, "input_fingerprint"]))
    rows = raw if wanted is None else raw.select(*(c for c in raw.columns if c in _needed(wanted, CANONICAL_KEY)))
    span = dirty_ranges(rows.where(late)).select(*SERIES, F.col("start_time").alias("_from"), F.col("end_time").alias("_to"))
    span = F.broadcast(span) if rows.where(late).select(*SERIES).distinct().count() <= FEW else span
    rest, order = [c for c in rows.columns if c not in RAW_KEY], F.struct("ingested_at", "content_rank")
    marked = rows.withColumn("_before", F.coalesce(~late, F.lit(False))).join(span, list(SERIES), "left")
    marked = marked.withColumn("_inside", F.coalesce(F.col("bar_time").between(F.col("_from"), F.col("_to")), F.lit(False))).drop("_from", "_to").where("_before OR _inside")
    side = lambda c: F.max_by(F.struct(*rest), F.when(F.col(c), order))
    newest = marked.repartition(*DEAL).groupBy(*RAW_KEY).agg(F.array(side("_before"), side("_inside")).alias("_rows"))
    newest = newest.select(*RAW_KEY, F.posexplode("_rows").alias("_side", "_row")).where("_row IS NOT NULL")
    newest = newest.select("_side", *(F.col(c) if c in RAW_KEY else F.col(f"_row.{c}").alias(c) for c in rows.columns))
    built = canonical_bars(newest, priority, deduplicated=True, key=(*CANONICAL_KEY, "_side"))
    out = [c for c in built.columns if c not in (*CANONICAL_KEY, "_side")]
    both = built.groupBy(*CANONICAL_KEY).agg(*(F.first(F.when(F.col("_side") == n, F.struct(*out)), ignorenulls=True).alias(name) for n, name in ((0, "_old"), (1, "_new"))))
    again = F.col("_old").isNotNull() & F.col("_new").isNotNull() & (F.col("_old.input_fingerprint") != F.col("_new.input_fingerprint"))
    kept = F.coalesce("_new", "_old")
    keep = out if columns is None else [c for c in columns if c not in CANONICAL_KEY]
    return both.select(*CANONICAL_KEY, *(kept[c].alias(c) for c in keep), F.when(again, 2).otherwise(1).cast("long").alias("version"))
