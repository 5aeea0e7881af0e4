"""Cases of a reviewer's findings: whole answers, and work that stays spread over the tasks."""

from pyspark.sql import functions as F

from tests.test_streams import RAW, raw_bars
from tideframe.operators import asof, canonical, inventory, ranges, versions
from tideframe.operators.canonical import canonical_bars
from tideframe.operators.versions import CANONICAL_KEY
from tideframe.plans import QUERIES, bars
from tideframe.sources import ingest
from tideframe.sources.fixtures import table
from tideframe.streaming import canonical as upkeep

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_both_newest_closes_are_returned(spark):
    got = {r.user_id: r.last_but_one for r in QUERIES["last_nonnull_close"](spark, DATA).collect()}
    known = table(spark, DATA, "events").where("event_type <> 'error' AND value IS NOT NULL").orderBy("event_id").select("user_id", "value").collect()
    assert got == {user: ([2.5] + [r.value for r in known if r.user_id == user][:-1])[-1] for user in got}


def test_pages_are_numbered_without_whole_datasets(spark):
    rows = spark.createDataFrame([(f"d{i % 2}", f"{(i * 37) % 101:02d}", i) for i in range(300)], "d string, r string, i int").repartition(5)
    got = {(r.d, r.i): r.position for r in ranges.numbered(rows, ["d"], ["r", "i"], F.substring("r", 1, 1)).collect()}
    want = {}
    for d in ("d0", "d1"):
        mine = sorted((f"{(i * 37) % 101:02d}", i) for i in range(300) if f"d{i % 2}" == d)
        want |= {(d, i): n for n, (_, i) in enumerate(mine, 1)}
    assert got == want
    text = plan(QUERIES["manifest_check"](spark, DATA))
    assert "hashpartitioning(dataset_id" in text and "row_number() windowspecdefinition(dataset_id#" in text
    assert all("_slice#" in x.split(")")[0] for x in text.split("row_number() windowspecdefinition(")[1:])


def test_a_changed_snapshot_takes_one_pass(spark):
    rows = bars.canon(spark, DATA).where("bar_time < '1995-06-01' OR symbol > 'S0005'")
    early = F.col("bar_time") < bars.ntz("1995-03-15 00:00:00")
    late = rows.where((F.col("symbol") != "S0009") | ~early)
    want = sorted(inventory.snapshot_changed(bars.identity(late.where(early)), bars.identity(late)).collect())
    got = inventory.changed_since(bars.identified(late), bars.IDENTIFIED, early)
    assert [tuple(r) for r in sorted(got.collect())] == [tuple(r) for r in want] and any(r.before_sha256 is None for r in want)
    assert plan(QUERIES["snapshot_changed"](spark, DATA)).count("FileScan") == 1


def test_points_meet_narrow_bars(spark):
    text = plan(QUERIES["bars_at_points"](spark, DATA))
    assert "input_fingerprint" not in text and "quality_status" not in text


def test_doubles_are_not_read_from_their_texts(spark):
    rows = spark.createDataFrame([(1.5, "2,5", "-"), (float("nan"), "x", ""), (-0.0, "-0", None)], "open double, high string, close string")
    blank = {c: F.lit(None).cast("timestamp" if c.endswith("_at") or c.endswith("_time") else "string") for c in (*ingest.REQUIRED, *ingest.NUMBERS) if c not in rows.columns}
    out = ingest.normalize_bars(rows.withColumns(blank))
    assert [(str(r.open), r.high, r.close) for r in out.collect()] == [("1.5", 25.0, None), ("None", None, None), ("-0.0", 0.0, None)]
    assert "open" not in out.select("error").first().error.split("missing: ")[1].split(", ")
    text = plan(rows.withColumns(blank).transform(ingest.normalize_bars).select("open"))
    assert "regexp_replace" not in text


def test_a_first_batch_is_not_joined_with_itself(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(raw_bars(60, 5), RAW)
    seen = []
    monkeypatch.setattr(upkeep.canonical, "canonical_bars", lambda held, **more: seen.append(plan(held)) or canonical_bars(held, **more))
    upkeep.refresh(rows, 0, str(tmp_path), buckets=2)
    upkeep.refresh(rows, 1, str(tmp_path), buckets=2)
    assert "Join" not in seen[0] and "Join" in seen[1]
    assert upkeep.read_canonical(spark, str(tmp_path)).count() == canonical_bars(rows).count()


def test_a_rebuild_takes_one_shuffle_of_raw_rows(spark):
    rows, late = bars.raw(spark, DATA), F.col("ingested_at") >= bars.ntz("2000-01-01 00:00:00")
    existing = canonical_bars(rows.where(~late)).withColumn("version", F.lit(1).cast("long"))
    want = canonical.incremental_rebuild(rows, existing, canonical.dirty_ranges(rows.where(late)))
    got = canonical.rebuilt(rows, late).select(*want.columns)
    lines = lambda d: sorted(r.x for r in d.select(F.to_json(F.struct(*d.columns)).alias("x")).collect())
    assert lines(got) == lines(want)
    assert plan(QUERIES["incremental_rebuild"](spark, DATA)).count("REPARTITION_BY_COL") == 1


def test_only_needed_columns_are_shuffled(spark):
    for name, unread in (("dataset_diff", "l_tax"), ("asof_join", "l_linestatus"), ("dataset_identity", "raw_close"), ("quality_status", "raw_close"), ("historical_bar", "raw_close"), ("rows_by_layer", "l_tax")):
        assert unread not in plan(QUERIES[name](spark, DATA)), name


def test_hashes_are_shuffled_as_bytes(spark):
    rows = bars.identified(bars.canon(spark, DATA)).select(inventory._lines(bars.IDENTIFIED, "bar_time").alias("x"))
    assert dict(rows.select("x.*").dtypes)["h"] == "binary"


def test_an_as_of_join_finds_bars_where_they_were_chosen(spark):
    for name in ("asof_join", "asof_join_all", "bars_at_points"):
        text = plan(QUERIES[name](spark, DATA))
        assert text.count("Exchange") == text.count("REPARTITION_BY_COL") == 2, name  # raw bars and points, no canonical bars
        assert "raw_artifact_id" not in text and "source_sequence" not in text, name


def test_bars_in_spans_give_the_same_matches(spark):
    rows = spark.createDataFrame(raw_bars(400, 7), RAW)
    rows = rows.unionByName(rows.withColumns({"bar_time": F.col("bar_time") + F.expr("INTERVAL 36 SECONDS"), "close": F.col("close") + 1}))
    points = rows.select("symbol", (F.col("bar_time") + F.expr("INTERVAL 30 SECONDS")).alias("t"), F.monotonically_increasing_id().alias("i"))
    points = points.unionByName(spark.createDataFrame([("none", None, -1)], "symbol string, t timestamp, i long").select("symbol", F.col("t").cast(dict(points.dtypes)["t"]), "i"))
    for tolerance in (0, 1, 40, 86_400):
        want = asof.asof_join(points, canonical_bars(rows).select("symbol", "bar_time", "close"), ["symbol"], "t", "bar_time", ["close"], tolerance)
        chosen = canonical_bars(asof.in_spans(rows, "bar_time", tolerance), columns=["close"], deal=("symbol", "_span"), key=(*CANONICAL_KEY, "_span"))
        got = asof.asof_join(points, chosen, ["symbol"], "t", "bar_time", ["close"], tolerance, spanned=True)
        lines = sorted(map(str, got.select(*want.columns).collect()))
        assert lines == sorted(map(str, want.collect())) and len(lines) == 801


def test_wanted_columns_alone_are_chosen_alike(spark):
    rows = spark.createDataFrame(raw_bars(300, 3), RAW)
    whole = canonical_bars(rows)
    for columns in (["close"], ["close", "content_rank"], ["raw_artifact_id", "updated_at"], ["input_fingerprint"], ["quality_status", "source_count"]):
        got = canonical_bars(rows, columns=columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*got.columns).collect())), columns


def test_ranks_of_any_text_keep_their_order(spark):
    ranks = ["", "0", "00", "0a", "0A", "0b1", "ab", "abcd", "Abcd", "g1", "zz", "é0", None, "ab\n", "ff" * 26]
    rows = spark.createDataFrame(raw_bars(1, 1)[:1], RAW).drop("content_rank").crossJoin(spark.createDataFrame([(n, r) for n, r in enumerate(ranks)], "n int, content_rank string"))
    pairs = spark.createDataFrame([(f"S{a}-{b}", n) for a in range(len(ranks)) for b in range(a) for n in (a, b)], "name string, n int")
    both = rows.join(pairs, "n").withColumn("symbol", F.col("name")).drop("name", "n")
    got = {r.symbol: r.content_rank for r in versions.latest_raw(both).collect()}
    assert got == {f"S{a}-{b}": max((ranks[a], ranks[b]), key=lambda x: (x is not None, (x or "").encode())) for a in range(len(ranks)) for b in range(a)}
    assert "_digits" in plan(versions.latest_raw(both))
