from pyspark.sql import functions as F

from tideframe.llm import url_model as u


def test_hosts_paths_and_rules(spark):
    urls = ["http://WWW.Example.com/en/71?q#f", "https://x.com/en/1", "https://a.example.net/de/8x", "https://b.net/de/9", "nothing", None, "ftp://org/es/", "http://h?x=/en/", "a://b://c/d", "http://notcom/en/", "http://x.example.com/en/7"]
    frame = spark.createDataFrame([(i, x, "z") for i, x in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(frame).collect()}
    assert got[0] == ("www.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[1] == ("x.com", "/en/1", "com/en/", "block")
    assert got[2] == ("a.example.net", "/de/8x", "example.net/de/8", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[6] == ("org", "/es/", "org/es/", "block")
    assert got[4][:3] == got[5][:3] == ("", "", None) and got[7][:3] == ("h", "", None)
    assert got[8][:2] == ("b:", "//c/d") and got[9][2] is None and got[10][2] == "example.com/en/7"


def test_unseen_urls_follow_their_class(spark):
    rows = [(i, f"http://s{i}.com/en/{'spam' if i % 2 else 'page'}-cheap-{i}") for i in range(200)] + [(1000 + i, f"http://t{i}.net/de/artikel-gut-{i}") for i in range(200)]
    rows += [(5000 + i, f"http://v{i}.info/x/spam-cheap-{i}") for i in range(20)] + [(6000 + i, f"http://v{i}.info/x/artikel-gut-{i}") for i in range(20)]
    frame = spark.createDataFrame([*rows, rows[-1], (None, rows[-1][1])], "page_id long, url string")
    got = u.judge(frame).where("rule IS NULL").select("page_id", "verdict").collect()
    assert all(r.verdict == ("block" if r.page_id is not None and r.page_id < 6000 else "allow") for r in got) and len(got) == 42
    plan = u.judge(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert u.judge(frame.limit(0)).count() == 0
    assert u.judge(frame.where("page_id >= 5000")).where("verdict <> 'allow'").count() == 0  # nothing to learn from


def test_grams(spark):
    got = spark.range(1).select(u.grams(F.lit("abc"), 3).alias("g"), u.grams(F.lit(""), 3).alias("e")).first()
    assert got.g == ["\u0002\u0002a", "\u0002ab", "abc"] and got.e == []


def test_very_long_and_empty_urls(spark):
    rows = [(i, f"http://s{i}.com/en/spam-{i}") for i in range(40)] + [(100 + i, f"http://t{i}.net/de/gut-{i}") for i in range(40)]
    long = "http://u.info/" + "gut-" * 20_000
    rows += [(200, long), (201, ""), (202, "http://u.info/" + "spam-" * 20_000), (203, "://"), (204, long)]
    got = {r.page_id: (r.host, len(r.path), r.verdict) for r in u.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 200").collect()}
    assert got[200] == got[204] == ("u.info", 80_001, "allow") and got[202][2] == "block"
    assert got[201][:2] == got[203][:2] == ("", 0)
