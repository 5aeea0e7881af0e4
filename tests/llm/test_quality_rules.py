import random
import re

import numpy as np
from pyspark.sql import functions as F

from tideframe.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_of_random_texts():
    r = random.Random(2)
    for _ in range(600):
        text = "".join(r.choice(["a ", "b ", "é\t", "c\n", "\n", "#", "| ", "word ", " "]) for _ in range(r.randrange(0, 60)))
        assert q.counts(text.encode(), len(text))[:5] == brute(text), text


def test_rules_find_planted_conjunctions():
    r = np.random.default_rng(1)
    x = r.random((4000, len(q.SHARES)))
    poor = (x[:, 0] > 0.8) & (x[:, 5] < 0.5) | (x[:, 2] > 0.95)
    rules = q.learn(x, poor)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= q.covered(rule, x)
    assert (hit & poor).sum() > 0.95 * poor.sum() and (hit & ~poor).sum() < 0.02 * (~poor).sum()
    assert q.learn(x, np.zeros(4000, bool)) == [] and q.learn(x[:0], poor[:0]) == []


def test_held_out_accuracy_and_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    judged = q.judge(docs, labels.where(fold == 0)).select("row.doc_id", "kept", "base_failed").join(labels.where(fold == 1), "doc_id")
    rows = judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[0] < 0.05 and kept[1] > 0.9
    clean = judged.where("quality = 1 AND NOT base_failed").agg(F.avg(F.col("kept").cast("int")).alias("kept")).first().kept
    assert clean > 0.98


def test_nulls_labels_and_clashing_columns(spark):
    rows = [(1, None, 7), (2, "", 7), (None, "w " * 60, 7), (1, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(1, None), (99, 0), (None, 1)], "doc_id long, quality int")
    got = q.judge(docs, labels).collect()
    assert [r.kept for r in got] == [False] * 4
    long = spark.createDataFrame([(5, " ".join(f"word{i}" for i in range(80)), 7)], "doc_id long, text string, n_words int")
    assert q.passing(long, labels).collect()[0].n_words == 7
    assert q.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_very_long_texts_and_empty_tables(spark):
    from tideframe.llm import quality_rules as q

    long = " ".join(f"word{i}" for i in range(300_000)) + "\nagain\nagain"
    docs = spark.createDataFrame([(1, long, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.row.doc_id: r for r in q.judge(docs.select("doc_id", "text"), labels).collect()}
    assert (got[1].n_words, got[1].n_dup_lines, got[1].base_failed, got[1].kept) == (300_002, 1, False, True)
    assert all((got[i].n_words, got[i].base_failed, got[i].kept) == (0, True, False) for i in (2, 3))
    assert q.judge(docs.select("doc_id", "text").limit(0), labels).count() == 0 and q.passing(docs, labels).columns == docs.columns
