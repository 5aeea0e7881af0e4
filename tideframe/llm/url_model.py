"""URL filters: rules first, then the likelihood ratio of two character models, with DataFrame functions only.

A rule names a host (and its subdomains) and the beginning of a path; the longest rule that fits decides. URLs that a
rule decides train two variable-order Markov models of characters, one of accepted and one of rejected URLs. Each
order's estimate is smoothed towards the next lower one (Witten-Bell: the more different characters follow
a context, the more weight the lower order gets), down to a uniform one. Other URLs get the difference of the models'
log-likelihoods, divided by length; it is compared with the middle between both classes' means on a quarter
of the training URLs that the models haven't seen.

The models are tables of distinct character n-grams: URLs meet them in one equi-join after identical URLs have been
made one. Log-likelihoods are whole micro-nats, so sums don't depend on their order.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule and is allowed by the method, as
is any URL that isn't decided because a class has no training URL. Repeated rows get equal verdicts; null page_ids and
extra columns pass through; an empty table gives an empty result. Very long URLs count whole, an n-gram for each character; an empty one is one without "://".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm import common

# Fixed values: (rule, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
ORDER = 5  # characters of the longest n-gram, the last one being predicted
ALPHABET = 256.0
PAD = "\u0002"
MODEL_ROWS = 1_000_000  # n-grams up to which the models are sent to all tasks


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits, as one ordered conditional expression each."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda x: len(x[0])):  # a longer rule stands before shorter ones
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(text: Column, order: int) -> Column:
    """All character n-grams of the padded text, one for each of its characters."""
    chars = F.split(F.concat(F.lit(PAD * (order - 1)), text), "")
    last = F.char_length(text) - 1
    # The outer transform holds the characters, so that they are split once for each text.
    cut = F.flatten(F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(*(F.get(c, i + k) for k in range(order))))))
    return F.when(last >= 0, cut).otherwise(F.array().cast("array<string>"))


def gram_scores(every: DataFrame, trained: DataFrame, order: int) -> DataFrame:
    """(gram, score) of every distinct gram: log of accepted over rejected probability of its last character, in micro-nats.

    trained: (gram, yes, no), how often each gram occurs in accepted and in rejected training URLs.
    """
    table = every.select("gram")
    p_yes = p_no = F.lit(1 / ALPHABET)
    for k in range(order):  # k characters of context
        part = trained.groupBy(F.expr(f"right(gram, {k + 1})").alias("part")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        context = part.groupBy(F.expr("left(part, length(part) - 1)").alias("context")).agg(
            F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"), F.count_if(F.col("yes") > 0).alias("kinds_yes"), F.count_if(F.col("no") > 0).alias("kinds_no")
        )
        part = part.withColumn("context", F.expr("left(part, length(part) - 1)")).join(context, "context")
        part = part.select("part", *(F.col(c).alias(f"{c}{k}") for c in ("yes", "no")))
        context = context.select("context", *(F.col(c).alias(f"{c}{k}") for c in ("all_yes", "all_no", "kinds_yes", "kinds_no")))
        table = table.withColumn("part", F.expr(f"right(gram, {k + 1})")).withColumn("context", F.expr(f"left(right(gram, {k + 1}), {k})"))
        table = table.join(part, "part", "left").join(context, "context", "left").drop("part", "context")
        estimates = []
        for c, lower in (("yes", p_yes), ("no", p_no)):
            n, total, kinds = (F.coalesce(f"{x}{k}", F.lit(0)) for x in (c, f"all_{c}", f"kinds_{c}"))
            estimates.append(F.when(total > 0, (n + kinds * lower) / (total + kinds)).otherwise(lower))
        table = table.select("gram", estimates[0].alias("p_yes"), estimates[1].alias("p_no"))
        p_yes, p_no = F.col("p_yes"), F.col("p_no")
    return table.select("gram", F.round(F.log(p_yes / p_no) * 1e6).cast("long").alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """pages with host, path, rule, score (micro-nats by character; null where a rule decides) and verdict."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    parts = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host, "path": path})
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "_says": says})
    # Identical URLs are one: the group is combined before its shuffle.
    urls = parts.select(F.concat("host", "path").alias("url"), "host", "path").distinct().withColumn("says", fitting_rule(F.col("host"), F.col("path"), rules)[1])
    urls = common.written(urls.groupBy("url").agg(F.max("says").alias("says")).where("url <> ''").withColumn("seen", ~F.substring(F.md5("url"), 1, 1).isin("0", "1", "2", "3")))
    # The table of URLs is small next to its n-grams: it is dealt out anew before these are made.
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = urls.repartition(n).select("url", "says", "seen", F.explode(grams(F.col("url"), order)).alias("gram"))
    counted = each.groupBy("gram").agg(F.count_if(F.expr("seen AND says = 'allow'")).alias("yes"), F.count_if(F.expr("seen AND says = 'block'")).alias("no"), F.max(F.col("says").isNull() | ~F.col("seen")).alias("asked"))
    counted = common.written(counted)
    scores = common.written(gram_scores(counted.where("asked"), counted.where("yes + no > 0").drop("asked"), order))
    scores = common.sent(scores, MODEL_ROWS)
    wanted = each.where("says IS NULL OR NOT seen").join(scores, "gram")
    scored = common.written(wanted.groupBy("url", "says").agg(F.floor(F.sum("score") / F.count("*")).cast("long").alias("score")))
    middle = scored.agg(*(F.avg(F.when(F.col("says") == x, F.col("score"))).alias(x) for x in ("allow", "block"))).first()
    least = None if middle.allow is None or middle.block is None else (middle.allow + middle.block) / 2
    own = scored.where("says IS NULL").select(F.col("url").alias("_url"), "score")
    judged = parts.withColumn("_key", F.when(F.col("rule").isNull(), F.concat("host", "path"))).join(own, F.col("_key") == F.col("_url"), "left").drop("_url", "_key")
    by_score = F.lit("allow") if least is None else F.when(F.col("score") < F.lit(least), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("_says", by_score)).drop("_says")


def _oracle() -> str:
    """The same in DuckDB's SQL."""
    steps, before_yes, before_no, source = [], f"{1 / ALPHABET!r}", f"{1 / ALPHABET!r}", "asked"
    for k in range(ORDER):
        steps.append(
            f"""
part{k} AS (SELECT right(gram, {k + 1}) AS part, sum(yes) AS yes, sum(no) AS no FROM counted WHERE yes + no > 0 GROUP BY 1),
context{k} AS (SELECT left(part, {k}) AS context, sum(yes) AS all_yes, sum(no) AS all_no, count(*) FILTER (yes > 0) AS kinds_yes, count(*) FILTER (no > 0) AS kinds_no FROM part{k} GROUP BY 1),
p{k} AS (SELECT t.gram,
  CASE WHEN coalesce(c.all_yes, 0) > 0 THEN (CAST(coalesce(p.yes, 0) AS DOUBLE) + CAST(c.kinds_yes AS DOUBLE) * {before_yes}) / CAST(c.all_yes + c.kinds_yes AS DOUBLE) ELSE {before_yes} END AS p_yes,
  CASE WHEN coalesce(c.all_no, 0) > 0 THEN (CAST(coalesce(p.no, 0) AS DOUBLE) + CAST(c.kinds_no AS DOUBLE) * {before_no}) / CAST(c.all_no + c.kinds_no AS DOUBLE) ELSE {before_no} END AS p_no
  FROM {source} t LEFT JOIN part{k} p ON p.part = right(t.gram, {k + 1}) LEFT JOIN context{k} c ON c.context = left(right(t.gram, {k + 1}), {k}))"""
        )
        before_yes, before_no, source = "t.p_yes", "t.p_no", f"p{k}"
    cases = lambda value: " ".join(f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '/{s}') THEN '{value(t, v)}'" for t, v in sorted(RULES, key=lambda x: -len(x[0])) for n, _, s in [t.partition("/")])
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE {cases(lambda t, v: t)} END AS rule, CASE {cases(lambda t, v: v)} END AS says FROM split),
urls AS (SELECT concat(host, path) AS url, max(says) AS says, substr(md5(concat(host, path)), 1, 1) NOT IN ('0', '1', '2', '3') AS seen FROM ruled WHERE concat(host, path) <> '' GROUP BY 1),
each AS (SELECT url, says, seen, unnest(list_transform(range(1, CAST(length(url) + 1 AS BIGINT)), lambda i: substr(concat(repeat(chr(2), {ORDER - 1}), url), i, {ORDER}))) AS gram FROM urls),
counted AS (SELECT gram, count(*) FILTER (seen AND says = 'allow') AS yes, count(*) FILTER (seen AND says = 'block') AS no, bool_or(says IS NULL OR NOT seen) AS asked FROM each GROUP BY 1),
asked AS (SELECT gram FROM counted WHERE asked),
{','.join(steps)},
scores AS (SELECT gram, CAST(round(ln(p_yes / p_no) * 1e6) AS BIGINT) AS score FROM p{ORDER - 1}),
scored AS (SELECT url, says, CAST(floor(sum(score) / count(*)) AS BIGINT) AS score FROM each JOIN scores USING (gram) WHERE says IS NULL OR NOT seen GROUP BY url, says),
middle AS (SELECT (avg(score) FILTER (says = 'allow') + avg(score) FILTER (says = 'block')) / 2 AS least FROM scored)
SELECT page_id, host, path, rule, coalesce(r.says, CASE WHEN s.score < (SELECT least FROM middle) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN scored s ON s.url = concat(host, path) AND s.says IS NULL AND r.rule IS NULL
"""


ORACLE_SQL = _oracle()
