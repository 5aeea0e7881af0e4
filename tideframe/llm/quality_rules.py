"""Quality rules: decision lists learned by sequential covering from labelled statistics.

learn() is a covering learner in the manner of IREP: a rule for poor documents is grown condition by condition
on one part of the labelled rows (information gain), pruned on the other, and kept while it is precise there;
what it covers leaves the rows and the next rule is sought. The rules stay readable ("symbol_share >= 0.07 and
mean_word <= 9.1"), and verdict() makes one ordered Spark conditional expression of them.

Defined cases: a null or empty text has all statistics 0 and fails the base. Labels that are null, or of
documents that don't exist, are left out; with no labels, or labels of one class, no rule is learned and the base
alone decides. Very long texts are counted whole. Repeated rows get equal verdicts; an empty table gives an empty result. Extra columns don't matter; columns of documents aren't changed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_bytes", "n_lines", "n_twins", "n_distinct_words", "n_upper", "n_marks", "n_digits"]
SHARES = ["symbol_share", "dup_line_share", "repeat_share", "twin_share", "distinct_share", "upper_share", "mark_share", "digit_share", "mean_word", "words_by_line", "log_words"]
STATISTICS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS + MORE])


def counts(data: bytes, n_chars: int) -> tuple[int, ...]:
    """The statistics of one text, in the order of COUNTS + MORE. Words are runs without ASCII white space."""
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            twice = {w for w, k in seen.items() if k > 1}
            stop = 0  # first position not yet counted
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 3 - max(i, stop)
                    stop = i + 3
    return (
        n,
        n_chars - (len(data) - len(joined)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(data),
        len(lines),
        sum(map(eq, words, words[1:])),
        len(set(words)),
        len(data) - len(data.translate(None, UPPER)),
        data.count(b"!") + data.count(b"?"),
        len(data) - len(data.translate(None, b"0123456789")),
    )


def with_statistics(frame: DataFrame, text: str = "text") -> DataFrame:
    """frame and the statistics of its column text, or of the field text of its struct column row. Other columns pass through as they are."""
    schema = T.StructType([*frame.schema.fields, *STATISTICS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                index = part.schema.get_field_index(text)
                column = part.column(index) if index >= 0 else pc.struct_field(part.column(part.schema.get_field_index("row")), text)
                chars = pc.utf8_length(column).to_pylist()
                only = pa.RecordBatch.from_arrays([column], names=[text])
                rows = [counts(data, chars[i] or 0) for i, data in enumerate(common.utf8(only, text))]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True))], names=schema.names)

    common.ship(frame.sparkSession)
    return frame.mapInArrow(common.released(run), schema)


def shares() -> dict[str, Column]:
    """Size-free statistics, as expressions over the counts."""
    c = {k: F.col(k).cast("double") for k in COUNTS + MORE}
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbol_share": over(c["n_symbols"], c["word_chars"]),
        "dup_line_share": over(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": over(c["n_repeat_words"], c["n_words"]),
        "twin_share": over(c["n_twins"], c["n_words"]),
        "distinct_share": over(c["n_distinct_words"], c["n_words"]),
        "upper_share": over(c["n_upper"], c["word_chars"]),
        "mark_share": over(c["n_marks"], c["n_words"]),
        "digit_share": over(c["n_digits"], c["word_chars"]),
        "mean_word": over(c["word_chars"], c["n_words"]),
        "words_by_line": over(c["n_words"], c["n_lines"]),
        "log_words": F.log2(c["n_words"] + 1),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value:.6g}"

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, SHARES.index(self.feature)]
        return column >= self.value if self.at_least else column <= self.value

    def expression(self) -> Column:
        column = shares()[self.feature]
        return column >= F.lit(self.value) if self.at_least else column <= F.lit(self.value)


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _best_condition(x: np.ndarray, y: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the largest gain of information on the rows that the rule still covers."""
    p0, n0 = int(y.sum()), int((~y).sum())
    base = math.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (1e-9, None)
    for k, name in enumerate(SHARES):
        order = np.argsort(x[:, k], kind="stable")
        v, t = x[order, k], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1])  # a threshold lies between two different values
        if not len(cut):
            continue
        below_p = np.cumsum(t)[cut]
        below_n = cut + 1 - below_p
        middle = (v[cut] + v[cut + 1]) / 2
        for at_least, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = float(gain[i]), Condition(name, at_least, float(middle[i]))
    return best


def grow(x: np.ndarray, y: np.ndarray, most: int = 4) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(y), bool)
    while len(rule) < most and (~y[inside]).any() and y[inside].any():
        _, condition = _best_condition(x[inside], y[inside])
        if condition is None:
            break
        rule += (condition,)
        inside &= condition.holds(x)
    return rule


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The prefix of the rule with the largest (p - n) / (p + n) on rows that it wasn't grown on; the shorter one on ties."""
    best, value = rule, -2.0
    for k in range(1, len(rule) + 1):
        hit = covered(rule[:k], x)
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > value:
            best, value = rule[:k], worth
    return best


def learn(x: np.ndarray, poor: np.ndarray, precision: float = 0.9, least: int = 4, most: int = 24) -> list[Rule]:
    """Ordered rules for poor rows. Rows alternate between growing and pruning, anew for each rule."""
    rules: list[Rule] = []
    left = np.ones(len(poor), bool)
    misses = 0
    for turn in range(4 * most):
        rows = np.flatnonzero(left)
        y = poor[rows]
        if y.sum() < least or y.all() or len(rules) == most or misses == 4:
            break
        part = (np.arange(len(rows)) * 2654435761 + turn * 40503) % 4294967296 % 3 == 0  # a third prunes
        rule = prune(grow(x[rows][~part], y[~part]), x[rows][part], y[part]) if y[~part].any() else ()
        hit = covered(rule, x[rows]) if rule else np.zeros(len(rows), bool)
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        held_p, held_n = int((hit & y & part).sum()), int((hit & ~y & part).sum())
        if p < least or p < precision * (p + n) or held_p < precision * (held_p + held_n):
            misses += 1
            continue
        misses = 0
        rules.append(rule)
        left[rows[hit]] = False
    return rules


def labelled(documents: DataFrame, labels: DataFrame, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and verdicts of at most `most` labelled documents, taken by a hash of their ids; repeated rows count once.

    This bound, on labels and on rows, is what makes it safe to send the chosen labels to all tasks and the statistics to the driver.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = with_statistics(docs).select("doc_id", "quality", *(e.alias(k) for k, e in shares().items()))
    table = rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", *SHARES).limit(most).toPandas().sort_values(["doc_id", *SHARES], kind="stable")
    return table[SHARES].to_numpy(float).reshape(-1, len(SHARES)), table["quality"].to_numpy() == 0


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """kept, and the number of the rule that decided (0: the base, null: none), as ordered conditional expressions."""
    kept, number = F.when(base_failed(), F.lit(False)), F.when(base_failed(), F.lit(0))
    for i, rule in enumerate(rules, 1):
        both = rule[0].expression()
        for condition in rule[1:]:
            both = both & condition.expression()
        kept, number = kept.when(both, F.lit(False)), number.when(both, F.lit(i))
    return kept.otherwise(F.lit(True)), number


def judge(documents: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """row (a struct of the document's columns), the statistics, base_failed, kept, and rule, the number of the rule that decided."""
    kept, number = verdict(learn(*labelled(documents, labels, most)))
    rows = with_statistics(documents.select(F.struct(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in documents.columns)).alias("row")))
    return rows.withColumns({"base_failed": base_failed(), "kept": kept, "rule": number})


def passing(documents: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """The documents that the base and the learned rules keep."""
    return judge(documents, labels, most).where("kept").select("row.*")
