"""Personal data: base spans by pattern, and terms that disclose a protected entity.

A value found by a base pattern (an address, a number) is a protected entity. Corpus co-occurrence says how much a
term in the same text gives away: over all documents, a term t discloses entity e to the share PMI(e; t) / IC(e) of the
entity's information content, that is 1 - log P(e | t) / log P(e). All counts are of distinct texts, so copies of a
text neither add to a share nor take from it. Entity and term must share at least `support` distinct texts, in as many
different contexts (the words around the entity and around the term: what always stands in the same formula is no
evidence). Terms above `remove` go, those above `generalise` are replaced by their shape, wherever they stand in a text
that holds the entity, however far from it.

Defined cases: a null text is empty and has no spans; texts are searched whole, in one pass however long they are. Repeated rows get equal spans, extra
columns stay untouched, an empty table gives an empty result. With no term above the thresholds the base spans stand.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common

KINDS = ("email", "ip", "card", "phone")
NEAR = 3  # words on either side of an entity or a term that are its context
TERM_ROWS = 200_000  # candidate terms, or texts, up to which they are sent to all tasks
PAIRS_HELD = 100_000  # (entity, term) sums that a task holds before it passes them on

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_key", T.LongType()),
        *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
        T.StructField("spans", T.ArrayType(_SPAN)),
        T.StructField("entities", T.ArrayType(T.LongType())),
    ]
)


def luhn(digits: str) -> bool:
    total = sum(int(x) for x in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern. Only the run of characters before an @ can begin one."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield start, (done := found.end())
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def entity_of(text: str, span: tuple[str, int, int]) -> int:
    return xxhash.xxh3_64_intdigest(f"{span[0]}:{text[span[1] : span[2]].lower()}") - (1 << 63)


def term_of(word: str) -> str:
    return word.strip(".,;:!?\"'()").lower()


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words of a text that no span touches."""
    edges = sorted((a, b) for _, a, b in spans)
    at = done = 0
    for m in _WORD.finditer(text):
        while at < len(edges) and edges[at][0] < m.end():
            done = max(done, edges[at][1])
            at += 1
        if done > m.start():
            continue
        term = term_of(m[0])
        if len(term) > 2 and any(x.isalnum() for x in term):
            yield term, m.start(), m.end()


def around(text: str, start: int, end: int) -> str:
    """The NEAR whole words on either side of a place, however long they are."""
    before: list[str] = []
    size = 64
    while start > 0:
        before = _WORD.findall(text, max(0, start - size), start)
        if len(before) > NEAR or size >= start:  # of more than NEAR, the last ones are whole
            break
        size *= 4
    after = [m[0] for m in islice(_WORD.finditer(text, end), NEAR)]
    return "\n".join([*before[-NEAR:], "", *after])


def find(documents: DataFrame) -> DataFrame:
    """Counts, base spans and their entities of each document, as a written table."""

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, key, text in zip(common.values(batch, "doc_id"), common.values(batch, "text_key"), common.texts(batch, "text"), strict=True):
            spans = base_spans(text)
            count = Counter(k for k, _, _ in spans)
            yield (doc_id, key, *(count[k] for k in KINDS), [dict(zip(_SPAN.names, x, strict=True)) for x in spans], [entity_of(text, x) for x in spans])

    common.ship(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return common.written(docs.mapInArrow(common.arrow_rows(FOUND, run), FOUND))


def with_copies(documents: DataFrame, found: DataFrame) -> DataFrame:
    """text_key, text and copies, the number of rows with that text."""
    copied = common.written(found.groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1"))
    copied = common.sent(copied, TERM_ROWS)
    docs = documents.select(F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return docs.join(copied, "text_key", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) for the given terms: in how many distinct texts each occurs. Each copy adds its part of one; tasks add up their own documents first."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.DoubleType())])
    few = common.small_enough(terms, TERM_ROWS)
    wanted = spark.sparkContext.broadcast({r.term for r in terms.collect()} if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value
        for batch in batches:
            total: dict[str, float] = {}
            for text, copies in zip(common.texts(batch, "text"), common.values(batch, "copies"), strict=True):
                words = {term_of(w) for w in _WORD.findall(text)}
                for w in words if only is None else words & only:
                    total[w] = total.get(w, 0.0) + 1 / copies
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.float64())], names=schema.names)

    if few and not wanted.value:
        return spark.createDataFrame([], "term string, n long")
    counted = docs.select("text", "copies").mapInArrow(common.released(run), schema)
    return (counted if few else counted.join(terms, "term", "left_semi")).groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n"))


def beside(docs: DataFrame, side: DataFrame) -> DataFrame:
    """docs with the columns of a written side that has a row for some of the text keys."""
    return docs.join(common.sent(side, TERM_ROWS), "text_key")


def pair_counts(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """(entity, term, both): in how many distinct texts each term of the whole text occurs with each of the given entities."""
    schema = T.StructType([T.StructField("entity", T.LongType()), T.StructField("term", T.StringType()), T.StructField("both", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str], float] = {}

        def pack() -> pa.RecordBatch:
            arrays = [pa.array([e for e, _ in total], pa.int64()), pa.array([t for _, t in total], pa.string()), pa.array(list(total.values()), pa.float64())]
            total.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            for text, copies, entities in zip(common.texts(batch, "text"), common.values(batch, "copies"), common.values(batch, "entities"), strict=True):
                terms = {t for t, _, _ in terms_of(text, base_spans(text))}
                for entity in entities:
                    for t in terms:
                        total[entity, t] = total.get((entity, t), 0.0) + 1 / copies
                    if len(total) >= PAIRS_HELD:
                        yield pack()
        if total:
            yield pack()

    counted = beside(docs, holders).select("text", "copies", "entities").mapInArrow(common.released(run), schema)
    return counted.groupBy("entity", "term").agg(F.round(F.sum("both")).cast("long").alias("both"))


def disclosing(documents: DataFrame, found: DataFrame, support: int = 3, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """(entity, term, share, action) of terms that disclose an entity beyond a threshold, whatever their contexts."""
    held = found.select("text_key", F.explode(F.array_distinct("entities")).alias("entity")).distinct()
    entities = common.written(held.groupBy("entity").agg(F.count("*").alias("with_entity")).where(F.col("with_entity") >= support))
    holders = common.written(held.join(entities, "entity").groupBy("text_key").agg(F.collect_list("entity").alias("entities")))
    docs = with_copies(documents, found)
    pairs = common.written(pair_counts(docs, holders).where(F.col("both") >= support))
    terms = document_counts(docs, common.written(pairs.select("term").distinct()))
    n = found.select("text_key").distinct().count()
    joined = pairs.join(entities, "entity").join(terms, "term")
    given = F.least(F.lit(1.0), F.col("both") / F.greatest("n", "both"))
    information = -F.log(F.least(F.lit(1.0), F.col("with_entity") / F.lit(float(max(n, 1)))))
    share = F.when(information > 0, 1 + F.log(given) / information).otherwise(F.lit(0.0))
    action = F.when(F.col("share") >= remove, "removed").when(F.col("share") >= generalise, "generalised")
    return joined.withColumn("share", share).withColumn("action", action).where("action IS NOT NULL").select("entity", "term", "share", "action")


def occurrences(documents: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_key, entity, term, action, context, places) of each disclosing term in a text that holds its entity: all its places."""
    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text_key", T.LongType()),
            T.StructField("entity", T.LongType()),
            T.StructField("term", T.StringType()),
            T.StructField("action", T.StringType()),
            T.StructField("context", T.LongType()),
            T.StructField("places", T.ArrayType(place)),
        ]
    )
    held = found.select("text_key", F.explode(F.array_distinct("entities")).alias("entity")).distinct()
    wanted = common.written(held.join(terms, "entity").groupBy("text_key").agg(F.collect_list(F.struct("entity", "term", "action")).alias("wanted")))

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, key, text, pairs in zip(common.values(batch, "doc_id"), common.values(batch, "text_key"), common.texts(batch, "text"), common.values(batch, "wanted"), strict=True):
            spans, only = base_spans(text), {x["term"] for x in pairs}
            first: dict[int, tuple[int, int]] = {}
            for span in spans:
                first.setdefault(entity_of(text, span), span[1:])
            places: dict[str, list[dict]] = {}
            for term, start, end in terms_of(text, spans):
                if term in only:
                    places.setdefault(term, []).append({"start": start, "end": end})
            for x in pairs:
                if x["term"] in places:
                    at = places[x["term"]]
                    context = around(text, *first[x["entity"]]) + "\n\n" + around(text, at[0]["start"], at[0]["end"])
                    yield doc_id, key, x["entity"], x["term"], x["action"], xxhash.xxh3_64_intdigest(context) - (1 << 63), at

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return common.written(beside(docs, wanted).mapInArrow(common.arrow_rows(schema, run), schema))


def with_spans(documents: DataFrame, support: int = 3, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """doc_id, text_key, counts of the base kinds, base (their spans) and more (spans of disclosing terms) of each row."""
    found = find(documents)
    at = occurrences(documents, found, common.written(disclosing(documents, found, support, generalise, remove)))
    known = at.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= support)
    added = at.join(known, ["entity", "term"], "left_semi").select("doc_id", "text_key", "action", F.explode("places").alias("x"))
    added = added.groupBy("doc_id", "text_key", F.col("x.start").alias("start"), F.col("x.end").alias("end")).agg(F.max("action").alias("kind"))
    added = added.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    joined = found.drop("entities").join(added, found.doc_id.eqNullSafe(F.col("_id")) & (found.text_key == F.col("_key")), "left").drop("_id", "_key")
    return joined.withColumn("more", F.coalesce("more", F.expr("array()").cast("array<struct<kind:string,start:bigint,end:bigint>>"))).withColumnRenamed("spans", "base")


def written_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with its spans replaced: base kinds and generalised terms by a label or shape, removed terms by nothing. Spans that touch each other go as one."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if end <= done:
            continue
        if start >= done:
            out.append(text[done:start])
            if kind == "generalised":
                out.append("<NUMBER>" if text[start:end].strip(".,;:").isdigit() else "<TERM>")
            elif kind != "removed":
                out.append(f"<{kind.upper()}>")
        done = end
    return "".join([*out, text[done:]])


def sanitise(documents: DataFrame, support: int = 3, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """documents with their texts' spans replaced; texts without spans stay as they are."""
    spans = with_spans(documents, support, generalise, remove)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.concat("base", "more").alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_id", "_key"])
    spans = common.written(spans)
    side = common.sent(spans, TERM_ROWS)
    columns = documents.columns
    keyed = documents.withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left").select(*columns, "_spans")
    at, schema = columns.index("text"), documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                got = [t if not s or t is None else masked(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(part.column(at).to_pylist(), common.values(part, "_spans"), strict=True)]
                arrays = [part.column(i) if i != at else pa.array(got, part.column(i).type) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    touched = joined.where("_spans IS NOT NULL").mapInArrow(common.released(run), schema)
    return joined.where("_spans IS NULL").select(*columns).union(touched)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
