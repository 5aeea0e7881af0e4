import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_ngram_join import shingles
from tests.llm.test_pii import brute as base_spans
from tideframe.llm import bpe, mixing, pii, quality_rules

DATA = "/root/testdata/sf0.001"


def test_the_pipeline_against_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rules = quality_rules.learn(*quality_rules.labelled(spark.read.parquet(f"{DATA}/documents.parquet"), labels))

    def kept(text):
        c = dict(zip(quality_rules.COUNTS + quality_rules.MORE, quality_rules.counts(text.encode(), len(text)), strict=True))
        if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
            return False
        by = lambda a, b: a / b if b else 0.0
        import math

        value = {
            "symbol_share": by(c["n_symbols"], c["word_chars"]), "dup_line_share": by(c["n_dup_lines"], c["n_lines"]), "repeat_share": by(c["n_repeat_words"], c["n_words"]),
            "twin_share": by(c["n_twins"], c["n_words"]), "distinct_share": by(c["n_distinct_words"], c["n_words"]), "upper_share": by(c["n_upper"], c["word_chars"]),
            "mark_share": by(c["n_marks"], c["n_words"]), "digit_share": by(c["n_digits"], c["word_chars"]), "mean_word": by(c["word_chars"], c["n_words"]),
            "words_by_line": by(c["n_words"], c["n_lines"]), "log_words": math.log2(c["n_words"] + 1),
        }
        return not any(all(value[x.feature] >= x.value if x.at_least else value[x.feature] <= x.value for x in rule) for rule in rules)

    good = sorted(d for d, r in docs.items() if kept(r.text or ""))
    sets = {d: shingles(docs[d].text, 5) for d in good}
    label = {d: d for d in good}
    for i, a in enumerate(good):
        for b in good[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if k == high else k for d, k in label.items()}
    single = sorted(set(label.values()))
    assert not spark.read.parquet(f"{DATA}/documents.parquet").limit(0).count()
    clean = {d: pii.masked(docs[d].text, base_spans(docs[d].text)) for d in single}
    sizes = Counter()
    for d, t in clean.items():
        sizes[docs[d].source] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    goal = mixing.targets(dict(sizes))

    rows = corpus_pipeline.run(spark, DATA).collect()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    taken, drawn = Counter(), Counter(r.doc_id for r in rows)
    for r in rows:
        ids = own.encode_ordinary(clean[r.doc_id])
        assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].encode()).hexdigest()
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", clean[r.doc_id]))
    assert max(drawn.values()) <= 3
    for source, n in taken.items():
        most = max(len(clean[d].split()) for d in single if docs[d].source == source)
        assert abs(n - goal[source]) <= most
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixture", "tokens"]


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names, and an empty table."""
    good = " ".join(f"Harbour{i} lights and quiet water number {i}." for i in range(60))
    long = " ".join(f"w{i * i % 99991}" for i in range(60_000))
    rows = [(1, good, "en", "a", len(good), 7), (1, good, "en", "a", len(good), 7), (2, good + " more", None, None, None, None), (3, None, "en", "a", 0, 1), (4, "", "en", "b", 0, 2), (5, long, "en", "b", len(long), 3), (None, good.replace("Harbour", "Mountain") + " mail me@example.org", "en", None, 9, 4), (6, "too short", "en", "a", 9, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int"
    for name, part in (("some", rows), ("none", [])):
        top = f"{tmp_path}/{name}"
        spark.createDataFrame(part, schema).write.parquet(f"{top}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, None, None), (99, 1, 0)] if part else [], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
        docs = spark.read.parquet(f"{top}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, top)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        out = corpus_pipeline.run(spark, top).collect()
        ids = {r.doc_id for r in out}
        assert not ids & {3, 4, 6} and (not part or (ids <= {1, 2, 5, None} and 5 in ids)) and (part or not out)
        assert not {1, 2} <= ids  # near duplicates
