import random
import re

from pyspark.sql import functions as F

from tideframe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            if kind == "card":
                total = 0
                for i, x in enumerate(reversed(digits)):
                    d = int(x) * (2 if i % 2 else 1)
                    total += d - 9 if d > 9 else d
                ok = 13 <= len(digits) <= 19 and total % 10 == 0
            if kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_of_random_texts():
    r = random.Random(3)
    pieces = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "1.2.3.4", "1.2.3.400", "001.2.3.4", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", " ", "é", "-", "+", "12", "(", ")", "@a.b", "..", "\n", "word", "9" * 25]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 12)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("9" * 200_000 + ".") == []


def test_disclosing_terms_and_cleaning(spark):
    # "quibble" stands near one address only, in different contexts; "the" stands everywhere.
    rows = [(i, f"word{i} the quibble a.b@example.com near{i} here{i}", "x") for i in range(6)]
    rows += [(100 + i, f"the plain text number {i} about nothing much", "x") for i in range(200)]
    rows += [(900, None, None), (901, "", "x"), (None, "c@d.org alone", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.with_spans(docs).withColumn("all", pii.written_spans(F.concat("base", "more"))).collect()}
    assert got[0].all == "email:18:33,removed:10:17"
    assert got[100].all == "" and got[900].n_email == 0
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[0].text == "word0 the  <EMAIL> near0 here0" and clean[0].spans == "x"
    assert clean[100].text == rows[6][1] and clean[900].text is None and clean[None].text == "<EMAIL> alone"
    assert len(pii.sanitise(docs).collect()) == len(rows)
    # copies are no evidence
    copies = spark.createDataFrame([(i, "some text quibble a.b@example.com near it") for i in range(50)], "doc_id long, text string")
    assert pii.with_spans(copies).where(F.size("more") > 0).count() == 0
    assert pii.with_spans(docs.limit(0)).count() == 0


def test_copies_dont_hide_a_disclosing_term(spark):
    rows = [(i * 10 + c, f"word{i} quibble a.b@example.com near{i}") for i in range(6) for c in range(10)]
    rows += [(1000 + i, f"the plain text number {i} about nothing much") for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = pii.disclosing(docs, pii.find(docs)).collect()
    assert [(r.term, r.action) for r in got] == [("quibble", "removed")] and abs(got[0].share - 1) < 1e-9


def test_terms_far_from_the_entity_are_masked_everywhere(spark):
    rows = [(i, f"x{i} Quibble y{i} of some long and plain talk about nothing then a.b@example.com at z{i} and in the end quibble, v{i}") for i in range(6)]
    rows += [(100 + i, f"some long and plain talk about nothing then at the end and of number {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert got[2] == "x2  y2 of some long and plain talk about nothing then <EMAIL> at z2 and in the end  v2"
    assert got[150] == rows[56][1]


def brute_more(rows, support=3, generalise=0.8, remove=0.95):
    """The added spans of each distinct text, by counting all pairs."""
    import math

    word = re.compile(r"[^\x20\x09-\x0D]+")
    term = lambda w: w.strip(".,;:!?\"'()").lower()
    texts = sorted({t or "" for _, t in rows})
    spans = {t: brute(t) for t in texts}
    held = {t: {(k, t[a:b].lower()): (a, b) for k, a, b in reversed(spans[t])} for t in texts}
    places = {t: [(term(m[0]), *m.span()) for m in word.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in spans[t])] for t in texts}
    places = {t: [x for x in p if len(x[0]) > 2 and any(c.isalnum() for c in x[0])] for t, p in places.items()}
    every = {t: {term(w) for w in word.findall(t)} for t in texts}
    near = lambda t, a, b: (tuple(word.findall(t[:a])[-3:]), tuple(word.findall(t[b:])[:3]))
    out = {t: set() for t in texts}
    for e in {e for t in texts for e in held[t]}:
        with_e = [t for t in texts if e in held[t]]
        for w in {x[0] for t in with_e for x in places[t]}:
            both = [t for t in with_e if any(x[0] == w for x in places[t])]
            if len(both) < support or len(with_e) == len(texts):
                continue
            n = max(len(both), sum(w in every[t] for t in texts))
            share = 1 - math.log(len(both) / n) / math.log(len(with_e) / len(texts))
            contexts = {(near(t, *held[t][e]), near(t, *next(x[1:] for x in places[t] if x[0] == w))) for t in both}
            if share >= generalise and len(contexts) >= support:
                for t in both:
                    out[t] |= {("removed" if share >= remove else "generalised", a, b) for x, a, b in places[t] if x == w}
    more = {}
    for t, found in out.items():
        best = {}
        for kind, a, b in found:
            best[a, b] = max(kind, best.get((a, b), ""))
        more[t] = sorted((k, a, b) for (a, b), k in best.items())
    return more


def test_all_spans_against_brute_force(spark):
    r = random.Random(11)
    common = [f"word{i}" for i in range(40)]
    people = [(f"p{i}@mail.example.com", f"Nickname{i},", f"street{i}") for i in range(6)]
    rows = []
    for i in range(300):
        words = [r.choice(common) for _ in range(r.choice([4, 12, 30]))]
        if i % 3 == 0:
            mail, nick, street = r.choice(people)
            for extra in (mail, nick, *([street] if r.random() < 0.8 else [])):
                words.insert(r.randrange(len(words) + 1), extra)
        if r.random() < 0.07:
            words.insert(r.randrange(len(words) + 1), r.choice(people)[2])
        rows.append((i, " ".join(words)))
    rows += [(400 + i, rows[3 * i][1]) for i in range(30)] + [(500, None), (501, "x" * 1000 + " p0@mail.example.com " + "y" * 1000)]
    want = brute_more(rows)
    assert sum(map(len, want.values())) > 50 and {k for v in want.values() for k, _, _ in v} == {"removed", "generalised"}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in pii.with_spans(docs).collect()}
    for d, t in rows:
        assert [(x.kind, x.start, x.end) for x in got[d].base] == brute(t or "") and [(x.kind, x.start, x.end) for x in got[d].more] == want[t or ""], d


def test_contexts_of_whole_words_and_a_megabyte_of_addresses():
    import time

    text = "a" * 1000 + " b c " + "d" * 2000 + " me@x.org " + "e" * 3000 + " f g h"
    at = text.index("me@")
    assert pii.around(text, at, at + 8).split("\n") == ["b", "c", "d" * 2000, "", "e" * 3000, "f", "g"]
    assert pii.around("one two", 0, 3) == "\ntwo" and pii.around("one two", 4, 7) == "one\n"
    long = " ".join(f"name{i}@mail{i}.example.com word{i}" for i in range(30_000))
    began = time.perf_counter()
    spans = pii.base_spans(long)
    assert len(spans) == 30_000 and sum(1 for _ in pii.terms_of(long, spans)) == 30_000 and time.perf_counter() - began < 10
