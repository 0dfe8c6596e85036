"""Language identification: phrases against a plain parse, held-out accuracy, awkward rows."""

import random

from pyspark.sql import functions as F

from cadence.llm import language as lg
from cadence.llm import registry

from .helpers import AWKWARD, documents


def parsed(text, learned):
    """Phrases of a plain cross-parse, block by block."""
    n = 0
    for low in range(0, len(text), lg.BLOCK):
        block, i = text[low : low + lg.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j < len(block) and block[i : j + 1] in learned:
                j += 1
            n, i = n + 1, j
    return n


def test_phrases_by_a_plain_parse(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(lg, "AT_ONCE", 3)
    learned = {n: bytes(r.choice(abc) for _ in range(400)) for n, abc in (("a", b"abc "), ("b", b"bcd\xc3\xa9 "), ("c", b"xyz "))}
    texts = [bytes(r.choice(b"abcdxyz\xc3\xa9\xff ") for _ in range(r.randint(0, 1500))) for _ in range(40)] + [b"", b"a", b"\xff" * 600]
    got = lg.Automata(learned).phrases(texts)
    assert got.tolist() == [[parsed(t, learned[n]) for n in learned] for t in texts]


def test_automaton_takes_all_substrings_and_no_others():
    r = random.Random(2)
    text = bytes(r.choice(b"ab") for _ in range(60))
    steps = lg.suffix_automaton(text)

    def takes(word):
        state = 0
        for c in word:
            if c not in steps[state]:
                return False
            state = steps[state][c]
        return True

    assert all(takes(text[i:j]) for i in range(60) for j in range(i, 61))
    words = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))) for _ in range(2000)]
    assert all(takes(w) == (w in text) for w in words) and len(steps) <= 2 * len(text)


def test_query_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = registry.queries()["op13_language"](spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and dict(got.dtypes)["score"] == "double"
    found = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_a_prediction_sees_the_text_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lg.samples(docs.where(~lg.held_out(F.col("doc_id"))))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    assert lg.predict(docs, texts).collect() == lg.predict(other, texts).collect()
    held = docs.withColumn("lang", F.when(lg.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert lg.samples(held.where(~lg.held_out(F.col("doc_id")))) == texts  # labels of held-out rows teach nothing


def test_awkward_documents(spark):
    texts = {"en": b"the cat sat on the mat and so on", "de": b"der hund lag auf dem bett und so weiter"}
    for extra in (False, True):
        got = {(r.doc_id, r.lang_pred) for r in lg.predict(documents(spark, [*AWKWARD, (11, "12 + 3!"), (12, "Der Hund"), (13, "THE CAT"), (14, "漢字")], extra), texts).collect()}
        assert {(1, "und"), (2, "und"), (3, "und"), (11, "und"), (12, "de"), (13, "en"), (14, "en")} <= got
        assert {i for i, _ in got} == {i for i, _ in AWKWARD} | {11, 12, 13, 14}
    assert {r.lang_pred for r in lg.predict(documents(spark, AWKWARD), {}).collect()} == {"und"}
    assert lg.predict(documents(spark, []), texts).collect() == [] and lg.samples(documents(spark, [])) == {}


def test_the_sample_is_bounded_and_even(spark, monkeypatch):
    monkeypatch.setattr(lg, "LETTERS", 2000)
    monkeypatch.setattr(lg, "ROWS", 20)
    long, r = "word " * 50_000, random.Random(1)
    rows = [(i, " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(80)), "en") for i in range(300)] + [(1000 + i, long, "en") for i in range(100)] + [(2000, "uno dos tres", "es"), (2001, None, "fr"), (2002, "quatre", None)]
    got = lg.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(got) == ["en", "es"] and len(got["en"]) <= 2000 and got["es"] == b"uno dos tres"
