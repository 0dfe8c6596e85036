"""Small tables with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False):
    """(doc_id, text) pairs as documents; ``extra`` adds columns with clashing names."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("n_words", "spans", "rid", "fp", "key", "stratum", "kept", "pieces", "ids", "hits"):
            df = df.withColumn(name, F.lit("x"))
    return df


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "a b"),
    (6, "Ünï cödé 漢字 😀 text with   spaces\x1cand\x85more"),
    (7, LONG),
    (8, LONG),
    (8, LONG),
    (None, "a row without an id that says enough words to count as a text of some length here now ok"),
    (9, "x" * 200_000),
    (10, "+" * 5000 + "@" * 5000 + "1." * 5000),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
