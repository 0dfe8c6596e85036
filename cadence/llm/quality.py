"""Quality rules: base rules plus cutoffs whose false-rejection risk is certified on labels.

Every document gets signals (higher is worse). Labelled good documents (``labels.quality = 1``)
are the holdout. For each stratum (the document's ``lang``) and signal, a fixed ladder of cutoffs
is tried from the most lenient to the strictest. A cutoff is certified if the exact binomial
(Clopper-Pearson) upper bound on the share of good documents above it stays within the signal's
share of ``risk``. Going down the ladder until the first failure is fixed-sequence testing and
needs no correction within a ladder; the confidence is divided among all strata and signals
(Bonferroni). So with probability ``1 - delta``, in every stratum at once, the method rejects at
most ``risk`` of the good documents. A stratum with too few labels certifies nothing, and there
the method rejects nothing.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; a null
``lang`` is a stratum of its own; a label whose document is absent and a null label count for
nothing; a document listed twice in ``labels`` counts once, or not at all if its labels differ. The
bound assumes independent trials: where labelled documents may be copies of one another, ``by_text``
counts a text once in a stratum however many of them hold it (by its 64-bit hash; near copies are
trials of their own). A very long text is measured whole;
repeated rows give repeated results; clashing columns are carried under names of their own; an empty
table gives an empty result; an empty ``labels`` table certifies nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, materialise, table, utf8

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
RISK = 0.02
DELTA = 0.05
#: Ladders of cutoffs, most lenient first. They end where ordinary prose does not yet come.
LADDERS = {
    "symbol_share": (0.50, 0.30, 0.20, 0.15, 0.10, 0.08),
    "upper_share": (0.90, 0.80, 0.70, 0.60, 0.50),
    "bang_share": (0.40, 0.30, 0.20, 0.15, 0.10),
    "stutter_share": (0.80, 0.60, 0.40, 0.30, 0.20),
    "dup_line_share": (0.90, 0.80, 0.70, 0.60, 0.50),
    "repeat_share": (0.30, 0.25, 0.20),
}

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_window_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words (a power of two) found at two or more places.

    Windows get dense ranks by doubling (1, 2, 4, 8 words), so equality is exact, without hashes.
    """
    n = len(ids)
    if n <= window:
        return 0
    ranks, step = ids.astype(np.int64), 1
    while step < window:
        _, ranks = np.unique(ranks[:-step] * (n + 1) + ranks[step:], return_inverse=True)
        if int(ranks.max()) + 1 == len(ranks):
            return 0  # every shorter window is unique, so every longer one is
        step *= 2
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _measure(text: bytes) -> tuple:
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    glued = b"".join(words)
    chars = len(glued.translate(None, _CONTINUATION))
    symbols = len(glued) - len(glued.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    repeats = repeated_window_words(ids)
    return (
        n,
        chars,
        symbols,
        dup_lines,
        repeats,
        symbols / chars,
        (len(glued) - len(glued.translate(None, _UPPER))) / chars,
        glued.count(b"!") / chars,
        float((ids[1:] == ids[:-1]).sum()) / n,
        dup_lines / len(lines),
        repeats / n,
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def signals(docs: DataFrame, stratum: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, text_key (a hash), the five counts and the shares of ``LADDERS`` of every
    whole text; the columns ``carry`` follow as ``in_<column>``."""
    names = [*_COUNTS, *LADDERS]

    def run(batches):
        for b in batches:
            rows = [_measure(t or b"") for t in utf8(b.column("__text"))]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            kinds = [pa.int64()] * len(_COUNTS) + [pa.float64()] * len(LADDERS)
            made = {k: pa.array(v, t) for k, v, t in zip(names, columns, kinds)}
            yield batch(doc_id=b.column("doc_id"), stratum=b.column("stratum"), text_key=b.column("text_key"), **made, **{f"in_{c}": b.column(f"in_{c}") for c in carry})

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.xxhash64("text").alias("text_key"), F.col("text").alias("__text"), *[F.col(f"`{c}`").alias(f"in_{c}") for c in carry])
    schema = ["doc_id long", "stratum string", "text_key long", *(f"{c} long" for c in _COUNTS), *(f"{c} double" for c in LADDERS), *(f"`in_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)]
    return map_arrow(few, run, ", ".join(schema))


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def upper_bound(rejected: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound, at confidence ``1 - delta``, on a binomial share."""
    if n == 0 or rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        # P(X <= rejected) under share mid
        if _beta_tail(n - rejected, rejected + 1, 1 - mid) > delta:
            low = mid
        else:
            high = mid
    return high


def certify(counts: list[tuple[int, int]], risk: float, delta: float) -> int:
    """How many cutoffs of a ladder hold: ``counts`` has (good documents above, good documents)."""
    held = 0
    for above, n in counts:
        if upper_bound(above, n, delta) > risk:
            break
        held += 1
    return held


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, by_text: bool = False) -> DataFrame:
    """stratum, one ``max_<signal>`` per signal (null: none certified), good, risk_bound.

    Rows: one for each stratum that has labelled good documents. The counts behind them are one
    aggregated row for each stratum.
    """
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    good = marks.where("low = 1 and high = 1").select("doc_id")
    trials = measured.join(good, "doc_id").select("stratum", "text_key", *LADDERS)
    if by_text:
        trials = trials.dropDuplicates(["stratum", "text_key"])
    above = [F.sum((F.col(s) > c).cast("long")).alias(f"{s}_{i}") for s, ladder in LADDERS.items() for i, c in enumerate(ladder)]
    counts = materialise(trials.groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *above), "quality-counts")
    strata = max(1, counts.count())
    per_test = delta / (strata * len(LADDERS))

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            out = {"stratum": [r["stratum"] for r in rows], "good": [r["good"] for r in rows]}
            bounds = [0.0] * len(rows)
            for s, ladder in LADDERS.items():
                held = [certify([(r[f"{s}_{i}"], r["good"]) for i in range(len(ladder))], risk / len(LADDERS), per_test) for r in rows]
                out[f"max_{s}"] = [ladder[h - 1] if h else None for h in held]
                bounds = [x + (upper_bound(r[f"{s}_{h - 1}"], r["good"], per_test) if h else 0.0) for x, h, r in zip(bounds, held, rows)]
            yield batch(
                stratum=pa.array(out["stratum"], pa.string()), good=pa.array(out["good"], pa.int64()), risk_bound=pa.array(bounds, pa.float64()),
                **{f"max_{s}": pa.array(out[f"max_{s}"], pa.float64()) for s in LADDERS},
            )

    return map_arrow(counts, run, "stratum string, good long, risk_bound double, " + ", ".join(f"max_{s} double" for s in LADDERS))


def _verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed``, ``reason`` (null if kept) and ``kept``."""
    limits = materialise(limits, "quality-cutoffs")
    few = limits.count() <= 10_000  # strata: small enough to send to each executor
    known = measured.join(F.broadcast(limits) if few else limits, "stratum", "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    over = F.array_compact(F.array(*[F.when(F.col(s) > F.col(f"max_{s}"), F.lit(s)) for s in LADDERS]))
    reason = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.nullif(F.array_join(over, ","), F.lit("")))
    return known.withColumn("base_failed", base).withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, by_text: bool = False) -> DataFrame:
    """Each document's counts, ``base_failed``, ``kept`` and ``reason`` (null if kept)."""
    measured = materialise(signals(docs), "quality-signals")
    return _verdicts(measured, cutoffs(measured, labels, risk, delta, by_text)).select("doc_id", *_COUNTS, "base_failed", "kept", "reason")


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, by_text: bool = False) -> DataFrame:
    """The documents, all columns, that the rules keep; each row is judged by its own text."""
    measured = materialise(signals(docs, carry=tuple(docs.columns)), "quality-measured")
    kept = _verdicts(measured, cutoffs(measured, labels, risk, delta, by_text)).where("kept")
    return kept.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), by_text=True)
