"""Toxicity by class-conditional Kneser-Ney models.

The models are over the letters of words. Words of the labelled training rows are padded and cut
into 6-letter grams, counted for each class over all those rows. Orders 6, 5 and 4 belong to a
class (raw counts at order 6, continuation counts below); orders 3 to 1 hold continuation counts
that both classes share. An expression that is rare in a class thus backs off to the same
probability under both, and says nothing. A word's evidence is its log-likelihood under the toxic
model less that under the ordinary one. The verdict compares length-normalised log-likelihoods: the
evidence of a passage over its length (bytes, and one for each word's end), for the passage of
``PASSAGE`` words in a row that is most toxic, and for the whole text. A few insults are lost in the
mean of a long text, but not in that of their passage. A logistic curve fitted on labelled rows kept out of
the counts turns the two into a score.

Rows with crc32(doc_id) mod 5 = 0 are held out altogether; remainders 1 to 3 are counted,
remainder 4 fits the curve. Counts cover every labelled row; the curve sees at most
``CURVE_ROWS`` rows, by hash order. The model keeps each gram's own counts, under a 64-bit hash of
its letters, so its tables are as long as there are distinct grams: 16 bytes for each gram of
orders 6 to 4 and 12 below, and 24 or 16 for each context, at most 204 bytes for each distinct
6-letter gram. They are sent to the tasks up to ``BROADCAST_GRAMS`` such grams. A larger model stays
in Spark: the texts' distinct words are cut into grams, these are joined with the counts order by
order, and the words' evidence is joined with the texts. Both ways give the same scores.

Defined cases: null and empty texts have no evidence and get the curve's score for none; a
doc_id labelled twice counts twice, as do repeated rows; a null label counts for nothing; a null
doc_id is not held out; a very long text is scored whole; further columns are ignored; without labels of both classes every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, batch, map_arrow, materialise, table, utf8, worker_cache

ORDER = 6
SHARED = 3
DISCOUNT = 0.75
PASSAGE = 3
FOLDS = 5
CURVE_ROWS = 20_000
#: Distinct grams that a task holds before it sends them on.
HOLD = 300_000
#: Up to so many distinct 6-letter grams (408 MB of tables at most) the model is sent to the tasks.
BROADCAST_GRAMS = 2_000_000
#: Shares into which a frequent gram's words, or a frequent word's texts, are dealt for a join.
SALT = 16

#: Lower-cases A-Z and turns all other ASCII but digits and letters into spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_START, _END = 2, 3
_CHAR_HASH = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points, each word after ORDER - 1 starts and before one end; and each
    word's number of grams."""
    texts = [w.decode("utf-8", "replace") for w in words]
    pad = chr(_START) * (ORDER - 1)
    glued = "".join(f"{pad}{t}{chr(_END)}" for t in texts)
    return np.frombuffer(glued.encode("utf-32-le", "replace"), "<u4"), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))


def _gram_ends(sizes: np.ndarray) -> np.ndarray:
    """Where in the letters each gram ends."""
    first = np.cumsum(sizes + ORDER - 1) - sizes
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _keys(letters: np.ndarray, ends: np.ndarray, length: int, last: int = 0) -> np.ndarray:
    """The 64-bit key of the ``length`` letters that end ``last`` before each of ``ends``."""
    h = np.full(len(ends), length + 1, np.uint64)
    for i in range(length):
        h = (h ^ letters[ends - last - (length - 1 - i)].astype(np.uint64)) * _CHAR_HASH
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _values(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of each wanted key; zeros for keys that the (sorted) table lacks."""
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1]), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0)


def _grams(word: bytes) -> list[str]:
    """A word's grams of ``ORDER`` letters, padding included."""
    padded = chr(_START) * (ORDER - 1) + word.decode("utf-8", "replace") + chr(_END)
    return [padded[i : i + ORDER] for i in range(len(padded) - ORDER + 1)]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(text, toxic) to (gram, c0, c1): how often each 6-letter gram stands in either class."""

    def sent(held):
        grams = {}
        for (word, toxic), n in held.items():
            for gram in _grams(word):
                grams.setdefault(gram, [0, 0])[toxic] += n
        return batch(gram=pa.array(list(grams), pa.string()), c0=pa.array([n[0] for n in grams.values()], pa.int64()), c1=pa.array([n[1] for n in grams.values()], pa.int64()))

    def run(batches):
        held: dict = {}
        for b in batches:
            for text, toxic in zip(utf8(b.column("text")), b.column("toxic").to_pylist()):
                for w in words_of(text):
                    held[w, toxic] = held.get((w, toxic), 0) + 1
                if len(held) >= HOLD:
                    yield sent(held)
                    held = {}
        if held:
            yield sent(held)

    counted = map_arrow(rows.select("text", "toxic"), run, "gram string, c0 long, c1 long")
    return counted.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _levels(top: DataFrame) -> DataFrame:
    """(order, gram, c0, c1) for the grams of every order: raw counts at the highest, continuation
    counts below, in c0 alone for the orders that both classes share."""
    levels, now = [], top
    for order in range(ORDER, 0, -1):
        levels.append(now.select(F.lit(order).alias("order"), "gram", "c0", "c1"))
        shorter = F.expr(f"substring(gram, 2, {order - 1})")
        if order - 1 > SHARED:
            now = now.groupBy(shorter.alias("gram")).agg(F.sum((F.col("c0") > 0).cast("long")).alias("c0"), F.sum((F.col("c1") > 0).cast("long")).alias("c1"))
        elif order > 1:
            now = now.groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("c0"), F.lit(0).cast("long").alias("c1"))
    return reduce(DataFrame.union, levels)


def _tables(top: DataFrame) -> dict[str, np.ndarray]:
    """``n<order>`` counts of grams, under the sorted keys ``grams<order>``; ``s<order>`` their sums
    over a context and ``t<order>`` its numbers of different grams, under ``contexts<order>``; two
    columns for class orders."""

    def run(batches):
        for b in batches:
            grams, orders = b.column("gram").to_pylist(), np.array(b.column("order").to_pylist(), np.int64)
            counts = np.stack([b.column(c).to_numpy() for c in ("c0", "c1")], axis=1)
            kinds, keys, values = [], [], []
            for order in np.unique(orders):
                at = np.flatnonzero(orders == order)
                letters = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le", "replace"), "<u4")
                ends = np.arange(1, len(at) + 1) * order - 1
                whole, context = _keys(letters, ends, order), _keys(letters, ends, order - 1, 1)
                for kind, key, value in (("n", whole, counts[at]), ("s", context, counts[at]), ("t", context, (counts[at] > 0).astype(np.int64))):
                    kinds += [f"{kind}{order}"] * len(at)
                    keys.append(key)
                    values.append(value)
            key, value = np.concatenate(keys), np.concatenate(values)
            yield batch(kind=pa.array(kinds, pa.string()), key=pa.array(key, pa.int64()), v0=pa.array(value[:, 0], pa.int64()), v1=pa.array(value[:, 1], pa.int64()))

    keyed = map_arrow(_levels(top), run, "kind string, key long, v0 long, v1 long").groupBy("kind", "key").agg(F.sum("v0").alias("v0"), F.sum("v1").alias("v1"))
    found = materialise(keyed.select("kind", "key", F.col("v0").cast("float").alias("v0"), F.col("v1").cast("float").alias("v1")), "toxicity-counts")
    out = {}
    # A row for each distinct gram and context, of which the caller has checked the number.
    for order in range(1, ORDER + 1):
        for kind in "nst":
            part = found.where(F.col("kind") == f"{kind}{order}").select("key", "v0", "v1").toArrow()
            key = part.column("key").to_numpy()
            at = np.argsort(key)
            out[f"{'grams' if kind == 'n' else 'contexts'}{order}"] = key[at]
            out[f"{kind}{order}"] = np.stack([part.column(f"v{k}").to_numpy()[at] for k in range(2 if order > SHARED else 1)], axis=1)
    out["model"] = uuid.uuid4().hex  # by which workers know their cached words
    return out


def evidence(words: list[bytes], tables: dict[str, np.ndarray]) -> np.ndarray:
    """Each word's log-likelihood under the toxic model less that under the ordinary one."""
    letters, sizes = _letters(words)
    every = _gram_ends(sizes)
    _, first, which = np.unique(_keys(letters, every, ORDER), return_index=True, return_inverse=True)
    ends = every[first]  # each different gram is looked up once
    p = np.full((len(ends), 1), 1.0 / 1024)
    for order in range(1, ORDER + 1):
        n = _values(tables[f"grams{order}"], tables[f"n{order}"], _keys(letters, ends, order)).astype(np.float64)
        context = _keys(letters, ends, order - 1, 1)
        s, t = (_values(tables[f"contexts{order}"], tables[f"{k}{order}"], context).astype(np.float64) for k in "st")
        seen = s > 0
        safe = np.where(seen, s, 1)
        p = np.where(seen, np.maximum(n - DISCOUNT, 0) / safe + DISCOUNT * t / safe * p, p)
    ratio = (np.log(p[:, 1]) - np.log(p[:, 0]))[which]
    return np.add.reduceat(ratio, np.cumsum(sizes) - sizes)


FEATURES = ("mean", "passage")


def features(ratios: np.ndarray, lengths: np.ndarray, passage: int = PASSAGE) -> tuple[float, float]:
    """Evidence over length of the words in order: of the whole text, and of its most toxic passage (the whole
    text, if it is shorter)."""
    if not len(ratios):
        return 0.0, 0.0
    total, length = np.cumsum(ratios), np.cumsum(lengths)
    k = min(passage, len(ratios))
    over, wide = total[k - 1 :].copy(), length[k - 1 :].astype(np.float64)
    over[1:] -= total[:-k]
    wide[1:] -= length[:-k]
    return float(total[-1] / length[-1]), float((over / wide).max())


def _measured(docs: DataFrame, columns: list[str], tables) -> DataFrame:
    """The given columns, with ``FEATURES``."""

    def run(batches):
        model = tables.value
        known = worker_cache(("evidence", model["model"]), lambda: BoundedCache(400_000))
        for b in batches:
            texts = [words_of(t) for t in utf8(b.column("text"))]
            new = list({w for words in texts for w in words if w not in known})
            if new:
                if len(known) + len(new) > known.limit:
                    known.clear()
                    new = list({w for words in texts for w in words})
                for at in range(0, len(new), 50_000):
                    part = new[at : at + 50_000]
                    known.update(zip(part, evidence(part, model).tolist()))
            found = [features(np.fromiter(map(known.__getitem__, words), np.float64, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 1) for words in texts]
            yield batch(**{c: b.column(c) for c in columns}, **{k: pa.array([x[i] for x in found], pa.float64()) for i, k in enumerate(FEATURES)})

    few = docs.select("text", *columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema if f.name != "text")
    return map_arrow(few, run, ", ".join([schema, *(f"{k} double" for k in FEATURES)]))


def _dealt(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """``many`` left-joined with ``few`` (unique in ``key``), a key's rows dealt over ``SALT`` shares
    by ``by``."""
    shares = few.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return many.withColumn("share", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(shares, [key, "share"], "left").drop("share")


def _gram_evidence(levels: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, ratio) of distinct grams: the log-likelihood of its last letter under the toxic model
    less that under the ordinary one. Each order joins the distinct endings of that length with
    their counts, their contexts and the probabilities of the order below."""
    lower = None
    for order in range(1, ORDER + 1):
        classes = (0, 1) if order > SHARED else (0, 0)
        counts = levels.where(F.col("order") == order).select("gram", "c0", "c1")
        context = F.expr(f"substring(gram, 1, {order - 1})").alias("context")
        contexts = counts.groupBy(context).agg(*(F.sum(f"c{k}").alias(f"s{k}") for k in (0, 1)), *(F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"t{k}") for k in (0, 1)))
        endings = grams.select(F.expr(f"substring(gram, {ORDER - order + 1}, {order})").alias("gram")).distinct()
        now = endings.select("gram", context, F.expr("substring(gram, 2)").alias("ending")).join(counts, "gram", "left").join(contexts, "context", "left")
        now = now.join(lower, "ending") if lower is not None else now.select("*", *(F.lit(1.0 / 1024).alias(f"p{k}") for k in (0, 1)))
        p = []
        for k, c in enumerate(classes):
            n, s, t = F.coalesce(F.col(f"c{c}"), F.lit(0)), F.col(f"s{c}"), F.col(f"t{c}")
            p.append(F.when(s > 0, F.greatest(n - F.lit(DISCOUNT), F.lit(0.0)) / s + F.lit(DISCOUNT) * t / s * F.col(f"p{k}")).otherwise(F.col(f"p{k}")).alias(f"p{k}"))
        lower = now.select(F.col("gram").alias("ending"), *p)
    return lower.select(F.col("ending").alias("gram"), (F.log("p1") - F.log("p0")).alias("ratio"))


def _joined(docs: DataFrame, columns: list[str], levels: DataFrame) -> DataFrame:
    """What ``_measured`` gives, by joins, for a model of any size."""

    def words(batches):
        for b in batches:
            at, word, places = [], [], []

            def sent():
                return batch(**{c: b.column(c).take(pa.array(at, pa.int64())) for c in ("row", *columns)}, word=pa.array(word, pa.binary()), places=pa.array(places, pa.list_(pa.int32())))

            held = 0
            for i, text in enumerate(utf8(b.column("text"))):
                found: dict = {}
                for k, w in enumerate(words_of(text)):
                    found.setdefault(w, []).append(k)
                found = found or {None: []}
                at += [i] * len(found)
                word += found.keys()
                places += found.values()
                held += sum(map(len, found.values()))
                if held >= HOLD:
                    yield sent()
                    at, word, places, held = [], [], [], 0
            if at:
                yield sent()

    def cut(batches):
        for b in batches:
            ids, found, n = [], [], []

            def sent():
                return batch(id=pa.array(ids, pa.binary()), gram=pa.array(found, pa.string()), n=pa.array(n, pa.int64()))

            for i, word in zip(b.column("id").to_pylist(), b.column("word").to_pylist()):
                counted = Counter(_grams(word))
                ids += [i] * len(counted)
                found += counted.keys()
                n += counted.values()
                if len(ids) >= HOLD:
                    yield sent()
                    ids, found, n = [], [], []
            if ids:
                yield sent()

    few = docs.select(F.monotonically_increasing_id().alias("row"), "text", *columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema if f.name != "text")
    held = materialise(map_arrow(few, words, f"{schema}, word binary, places array<int>"), "toxicity-words")
    # Long words go by a digest, as a word of many letters has as many grams.
    named = held.withColumn("id", F.when(F.octet_length("word") <= 32, F.col("word")).otherwise(F.unhex(F.sha2("word", 256))))
    pieces = materialise(map_arrow(named.where("word is not null").select("id", "word").distinct(), cut, "id binary, gram string, n long"), "toxicity-pieces")
    ratios = materialise(_gram_evidence(levels, pieces.select("gram").distinct()), "toxicity-ratios")
    ratio, n = F.coalesce("ratio", F.lit(0.0)), F.col("n")
    known = _dealt(pieces, ratios, "gram", "id").groupBy("id").agg(F.sum(n * ratio).alias("ratio"))
    placed = named.select("row", *columns, "id", "places", (F.octet_length("word") + 1).alias("length"))
    text = _dealt(placed, known, "id", "row").groupBy("row", *columns).agg(F.collect_list(F.struct(ratio.alias("ratio"), "length", "places")).alias("words"))  # a text's different words

    def judged(batches):
        for b in batches:
            lists = pa.array(b.column("words"))
            flat, size = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            places = flat.field("places")
            times = pc.list_value_length(places).fill_null(0).to_numpy(zero_copy_only=False)
            place, row = places.flatten().to_numpy(zero_copy_only=False), np.repeat(np.repeat(np.arange(len(b)), size), times)
            ratios, lengths = (np.repeat(flat.field(c).fill_null(0).to_numpy(zero_copy_only=False), times) for c in ("ratio", "length"))
            order = np.lexsort((place, row))
            ends = np.cumsum(np.bincount(row, minlength=len(b)))
            found = [features(ratios[order[low:high]], lengths[order[low:high]]) for low, high in zip([0, *ends[:-1]], ends)]
            yield batch(**{c: b.column(c) for c in columns}, **{k: pa.array([x[i] for x in found], pa.float64()) for i, k in enumerate(FEATURES)})

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema if f.name not in ("text", "row"))
    return map_arrow(text, judged, ", ".join([kept, *(f"{k} double" for k in FEATURES)]))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Logistic weights (constant last) by Newton's method on standardised features."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


def score(docs: DataFrame, labels: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, held_out, score, predicted, and the evidence (mean, passage) of every whole text; a model of more
    than ``broadcast_grams`` grams is joined with the texts' words in place of being sent to the tasks."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("fold", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(-1)).cast("int"))
    marks = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    # The labels are the small side, but grow with the documents: a hash join, without sorting texts.
    train = materialise(docs.where("fold > 0").join(marks.hint("shuffle_hash"), "doc_id"), "toxicity-train")
    counts = materialise(gram_counts(train.where(f"fold < {FOLDS - 1}")), "toxicity-grams")
    if counts.count() <= broadcast_grams:
        measured = partial(_measured, tables=spark.sparkContext.broadcast(_tables(counts)))
    else:
        measured = partial(_joined, levels=materialise(_levels(counts), "toxicity-levels"))
    curve = measured(train.where(f"fold = {FOLDS - 1}"), ["doc_id", "toxic"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS).toArrow()
    y = curve.column("toxic").to_numpy().astype(float)
    x = np.column_stack([curve.column(k).to_numpy() for k in FEATURES])
    found = measured(docs, ["doc_id", "fold"])
    if len(set(y.tolist())) == 2:
        *weights, constant = (float(v) for v in fit_curve(x, y))
        line = sum((w * F.col(k) for w, k in zip(weights, FEATURES)), F.lit(constant))
        out = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), line))))
    else:
        out = F.lit(0.0)
    found = found.withColumn("score", out)
    return found.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
