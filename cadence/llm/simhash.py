"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two documents link if theirs differ in at most ``2`` bits. The
fingerprint is cut into two segments of 32 bits: of two linked fingerprints one segment differs in
at most one bit. For each segment the index holds the segment itself and its 32 variants with one
bit deleted (a wildcard). Equal index keys are joined, and the whole fingerprints are compared.

Only distinct fingerprints are indexed, so groups of exact copies cost one entry. A key under
which more than ``bucket`` fingerprints fall is not paired off: those fingerprints are linked
through midpoints instead. Two fingerprints are within two bits exactly if some 64-bit value is
within one bit of both; each value has at most 65 such neighbours, so each group is bounded and
every member is linked to the group's least, which loses no link between components and emits no
pairs. Both ways are exact.

Defined cases: a null or empty text has fingerprint zero, which links like any other; texts of
fewer than three words hash their whole word sequence; a null doc_id takes part, but is no
component's name unless the component has no other; a very long text is hashed whole, in blocks;
repeated rows get the same component; further columns are ignored, or stay in ``deduplicate``; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, materialise, table, utf8
from .components import connected_components

SEED = 42
SHINGLE = 3
BITS = 2
BUCKET = 24


def _hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < k:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    join = b" ".join
    return np.fromiter((digest(join(s), SEED) for s in zip(*(words[i:] for i in range(k)))), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = np.ascontiguousarray(hashes[at : at + block]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every whole text."""

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(_hashes(t or b"", shingle)) for t in utf8(b.column("text"))], np.uint64)
            yield batch(doc_id=b.column("doc_id"), fp=pa.array(found.view(np.int64), pa.int64()))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _index(distinct: DataFrame) -> DataFrame:
    """(key, fp): for both segments, the segment (hole 32) and its variants with bit 0 to 31 cleared."""
    holes = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("k")).selectExpr("fp", "k div 33 as seg", "k % 33 as hole")
    return holes.selectExpr(
        "fp",
        "(shiftrightunsigned(fp, cast(32 * seg as int)) & 4294967295L & ~(case when hole < 32 then shiftleft(1L, cast(hole as int)) else 0L end)) | shiftleft(cast(hole as bigint), 32) | shiftleft(seg, 38) as key",
    )


def _shared(keyed: DataFrame) -> DataFrame:
    """The entries whose key several fingerprints have, with their number ``n``. Spark sizes an exploded
    table like the one before, so 66 entries a fingerprint would pass for a table to broadcast: the
    joins of exploded tables are shuffled whatever their sizes seem."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(sizes.hint("merge"), "key").select("key", "fp", "n")


def _through(crowded: DataFrame) -> DataFrame:
    """(u, v) of the fingerprints ``fp``: each with the least that shares a midpoint with it."""
    near = crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("k")).selectExpr("fp", "case when k = 64 then fp else fp ^ shiftleft(1L, k) end as mid")
    least = near.groupBy("mid").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "v")
    return near.join(least.hint("merge"), "mid").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): edges over distinct fingerprints ``fp`` whose components are those of all links."""
    shared = materialise(_shared(_index(distinct)), "simhash-index")
    few = shared.where(F.col("n") <= bucket)
    left, right = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    hole = "(shiftrightunsigned(key, 32) & 63)"
    # Under a wildcard key the wildcard bit must differ; equal segments meet under their own key.
    differs = f"({hole} = 32 or ((shiftrightunsigned(u ^ v, cast({hole} + 32 * shiftrightunsigned(key, 38) as int)) & 1) = 1))"
    pairs = left.join(right.hint("merge"), "key").where("u < v").where(f"bit_count(u ^ v) <= {BITS}").where(differs).select("u", "v").distinct()
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    return pairs.union(_through(crowded))


def cluster(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that the document's links reach."""
    every = materialise(fingerprints(docs, shingle), "simhash-fp")
    distinct = materialise(every.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), bucket))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-roots")
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(rooted.join(names, "root").select("fp", "component_id"), "simhash-named")
    return every.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """The documents with one of each component: the one with its smallest doc_id.

    Rows that repeat that doc_id and its text stay once. Rows without doc_id can't be named by a
    component: each distinct text among them stays once.
    """
    found = materialise(cluster(docs, shingle, bucket), "simhash-found")
    winners = found.where(F.col("doc_id") == F.col("component_id"))
    counted = materialise(winners.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "simhash-kept")
    once = counted.where("rows = 1").select(F.col("doc_id").alias("__keep"))
    # The ids are the small side: a hash join spares sorting the texts.
    kept = docs.join(once.hint("shuffle_hash"), F.col("doc_id") == F.col("__keep"), "left_semi")
    again = counted.where("rows > 1").select(F.col("doc_id").alias("__keep"))
    repeats = docs.join(again.hint("shuffle_hash"), F.col("doc_id") == F.col("__keep"), "left_semi")
    return kept.unionByName(repeats.unionByName(docs.where("doc_id is null")).dropDuplicates(["doc_id", "text"]))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
