"""Exact substring dedup: words in a window of 35 words that also starts anywhere else.

First pass (prefilter): a window can only repeat if its anchor, the least hash among its 8-word
grams, occurs at two places that are anchors. Each partition counts its anchors in a count-min
sketch; the sketches are merged, slice by slice, in a shuffle. A sketch never underestimates, so a
window whose anchor is estimated below two is unique and is dropped, and no repeated window is.

Second pass: the remaining windows are grouped by a 96-bit hash of their whole word sequence, made
of 64-bit hashes of their words; two sequences are taken as equal if these hashes are. Before the
shuffle each task settles the windows that repeat within its own rows and
sends such a window on only once, so a passage that stands in a third of all documents arrives
as one entry for each task (which remembers what it has settled), not one for each place. Places are packed into binary columns and go
to buckets, whose number follows the size of the texts, by their anchors: neighbouring windows
mostly share one, so a document's windows meet in few buckets and few answers return. An anchor
that the sketch counts more than ``HOT`` times has its windows dealt over further buckets by their
own hash, so a phrase of many documents, with different words around it, fills no single bucket.

Size: the sketch has a counter for every 16 bytes of text. Up to ``MAX_BITS`` it is merged and
broadcast: one bit for each counter and row, at most ``ROWS * 2**MAX_BITS / 8`` bytes (64 MB), and 16
bytes for each counter above ``HOT``, of which each row has one for ``HOT`` anchors at most. A larger
sketch is never gathered: its counters stay spread over the cluster, as rows of a table that each
document's anchors are joined with, and each document gets back those at two or more. Either way
the prefilter works alike at every size, and the result is the same.

Defined cases: null and empty texts have no words; texts under 35 words lose none; repeated rows
are repeats of one another; windows are judged on the input, so all places of a repeated window
go; a very long text is worked on whole; further columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, discard, map_arrow, materialise, table, utf8, worker_cache

WINDOW = 35
GRAM = 8
ROWS = 2
MAX_BITS = 28
SLICE_BITS = 20
#: Windows or anchors that a task holds before it sends them on, and text bytes for each bucket.
HOLD = 1 << 20
BUCKET_BYTES = 64 << 20
#: Places of an anchor (up to 28 windows each) for which it gets one more bucket.
HOT = 1 << 14
#: The most counters of a spread sketch that go to every task (16 bytes each).
SENT = 1 << 20
#: Shares of a counter of a spread sketch take so many bits beside it.
_SHARE_BITS = 16
_MOST_SHARES = (1 << _SHARE_BITS) - 1

_MIX = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD))
_SKETCH = (0x9E3779B97F4A7C15, 0xC4CEB9FE1A85EC53)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("rid", "<i8"), ("rid2", "<i4"), ("pos", "<u4")])
_SETTLED = np.uint32(0xFFFFFFFF)  # in pos: a window that its task has found twice


class _WordHashes(dict):
    """Hashes of words; emptied when large, so that a worker's memory stays bounded."""

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = worker_cache("word hashes", _WordHashes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _join(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    p, q, r = (np.uint64(c) for c in _MIX[which])
    x = a * p + b * q
    x ^= x >> np.uint64(29)
    x *= r
    x ^= x >> np.uint64(32)
    return x


def rolled(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` items, from runs of powers of two."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, h, 1
    while True:
        if size & width:
            part = power[done : done + n]
            out = part if out is None else _join(out, part, which)
            done += width
        width *= 2
        if width > size:
            return out
        power = _join(power[: -width // 2], power[width // 2 :], which)


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    width = 1
    n = len(x) - size + 1
    while width * 2 <= size:
        x = best(x[:-width], x[width:])
        width *= 2
    return best(x[:n], x[size - width : size - width + n])


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor, and the gram hashes at all places that may be some window's anchor."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams, span = rolled(h, gram), window - gram + 1
    least = _sliding(grams, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    chosen = _sliding(np.concatenate([pad, least, pad]), span, np.maximum) == grams
    return least, grams[chosen]


def _counters(a: np.ndarray, bits: int, row: int) -> np.ndarray:
    return ((a * np.uint64(_SKETCH[row])) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch_parts(held: list[np.ndarray], bits: int):
    """Rows (slice, payload, many): the counters that the held anchors touch, times two, plus 1 if
    twice; and of those touched more often, each with its further times."""
    all_ = np.concatenate(held)
    low = min(bits, SLICE_BITS)
    for row in range(ROWS):
        idx, n = np.unique(_counters(all_, bits, row), return_counts=True)
        packed = ((idx & ((1 << low) - 1)) << 1 | (n > 1)).astype("<u4")
        slices = idx >> low
        at = np.flatnonzero(np.diff(slices, prepend=-1))
        for a, b in zip(at, [*at[1:], len(idx)]):
            more = np.flatnonzero(n[a:b] > 2)
            many = np.stack([packed[a:b][more] >> 1, n[a:b][more] - 2], axis=1).astype("<u4")
            yield int(slices[a]) + (row << (bits - low)), packed[a:b].tobytes(), many.tobytes()


def _rows(parts, names):
    parts = list(parts)
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return batch(**{name: pa.array([p[i] for p in parts], kinds[i]) for i, name in enumerate(names)})


def sketch(docs: DataFrame, bits: int, hot: int = HOT) -> tuple[np.ndarray, list[np.ndarray]]:
    """ROWS x 2**bits / 8 bytes: a bit for each counter that the merged sketch holds at two or more;
    and for each row the counters (ascending) that it holds above ``hot``, with their counts."""
    low = min(bits, SLICE_BITS)

    def count(batches):
        held, size = [], 0
        for b in batches:
            for t in utf8(b.column("text")):
                _, found = anchors(word_hashes((t or b"").split()))
                if len(found):
                    held.append(found)
                    size += len(found)
                if size >= HOLD:
                    yield _rows(_sketch_parts(held, bits), ("slice", "payload", "many"))
                    held, size = [], 0
        if held:
            yield _rows(_sketch_parts(held, bits), ("slice", "payload", "many"))

    def merge(batches):
        now, counts = None, None

        def sent():
            above = np.flatnonzero(counts > hot)
            listed = np.stack([above, counts[above]], axis=1).astype("<i8")
            return _rows([(now, np.packbits(counts > 1, bitorder="little").tobytes(), listed.tobytes())], ("slice", "bitmap", "hot"))

        for b in batches:
            for s, payload, many in zip(*(b.column(c).to_pylist() for c in ("slice", "payload", "many"))):
                if s != now:
                    if now is not None:
                        yield sent()
                    now, counts = s, np.zeros(1 << low, np.int64)
                part = np.frombuffer(payload, "<u4")
                counts[part >> 1] += 1 + (part & 1)
                further = np.frombuffer(many, "<u4").reshape(-1, 2)
                counts[further[:, 0]] += further[:, 1]
        if now is not None:
            yield sent()

    parts = map_arrow(docs.select("text"), count, "slice int, payload binary, many binary")
    merged = map_arrow(parts.repartition("slice").sortWithinPartitions("slice"), merge, "slice int, bitmap binary, hot binary")
    out = np.zeros((ROWS << (bits - low), max(1, (1 << low) // 8)), np.uint8)
    above = [np.zeros((0, 2), np.int64)] * len(out)
    for r in merged.collect():  # ROWS * 2**bits / 8 bytes at most, whatever the size of the corpus, and few hot counters
        out[r["slice"]] = np.frombuffer(r["bitmap"], np.uint8)
        above[r["slice"]] = np.frombuffer(r["hot"], "<i8").reshape(-1, 2) + np.array([(r["slice"] & ((1 << (bits - low)) - 1)) << low, 0])
    each = len(out) // ROWS
    return out.reshape(ROWS, -1), [np.concatenate(above[row * each : (row + 1) * each]) for row in range(ROWS)]


def _maybe_repeated(least: np.ndarray, bits: int, bitmap: np.ndarray) -> np.ndarray:
    hit = np.ones(len(least), bool)
    for row in range(ROWS):
        idx = _counters(least, bits, row)
        hit &= (bitmap[row][idx >> 3] >> (idx & 7).astype(np.uint8)) & 1 == 1
    return hit


def _shares(least: np.ndarray, bits: int, above: list[np.ndarray], hot: int) -> np.ndarray:
    """Over how many buckets each anchor's windows are dealt: one, and one more for ``hot`` places."""
    times = np.full(len(least), np.iinfo(np.int64).max)
    for row, listed in enumerate(above):
        if not len(listed):
            return np.ones(len(least), np.uint64)
        idx = _counters(least, bits, row)
        at = np.minimum(np.searchsorted(listed[:, 0], idx), len(listed) - 1)
        times = np.minimum(times, np.where(listed[at, 0] == idx, listed[at, 1], 0))
    return (1 + times // hot).astype(np.uint64)


def _groups(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the entries by their hashes, and in that order the number of each one's group."""
    order = np.lexsort((entries["h2"], entries["h1"]))
    h1, h2 = entries["h1"][order], entries["h2"][order]
    new = np.ones(len(entries), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return order, np.cumsum(new) - 1


def _places(entries: np.ndarray):
    """One (rid, rid2, positions) for each document; rows that repeat a document give it once."""
    entries = entries[np.lexsort((entries["pos"], entries["rid2"], entries["rid"]))]
    again = np.zeros(len(entries), bool)
    again[1:] = (entries["pos"][1:] == entries["pos"][:-1]) & (entries["rid"][1:] == entries["rid"][:-1]) & (entries["rid2"][1:] == entries["rid2"][:-1])
    entries = entries[~again]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["rid"][1:] != entries["rid"][:-1]) | (entries["rid2"][1:] != entries["rid2"][:-1])
    at = np.flatnonzero(new)
    for a, b in zip(at, [*at[1:], len(entries)]):
        yield int(entries["rid"][a]), int(entries["rid2"][a]), np.ascontiguousarray(entries["pos"][a:b]).tobytes()


def _place_batch(places, bucket=None):
    places = list(places)
    cols = {"rid": pa.array([p[0] for p in places], pa.int64()), "rid2": pa.array([p[1] for p in places], pa.int32()), "payload": pa.array([p[2] for p in places], pa.binary())}
    return batch(**cols) if bucket is None else batch(bucket=pa.array([bucket(p) for p in places], pa.int32()), **cols)


def _listed(counters: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted counter (of ``counters``, ascending); 0 if it isn't listed."""
    if not len(counters):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(counters, wanted), len(counters) - 1)
    return np.where(counters[at] == wanted, values[at], 0)


def _windows(batches, bits: int, bitmap: np.ndarray | None, above: list[np.ndarray], buckets: int, hot: int = HOT):
    """Rows (bucket, rid, rid2, payload): with rid null entries to group, else settled places.

    Without ``bitmap`` each text comes with its own counters and their shares (``known``).
    """
    settled = [np.zeros(0, np.uint64)]  # windows that this task has found twice; forgotten when many

    def sent(held, anchored):
        entries, to = np.concatenate(held), np.concatenate(anchored)
        order, group = _groups(entries)
        entries, to = entries[order], to[order]
        size = np.bincount(group)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        known = np.isin(_key(entries[first]), settled[0])
        twice = (size > 1) | known
        yield _place_batch(_places(entries[twice[group]]), lambda p: p[0] % buckets)
        first, twice = first[~known], twice[~known]
        on = entries[first]
        on["pos"][twice] = _SETTLED
        kept = settled[0] if len(settled[0]) < HOLD else settled[0][:0]
        settled[0] = np.concatenate([kept, _key(on[twice])])
        to = to[first]
        on, to = on[(order := np.argsort(to, kind="stable"))], to[order]
        at = np.flatnonzero(np.diff(to, prepend=-1))
        parts = [on[a:b].tobytes() for a, b in zip(at, [*at[1:], len(on)])]
        yield batch(bucket=pa.array(to[at], pa.int32()), rid=pa.nulls(len(at), pa.int64()), rid2=pa.nulls(len(at), pa.int32()), payload=pa.array(parts, pa.binary()))

    held, anchored, size = [], [], 0
    for b in batches:
        own = b.column("known").to_pylist() if bitmap is None else [None] * b.num_rows
        for t, rid, rid2, known in zip(utf8(b.column("text")), b.column("rid").to_pylist(), b.column("rid2").to_pylist(), own):
            h = word_hashes((t or b"").split())
            least, _ = anchors(h)
            if not len(least):
                continue
            if bitmap is None:
                known = np.sort(np.array(known, np.int64))
                seen = _listed(known >> _SHARE_BITS, known & _MOST_SHARES, _counters(least, bits, 0))
                at = np.flatnonzero(seen > 0)
                shares = seen[at].astype(np.uint64)
            else:
                at = np.flatnonzero(_maybe_repeated(least, bits, bitmap))
                shares = _shares(least[at], bits, above, hot)
            if len(at):
                e = np.empty(len(at), _ENTRY)
                e["h1"], e["h2"] = rolled(h, WINDOW)[at], (rolled(h, WINDOW, 1)[at] >> np.uint64(32)).astype(np.uint32)
                e["rid"], e["rid2"], e["pos"] = rid, rid2, at
                held.append(e)
                share = e["h1"] % shares  # equal windows stay together
                anchored.append(((least[at] % np.uint64(buckets) + share) % np.uint64(buckets)).astype(np.int32))
                size += len(e)
            if size >= HOLD:
                yield from sent(held, anchored)
                held, anchored, size = [], [], 0
    if held:
        yield from sent(held, anchored)


def _key(entries: np.ndarray) -> np.ndarray:
    """Both hashes of a window in one number, which tells windows of a task apart as well as h1."""
    return entries["h1"] ^ (entries["h2"].astype(np.uint64) * np.uint64(_SKETCH[1]))


def _group(batches):
    """Exact grouping of a bucket's windows; places of those found twice go on."""
    held = []
    for b in batches:
        settled = b.filter(b.column("rid").is_valid())
        if settled.num_rows:
            yield settled.select(["rid", "rid2", "payload"])
        held += [np.frombuffer(p, _ENTRY) for p, r in zip(b.column("payload").to_pylist(), b.column("rid").to_pylist()) if r is None]
    if held:
        entries = np.concatenate(held)
        order, group = _groups(entries)
        entries = entries[order]
        known = entries["pos"] == _SETTLED
        many = (np.bincount(group) + 2 * np.bincount(group, known))[group] > 1
        yield _place_batch(_places(entries[many & ~known]))


def _with_counters(docs: DataFrame, bits: int, hot: int = HOT) -> DataFrame:
    """The documents that have anchors counted twice or more, with these: ``known``, an array of numbers.

    The sketch has one row here, and is spread over the cluster by counter: a document's own counts
    are rows of a table, partitions' sums of them are merged, and the documents' rows are joined with
    the merged counters. Counters of more than ``hot`` places, and of more than a part in ``SENT`` of all, are at
    most ``SENT`` by count, and go to every task; only the others meet by a shuffle, so no counter's
    rows fill one task.
    """

    def run(batches):
        for b in batches:
            rid, counters, times = [], [], []
            for t, r in zip(utf8(b.column("text")), b.column("rid").to_pylist()):
                c, n = np.unique(_counters(anchors(word_hashes((t or b"").split()))[1], bits, 0), return_counts=True)
                rid.append(np.full(len(c), r, np.int64))
                counters.append(c)
                times.append(n)
            if rid:
                yield batch(rid=pa.array(np.concatenate(rid)), counter=pa.array(np.concatenate(counters), pa.int64()), n=pa.array(np.concatenate(times), pa.int32()))

    # Documents go by one hash: two that share it get each other's counters, which are as true for both.
    each = materialise(map_arrow(docs.select("text", "rid"), run, "rid long, counter long, n int"), "substring-counters")
    total = each.agg(F.sum("n")).first()[0] or 0
    many = materialise(each.groupBy("counter").agg(F.sum("n").alias("times")).where("times > 1"), "substring-sketch")
    frequent = F.col("times") > max(hot, total // SENT)
    tagged = each.select("rid", "counter").join(F.broadcast(many.where(frequent)), "counter", "left")
    rest = tagged.where("times IS NULL").drop("times").join(many.where(~frequent), "counter")
    # One number for each: the counter, and over how many buckets its windows are dealt.
    shares = F.least(F.floor(F.col("times") / hot) + 1, F.lit(_MOST_SHARES))
    told = tagged.where("times IS NOT NULL").unionByName(rest).select("rid", (F.shiftleft("counter", _SHARE_BITS) + shares).alias("known"))
    # Rows that repeat a document tell of the same counters.
    known = materialise(told.groupBy("rid").agg(F.collect_set("known").alias("known")), "substring-known")  # a document's anchors
    discard(each)
    return docs.join(known.hint("shuffle_hash"), "rid")


def repeated_places(docs: DataFrame, hot: int = HOT, max_bits: int = MAX_BITS) -> DataFrame:
    """rid, rid2, starts: for each document (by two hashes of doc_id and text) the first words of
    its repeated windows, as packed 32-bit numbers."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(10, (int(size) // 16).bit_length())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // BUCKET_BYTES)
    schema = "bucket int, rid long, rid2 int, payload binary"
    if bits > max_bits:
        places = map_arrow(_with_counters(docs, bits, hot).select("text", "rid", "rid2", "known"), lambda batches: _windows(batches, bits, None, [], buckets, hot), schema)
    else:
        shared = spark.sparkContext.broadcast(sketch(docs, bits, hot))

        def run(batches):
            yield from _windows(batches, bits, *shared.value, buckets, hot)

        places = map_arrow(docs.select("text", "rid", "rid2"), run, schema)
    found = map_arrow(places.repartition(buckets, "bucket"), _group, "rid long, rid2 int, payload binary")
    return found.groupBy("rid", "rid2").agg(F.collect_set("payload").alias("starts"))


def _covered(starts: list[bytes] | None, n: int, window: int = WINDOW) -> np.ndarray:
    edges = np.zeros(n + 1, np.int32)
    if starts:
        at = np.unique(np.frombuffer(b"".join(starts), "<u4")).astype(np.int64)
        edges[at] += 1
        edges[at + window] -= 1
    return np.cumsum(edges[:-1]) > 0


def cut_words(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the marked words and the separators after them; all else as it was."""
    starts = np.fromiter((m.start() for m in _WORD.finditer(text)), np.int64, len(gone))
    ends = np.append(starts[1:], len(text))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    head = text[: starts[0]]
    return head + b"".join(text[starts[a] : ends[b - 1]] for a, b in zip(edge[::2], edge[1::2]))


def deduplicate(docs: DataFrame, words_only: bool = False, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without their repeated words; all columns stay, ``n_words`` and ``n_removed``
    (long) are added in place of any so named. Documents that lose nothing keep their text as it
    is; others keep the spacing after each kept word. ``words_only``: every text becomes its kept
    words, joined by one space, and null becomes the empty text.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    rid, rid2 = F.xxhash64("doc_id", "text"), F.hash("doc_id", "text")
    places = repeated_places(docs.select("text", rid.alias("rid"), rid2.alias("rid2")), max_bits=max_bits).toDF("__r", "__r2", "__starts")
    keyed = docs.select(*names, rid.alias("__rid"), rid2.alias("__rid2"))
    # The places are the small side: a hash join spares sorting the texts.
    marked = keyed.join(places.hint("shuffle_hash"), (F.col("__rid") == F.col("__r")) & (F.col("__rid2") == F.col("__r2")), "left").select(*names, "__starts")

    def run(batches):
        for b in batches:
            out, n_words, n_removed = [], [], []
            for t, starts in zip(utf8(b.column("text")), b.column("__starts").to_pylist()):
                words = (t or b"").split()
                gone = _covered(starts, len(words)) if starts else None
                n_words.append(len(words))
                n_removed.append(int(gone.sum()) if starts else 0)
                if words_only:
                    t = b" ".join(words if not starts else [w for w, g in zip(words, gone.tolist()) if not g])
                elif starts:
                    t = cut_words(t, gone)
                out.append(t)
            cols = {c: b.column(c) for c in names} | {"text": pa.array(out, pa.binary()).cast(pa.string())}
            yield batch(**cols, n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.select(*names).schema)
    return map_arrow(marked, run, f"{schema}, n_words long, n_removed long")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words_only=True)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
