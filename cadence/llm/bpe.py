"""Byte-level BPE encoding and decoding, with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. For each merge rank there is a bucket of the list
positions whose pair has that rank; a bitmap of two levels says which buckets hold
anything, and find-first-set finds the lowest rank in two steps however many pairs wait. The
leftmost position of that bucket merges; entries whose pair has changed since are stale and are
skipped. A pre-token of n bytes costs O(n log n), which suits very long runs without spaces.

Texts are cut where one space stands between two characters that aren't white space; such chunks
are encoded alike wherever they stand, so their ids are remembered, up to a bound.

Defined cases: null is the empty text, with no ids; text that spells a special token is ordinary
text; repeated rows give repeated results; very long texts and pre-tokens are encoded whole, in
n log n steps; further columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, table, worker_cache


def rank_queue(ranks: int):
    """(push, pop) of a priority queue of (rank, position): lowest rank first, then lowest position.

    ``low`` holds a bitmap of ranks in words of 2**``bits``, ``top`` says which words hold anything;
    ``bits`` is half the bits of a rank, so both levels are of about the same width. The state lies in
    closures, as reading attributes would take a good part of the time.
    """
    bits = max(1, (ranks.bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    low = [0] * ((ranks >> bits) + 1)
    top = 0
    buckets: dict[int, int | list[int]] = {}  # a lone position, or a heap of them

    def push(rank: int, position: int) -> None:
        nonlocal top
        if rank in buckets:
            bucket = buckets[rank]
            if type(bucket) is list:
                heappush(bucket, position)
            else:
                buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
            return
        buckets[rank] = position
        k = rank >> bits
        low[k] |= 1 << (rank & mask)
        top |= 1 << k

    def pop() -> tuple[int, int] | None:
        nonlocal top
        if not top:
            return None
        k = (top & -top).bit_length() - 1
        word = low[k]
        first = word & -word
        rank = (k << bits) + first.bit_length() - 1
        bucket = buckets[rank]
        if type(bucket) is list:
            position = heappop(bucket)
            if bucket:
                return rank, position
        else:
            position = bucket
        del buckets[rank]
        low[k] = word = word ^ first
        if not word:
            top &= top - 1
        return rank, position

    return push, pop


class BytePairs:
    """Encodes and decodes by a file of ``base64(token) rank`` lines and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.push, self.pop = rank_queue(max(self.tokens) + 1)
        self.pieces = _Remembered(self.merge)
        self.chunks = _Remembered(self.packed)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n, rank_of, push, pop = len(piece), ranks.get, self.push, self.pop
        after = list(range(1, n + 2))  # the start of the next part
        before = list(range(-1, n))
        pair = [None] * (n + 1)  # the rank of the pair that starts here
        for i in range(n - 1):
            r = rank_of(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                push(r, i)
        while (found := pop()) is not None:
            rank, i = found
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            pair[i] = pair[j] = None
            if k < n:
                r = rank_of(piece[i : after[k]])
                if r is not None:
                    pair[i] = r
                    push(r, i)
            h = before[i]
            if h >= 0:
                r = pair[h] = rank_of(piece[h:k])
                if r is not None:
                    push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a stretch of text as little-endian 32-bit numbers."""
        pieces = self.pieces
        ids = [t for piece in self.split(text) for t in pieces[piece.encode()]]
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit numbers."""
        parts, get = [], self.chunks.__getitem__
        for n, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if not first or "" in rest:
                return self.packed(text)  # white space meets white space, or an end of the text
            if n:
                parts.append(get("\n"))
            parts.append(get(first))
            parts += map(get, [" " + c for c in rest])
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class _Remembered(dict):
    """Results by their short arguments; emptied when full, so that a worker's memory stays bounded."""

    LONGEST, MOST = 48, 900_000

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        found = self.fn(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[key] = found
        return found


def byte_pairs(path: str, pattern: str) -> BytePairs:
    return worker_cache(("byte pairs", path, pattern), lambda: BytePairs(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""

    def run(batches):
        pairs = byte_pairs(path, pattern)
        for b in batches:
            packed = [np.frombuffer(pairs.encode(t or ""), "<i4") for t in b.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in packed])]).astype(np.int32)
            values = np.concatenate(packed) if packed else np.zeros(0, np.int32)
            yield batch(doc_id=b.column("doc_id"), ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data: the bytes that ``ids`` stand for."""

    def run(batches):
        pairs = byte_pairs(path, pattern)
        for b in batches:
            data = [pairs.decode(np.asarray(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield batch(doc_id=b.column("doc_id"), data=pa.array(data, pa.binary()))

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes, decodes the ids, and digests both
    in one pass over the texts."""

    def run(batches):
        pairs = byte_pairs(path, pattern)
        for b in batches:
            n, ids, decoded = [], [], []
            for t in b.column("text").to_pylist():
                packed = pairs.encode(t or "")
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(pairs.decode(np.frombuffer(packed, "<u4"))).hexdigest())
            yield batch(doc_id=b.column("doc_id"), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids, pa.string()), decoded_sha256=pa.array(decoded, pa.string()))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def multi_bpe() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *multi_bpe())
