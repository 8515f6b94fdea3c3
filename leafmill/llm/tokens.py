"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

A text is cut by the vocabulary's pattern; each piece is merged with a segment tree over its byte
positions that keeps the leftmost minimum pair rank, so a merge costs logarithmic point updates on
its live neighbours and a piece of n bytes O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY_BYTES = 64 << 20
#: Pieces a worker remembers; the memo starts anew when it is full.
MEMO = 1 << 18
_NONE = 1 << 62


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always the lowest-ranked neighbouring pair, the leftmost on ties."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], _NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n))

    def put(at: int, rank: int) -> None:
        at += size
        tree[at] = rank
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            low = a if a <= b else b
            if tree[at] == low:
                return
            tree[at] = low
            at >>= 1

    while tree[1] != _NONE:
        at = 1
        while at < size:
            at *= 2
            if tree[at + 1] < tree[at]:
                at += 1
        left = at - size
        gone = after[left]
        end = after[gone]
        after[left] = end
        put(gone, _NONE)
        if end < n:
            before[end] = left
            put(left, get(piece[left : after[end]], _NONE))
        else:
            put(left, _NONE)
        if (prior := before[left]) >= 0:
            put(prior, get(piece[prior:end], _NONE))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class _Memo(dict):
    """piece -> its ids as the bytes of int32."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode("utf-8", "replace"), self.ranks), np.int32).tobytes()
        if len(self) >= MEMO:
            self.clear()
        self[piece] = ids
        return ids


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids array<int>): the ids of each row's text, without special tokens.

    Null and empty texts give an empty list, as does nothing else. Strings of special tokens inside
    a text are ordinary text. Texts are encoded whole. Repeated rows stay; other columns are
    ignored. The vocabulary is read once by the driver and shipped, its size checked before.
    """
    spark = df.sparkSession
    if os.path.getsize(vocabulary) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is too large to ship to every executor")
    with open(vocabulary, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut, ids = regex.compile(pattern).findall, _Memo(read_ranks(shipped.value)).__getitem__
        for b in batches:
            parts = [b"".join(map(ids, cut(t))) if t else b"" for t in b.column("text").to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4, out=offsets[1:])
            flat = pa.array(np.frombuffer(b"".join(parts), np.int32))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["key", "ids"])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), "ids")
