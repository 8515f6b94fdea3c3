"""Held-out test passages that stand in a corpus (problem 7).

Each shard of the corpus becomes an FM-index over words: suffix array, Burrows-Wheeler transform in
a wavelet matrix, sampled suffix positions. All windows of `words` consecutive test words are
searched backwards at once; the occurrences are located and merged into spans to remove.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import written

WORDS = 12
#: Test items are shipped to every executor in sets of about this many bytes; each set is one pass over the corpus.
MOST_TEST_BYTES = 64 << 20
#: Bytes of documents that a shard's stretches may hold on to, besides the words of its index.
SHARD_BYTES = 32 << 20
#: Words that one FM-index holds at most; a longer document is spread over several with an overlap.
SHARD_WORDS = 1 << 19
_SAMPLE = 16
_WORD = re.compile(r"[^\W_]+")


class FMIndex:
    """FM-index of an int array with symbols 0..sigma-1, where 0 separates and is never searched."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        s = np.append(symbols.astype(np.int64), 0)
        sa = _suffix_array(s)
        n = len(s)
        bwt = s[sa - 1]
        self.n, self.bwt = n, bwt
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.splits = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one, dtype=np.int32)]).astype(np.int32))
            self.splits.append(int(self.zeros[-1][-1]))
            level = np.concatenate([level[one == 0], level[one == 1]])
        # starts of stretches are sampled too: stepping back never crosses a separator, whose order wraps
        marked = (sa % _SAMPLE == 0) | (bwt == 0)
        self.marked, self.rank_marked = marked, np.concatenate([[0], np.cumsum(marked, dtype=np.int32)])
        self.sampled = sa[marked]

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol c stands before position `at` of the transform."""
        low, high = np.zeros_like(at), at
        for k in range(self.bits):
            z, one = self.zeros[k], ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            zl, zh = z[low], z[high]
            low = np.where(one, self.splits[k] + low - zl, zl)
            high = np.where(one, self.splits[k] + high - zh, zh)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of equally long patterns, one a row; empty ones have low >= high."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by stepping back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            there = self.marked[r]
            done = open_[there]
            out[done] = self.sampled[self.rank_marked[rows[done]]] + steps[done]
            open_, r = open_[~there], r[~there]
            c = self.bwt[r]
            rows[open_] = self.first[c] + self.rank(c, r)
            steps[open_] += 1
        return out


def _suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes whose rank is still shared are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_s = s[order]
    new = np.concatenate([[True], sorted_s[1:] != sorted_s[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 1
    while True:
        # a group is a run of equal rank in `order`; lone members have their final place
        r = rank[order]
        same = np.concatenate([r[1:] == r[:-1], [False]])
        shared = np.flatnonzero(same | np.concatenate([[False], same[:-1]]))
        if not len(shared):
            return order
        at = order[shared]
        follow = at + k
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[shared] = at[by]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at[by]] = np.maximum.accumulate(np.where(fresh, shared, 0))
        k *= 2


class _Tests:
    """The test items' vocabulary and their windows."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        self.ids: dict[str, int] = {}
        windows: dict[tuple, set] = {}
        for item, text in items:
            found = [self.ids.setdefault(w.casefold(), len(self.ids) + 1) for w in _WORD.findall(text)]
            for i in range(len(found) - words + 1):
                windows.setdefault(tuple(found[i : i + words]), set()).add(item)
        self.patterns = np.array(sorted(windows), np.int64).reshape(-1, words)
        self.items = [sorted(windows[tuple(p)]) for p in self.patterns.tolist()]
        self.sigma = len(self.ids) + 1


def _hits(symbols: np.ndarray, tests: _Tests) -> tuple[np.ndarray, np.ndarray]:
    """(start position, pattern) of each occurrence of a window in one shard."""
    index = FMIndex(symbols, tests.sigma)
    low, high = index.search(tests.patterns)
    which = np.flatnonzero(low < high)
    counts = (high - low)[which]
    rows = np.repeat(low[which] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return index.locate(rows.astype(np.int64)), np.repeat(which, counts)


def leaked_spans(
    documents: DataFrame, items: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(key, item, start, stop): stretches of a document that are at least `words` consecutive words of a test item.

    Words are runs of letters or digits; letter case and what stands between words are ignored.
    `start` and `stop` are code-point positions of the merged stretch of one item, `stop` exclusive.
    Items of fewer words have no case. Null and empty texts on either side give no row; repeated
    documents give repeated rows; items with the same words are all reported.

    Words that no test item has are one separating symbol in the index, and stretches between them
    that are shorter than `words` can't hold an occurrence and aren't indexed. Shards follow the
    input's partitions and hold at most `shard_words` words each and SHARD_BYTES of the documents they
    come from, so memory is bounded; a shard ends only after `words` - 1 words of overlap. Test items of
    more than MOST_TEST_BYTES are searched in several sets, each collected and shipped by itself.
    """
    spark = documents.sparkSession
    wanted = items.where(F.col(item).isNotNull() & (F.length(item_text) > 0)).select(F.col(item).alias("item"), F.col(item_text).alias("text")).distinct()
    weight = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = max(1, -(-weight // MOST_TEST_BYTES))
    if sets > 1:
        wanted = written(wanted, "test-items")
    schema = T.StructType(
        [
            T.StructField("key", documents.schema[key].dataType),
            T.StructField("item", items.schema[item].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("stop", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
        tests = _Tests(shipped.value, words)
        if not len(tests.patterns):
            return
        get, find = tests.ids.get, _WORD.findall
        kept: list[tuple] = []  # (key, text, first word) of the stretches in the shard
        parts: list[np.ndarray] = []
        held = held_bytes = 0
        last_doc = None

        def flush() -> list[tuple]:
            nonlocal kept, parts, held, held_bytes, last_doc
            out: list[tuple] = []
            if parts:
                starts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
                symbols = np.zeros(int(starts[-1]) + len(parts[-1]), np.int64)
                for at, p in zip(starts.tolist(), parts):
                    symbols[at : at + len(p)] = p
                where, pattern = _hits(symbols, tests)
                owner = np.searchsorted(starts, where, "right") - 1
                spans: dict[tuple, list] = {}
                for w, p, o in sorted(zip(where.tolist(), pattern.tolist(), owner.tolist())):
                    k, doc, first = kept[o]
                    for x in tests.items[p]:
                        spans.setdefault((id(doc), x), [k, doc, []])[2].append(first + w - int(starts[o]))
                bounds: dict[int, list] = {}
                for (doc_id, x), (k, doc, begins) in spans.items():
                    if doc_id not in bounds:
                        bounds[doc_id] = [m.span() for m in _WORD.finditer(doc)]
                    b = bounds[doc_id]
                    begins = sorted(set(begins))
                    start, last = begins[0], begins[0]
                    for w in [*begins[1:], None]:
                        if w is None or w > last + words:
                            out.append((k, x, b[start][0], b[last + words - 1][1]))
                            start = w
                        last = w
            kept, parts, held, held_bytes, last_doc = [], [], 0, 0, None
            return out

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.names)

        types = None
        for b in batches:
            types = [b.schema.field("key").type, pa.int64(), pa.int64(), pa.int64()]
            for k, doc in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                # folding the whole text is faster, but may add marks that cut words outside ASCII
                found = find(doc.lower()) if doc.isascii() else [w.casefold() for w in find(doc)]
                symbols = np.array([get(w, 0) for w in found], np.int64)
                if len(symbols) < words:
                    continue
                known = np.concatenate([[False], symbols > 0, [False]]).astype(np.int8)
                edges = np.flatnonzero(np.diff(known))
                begins, ends = edges[::2], edges[1::2]
                for i in np.flatnonzero(ends - begins >= words).tolist():
                    at, end = int(begins[i]), int(ends[i])
                    while at + words <= end:
                        take = min(end, at + max(shard_words, 2 * words))
                        parts.append(symbols[at:take])
                        kept.append((k, doc, at))
                        held += take - at + 1
                        if doc is not last_doc:
                            held_bytes, last_doc = held_bytes + len(doc) * (1 if doc.isascii() else 2), doc
                        at = take if take == end else take - words + 1
                        if (held >= shard_words or held_bytes >= SHARD_BYTES) and (rows := flush()):
                            yield batch(rows)
        if types and (rows := flush()):
            yield batch(rows)

    def searching(shipped):
        return lambda batches: run(batches, shipped)

    source = documents.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = None
    for i in range(sets):
        mine = wanted if sets == 1 else wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(sets)) == i)
        shipped = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in mine.collect()])
        one = source.mapInArrow(searching(shipped), schema)
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "start", "stop")


def merged_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, spans): what to cut from each document, overlapping and touching stretches as one, in order."""
    packed = spans.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s"))
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))),
        ),
    ).otherwise(F.concat(acc, F.array(x)))
    zero = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    return packed.select(key, F.aggregate("s", zero, step).alias("spans"))
