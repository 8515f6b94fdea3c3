"""Cutting texts beyond a size limit into overlapping pieces at natural boundaries (problem 4).

Balanced targets: the least number of pieces that can hold the text, equal-length targets, each cut
snapped to the strongest boundary near its target, else the nearest that the limit allows, and one piece more whenever a limit fails.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import small, written

#: How far a cut may be from its target, as a part of the new text of a piece.
REACH = 0.25
#: The kinds of boundary, strongest last; a cut stands after the match.
KINDS = ("hard", "space", "comma", "clause", "line", "sentence", "paragraph")
_BOUNDARY = re.compile(
    r"(?P<paragraph>\s*\n[^\S\n]*\n\s*)|(?P<sentence>(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』）]*)\s*)|(?P<line>[^\S\n]*\n\s*)|(?P<clause>(?:[;:—–](?=\s)|[；：])\s*)|(?P<comma>(?:,(?=\s)|[，、])\s*)|(?P<space>\s+)"
)
_LEVEL = {k: i for i, k in enumerate(KINDS)}
_MARK = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿゙゚︀-️︠-︯‍\U0001f3fb-\U0001f3ff]")


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions where a cut may stand, ascending, and their levels in KINDS."""
    where, level, sentence = [], [], _LEVEL["sentence"]
    for m in _BOUNDARY.finditer(text):
        kind = _LEVEL[m.lastgroup]
        if kind == sentence and (gap := text[m.start() : m.end()]).count("\n") > 1:
            kind = _LEVEL["paragraph"] if "\n\n" in gap.replace("\r", "").replace(" ", "") else kind
        where.append(m.end())
        level.append(kind)
    return where, level


def cut(text: str, limit: int, overlap: int, found: tuple[list[int], list[int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, stop, level of the boundary at stop) of the pieces of a text of more than `limit` code points.

    Each piece has at most `limit` code points, and each but the first starts exactly `overlap` before
    the end of the one before it; together they cover the text. An overlap of `limit` or more can't
    leave room for new text and is taken as `limit` - 1; a negative one as 0. Texts within the limit
    are one piece. Where nothing natural is near a target the
    nearest boundary that the limit allows is taken; without one the cut is hard, but not before a combining
    mark if that can be avoided.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    overlap = max(0, min(overlap, limit - 1))
    where, level = found or boundaries(text)
    pieces = 1 + -(-(n - limit) // (limit - overlap))
    most = 2 * pieces + 2
    while True:
        new = (n - overlap) / pieces  # new text of a piece, the overlap counted with the first
        reach = REACH * new
        cuts, levels, at = [], [], overlap
        for i in range(1, pieces):
            # room: this piece must end in time, and those to come must be able to hold the rest
            low, high = max(at + 1, n - (pieces - i) * (limit - overlap)), min((at - overlap if cuts else 0) + limit, n - (pieces - i))
            target = min(max(round(overlap + i * new), low), high)
            near, far = max(low, target - reach), min(high, target + reach)
            a, b = bisect_left(where, near), bisect_right(where, far)
            if low > high:
                break
            if a < b:
                j = max(range(a, b), key=lambda k: (level[k], -abs(where[k] - target)))
                at, kind = where[j], level[j]
            elif pieces < most and bisect_right(where, target + reach) > bisect_left(where, max(at + 1, target - reach)):
                break  # the limit keeps the cut from a boundary that one more piece may reach
            elif (a := bisect_left(where, low)) < (b := bisect_right(where, high)):
                # none near the target, but the limit leaves room for one farther off
                j = min(range(a, b), key=lambda k: (abs(where[k] - target), -level[k]))
                at, kind = where[j], level[j]
            else:
                at, kind = target, 0
                while at > low and _MARK.match(text, at):
                    at -= 1
            cuts.append(at)
            levels.append(kind)
        else:
            return list(zip([0, *(c - overlap for c in cuts)], [*cuts, n], [*levels, 0]))
        pieces += 1


def limits(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """(request_id, document_id, limit, overlap): what each request asks of its document's pages.

    `limit` is the whole code points within target x (1 + drift); modes are matched without case and
    outer blanks. Requests with mode `none`, an unknown or null mode, a null or non-positive target or
    no document ask for nothing. Of policies with one mode the largest drift counts; null drift is 0.
    Repeated requests count once. A null or negative overlap is 0.
    """
    fold = lambda c: F.lower(F.btrim(c, F.lit(" \t\r\n\xa0")))
    p = policies.groupBy(fold(F.col("mode")).alias("fold")).agg(F.max(F.coalesce("target_drift_fraction", F.lit(0.0))).alias("drift")).where((F.col("fold") != "none"))
    r = requests.where((F.col("target_passage_length") > 0) & F.col("document_id").isNotNull()).select(
        "request_id", "document_id", F.col("target_passage_length").alias("target"), F.greatest(F.coalesce("anythingllm_chunk_overlap_override", F.lit(0)), F.lit(0)).alias("overlap"), fold(F.col("segment_mode")).alias("fold")
    )
    limit = F.floor(F.col("target") * (1 + F.col("drift")) + 1e-6).cast("int")
    return r.join(p, "fold").select("request_id", "document_id", F.greatest(limit, F.lit(1)).alias("limit"), "overlap").distinct()


def split_pages(pages: DataFrame, wanted: DataFrame, with_text: bool = True) -> DataFrame:
    """(document_id, page_id, limit, overlap, piece, start, stop, boundary[, text]) of oversized pages.

    `wanted` has distinct (document_id, limit, overlap); a page is cut once for each, however many
    requests share it, and its boundaries are looked for once. Pages within every limit, and null
    texts, give nothing and never reach Python. `start` and `stop` are code-point positions.

    The sizes a document is asked for travel as one list: small against the pages they are broadcast,
    else both sides are shuffled by document and AQE splits a document that holds many pages.
    """
    sizes = wanted.groupBy("document_id").agg(F.collect_set(F.struct("limit", "overlap")).alias("sizes"))
    sizes = small(written(sizes, "piece-sizes"))
    text = pages.where(F.length("text") > 1).select("document_id", "page_id", "text")
    over: Column = F.filter("sizes", lambda s: s["limit"] < F.length("text"))
    todo = text.join(sizes, "document_id").select("document_id", "page_id", "text", over.alias("sizes")).where(F.size("sizes") > 0)
    ids = [pages.schema["document_id"].dataType, pages.schema["page_id"].dataType]
    fields = [("document_id", ids[0]), ("page_id", ids[1]), *[(x, T.IntegerType()) for x in ("limit", "overlap", "piece", "start", "stop")], ("boundary", T.StringType())]
    schema = T.StructType([T.StructField(x, t) for x, t in fields] + ([T.StructField("text", T.StringType())] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            cols: list[list] = [[] for _ in range(7 if with_text else 6)]
            for i, (t, sizes_of) in enumerate(zip(b.column("text").to_pylist(), b.column("sizes").to_pylist())):
                found = boundaries(t)
                for s in sizes_of:
                    for k, (start, stop, kind) in enumerate(cut(t, s["limit"], s["overlap"], found)):
                        rows.append(i)
                        for c, x in zip(cols, (s["limit"], s["overlap"], k, start, stop, KINDS[kind])):
                            c.append(x)
                        if with_text:
                            cols[6].append(t[start:stop])
            take = pa.array(rows, pa.int32())
            kinds = [pa.int32()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(c, k) for c, k in zip(cols, kinds)]], schema.names)

    return todo.mapInArrow(run, schema)


def request_pieces(pages: DataFrame, requests: DataFrame, policies: DataFrame, with_text: bool = True) -> DataFrame:
    """(request_id, page_id, piece, start, stop, boundary[, text]): the pieces each request gets, each once."""
    asked = written(limits(requests, policies), "piece-requests")
    cuts = split_pages(pages, asked.select("document_id", "limit", "overlap").distinct(), with_text)
    columns = ["request_id", "page_id", "piece", "start", "stop", "boundary"] + ["text"] * with_text
    return cuts.join(small(asked), ["document_id", "limit", "overlap"]).select(*columns).distinct()
