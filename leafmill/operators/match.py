"""Matching phrases, fragments and cached records with stored text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import text as X
from leafmill.session import small, written

# Words that prove no overlap.
STOPWORDS = ["the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "has", "was", "were", "that", "this", "with", "from", "have", "will"]


def phrases_in(text: Column, phrase: Column, folded: Column | None = None) -> dict[str, Column]:
    """Where a phrase stands in a text, letter case folded: status, position (-1: missing), marker and preview.

    The position counts in the folded text and cuts the original one. An empty phrase is found at 0.
    """
    at = F.when(phrase == "", 0).otherwise(F.instr(X.fold(text) if folded is None else folded, X.fold(phrase)) - 1)
    start = F.greatest(F.lit(0), at - 180)
    preview = F.left(F.replace(F.substr(text, start + 1, at + 520 - start), F.lit("\n"), F.lit(" ")), F.lit(1000))
    found = at >= 0
    return {
        "status": F.when(found, "found").otherwise("missing"),
        "position": at,
        "marker": F.when(found, X.last_marker(text, at)).otherwise(""),
        "preview": F.when(found, preview).otherwise(""),
    }


def phrase_validation(phrases: DataFrame, documents: DataFrame, key: str = "document_id", blocks: int = 16) -> DataFrame:
    """(request_id, key, phrase, status, position, marker, preview): each phrase against its document's full text.

    Phrases of a document that isn't there are missing. Repeated phrases of one request count once. A
    document's phrases are gathered in up to `blocks` lists, so that its text travels at most as often
    and a document asked about very often is spread over as many tasks.
    """
    p = phrases.where(F.col("phrase").isNotNull()).groupBy("request_id", key, "phrase").agg(F.lit(0).alias("_"))
    lists = p.groupBy(key, F.pmod(F.xxhash64("request_id", "phrase"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("request_id", "phrase")).alias("_p"))
    x = lists.join(documents.select(key, F.col("text").alias("_t")), key, "left").withColumn("_t", F.coalesce("_t", F.lit("")))
    x = x.withColumn("_f", X.fold(F.col("_t"))).select(key, "_t", "_f", F.explode("_p").alias("_p")).select(key, "_t", "_f", "_p.*")
    r = phrases_in(F.col("_t"), F.col("phrase"), F.col("_f"))
    return x.select("request_id", key, "phrase", *[c.alias(n) for n, c in r.items()])


def beginner(near: Iterable[str]) -> Callable[[str], bool]:
    """Tells whether a fragment begins a word, or is begun by one; words of five letters and more, short fragments need six.

    Words are sorted once and looked up by bisection, so a page takes n log n steps, not fragments x words.
    """
    known = set(near)
    words = sorted(known)
    long = [w for w in words if len(w) >= 6]

    def begins(some: list[str], f: str) -> bool:
        i = bisect_left(some, f)
        return i < len(some) and some[i].startswith(f)

    return lambda f: begins(long, f) if len(f) < 5 else begins(words, f) or any(f[:n] in known for n in range(5, len(f) + 1))


def matched(fragments: Iterable[str], near: Iterable[str]) -> int:
    """How many fragments begin a word, or are begun by one; see `beginner`."""
    return sum(map(beginner(near), fragments))


@F.arrow_udf(returnType=T.IntegerType())
def _matched(fragments: pa.Array, near: pa.Array) -> pa.Array:
    return pa.array([matched(f, w) if f and w else 0 for f, w in zip(fragments.to_pylist(), near.to_pylist())], pa.int32())


def fragment_match(pages: DataFrame) -> DataFrame:
    """(document_id, page, fragments, matched, ratio, confirmed): how far a page's words stand on its neighbours.

    Neighbours are the pages numbered one less and one more. A fragment of under five letters must
    begin a word of six or more; a longer one begins or is begun by a word. Fewer than eight fragments,
    or neighbours without words, prove nothing.
    """
    lower = X.fold(F.coalesce("text", F.lit("")))
    bound = rf"(?<![{X.WORD}])[a-zA-Z][a-zA-Z'-]{{%d,}}(?![{X.WORD}])"
    p = pages.select(
        "document_id", "page",
        F.array_except(F.array_distinct(F.regexp_extract_all(lower, F.lit(bound % 2), F.lit(0))), F.array(*[F.lit(w) for w in STOPWORDS])).alias("fragments"),
        F.array_distinct(F.regexp_extract_all(lower, F.lit(bound % 4), F.lit(0))).alias("words"),
    )
    # both neighbours in one shuffle: a page sends its words to the pages around it
    near = p.select("document_id", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page"), "words")
    near = near.groupBy("document_id", "page").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("near"))
    x = p.join(near, ["document_id", "page"], "left").withColumn("near", F.coalesce("near", F.expr("cast(array() as array<string>)")))
    hit = _matched(F.col("fragments"), F.col("near"))
    n = F.size("fragments")
    able = (n >= 8) & (F.size("near") > 0)
    x = x.select("document_id", "page", n.alias("fragments"), F.when(able, hit).otherwise(0).alias("matched"))
    ratio = F.when(F.col("fragments") > 0, F.col("matched") / F.col("fragments")).otherwise(0.0)
    return x.select("document_id", "page", "fragments", "matched", F.round(ratio, 3).alias("ratio"), ((F.col("matched") >= 8) & (ratio >= 0.8)).alias("confirmed"))


def cached_reuse(wanted: DataFrame, stored: DataFrame, fields: list[str], key: str) -> DataFrame:
    """Adds `reused`, the smallest stored key whose fields all equal, nulls included; '' without one.

    The fields are compared by a hash and then exactly; equal stored records are reduced to one before
    the join, so copies, however many, don't multiply.
    """
    h = F.xxhash64(*fields)
    s = stored.groupBy(*fields).agg(F.min(key).alias("_k")).withColumn("_h", h)
    w = wanted.withColumn("_h", h).alias("w")
    s = s.alias("s")
    on = F.col("w._h") == F.col("s._h")
    for f in fields:
        on = on & F.col(f"w.{f}").eqNullSafe(F.col(f"s.{f}"))
    return w.join(s, on, "left").select("w.*", F.coalesce(F.col("s._k").cast("string"), F.lit("")).alias("reused")).drop("_h")


def first_hint(names: DataFrame, hints: DataFrame, name: str = "name") -> DataFrame:
    """(name, hint, ordinal): the first hint, in list order, that stands in a name; names without one keep nulls.

    `hints` is a short ordered list; it is broadcast only if it measures small.
    """
    h = small(written(hints.select("hint", "ordinal"), "hints"))
    n = names.select(name).distinct()
    best = n.join(h, F.contains(F.lower(name), F.col("hint"))).groupBy(name).agg(F.min(F.struct("ordinal", "hint")).alias("b"))
    return n.join(best, name, "left").select(name, F.col("b.hint").alias("hint"), F.col("b.ordinal").alias("ordinal"))


def layered(layers: list[DataFrame], key: str) -> DataFrame:
    """One row per key: of several catalogs the later one wins."""
    both = None
    for i, layer in enumerate(layers):
        x = layer.withColumn("_layer", F.lit(i))
        both = x if both is None else both.unionByName(x, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "_layer")]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), "_layer").alias("b")).select(key, "b.*")
