"""Lines that one source repeats over its documents, and their removal (problem 1).

The rate at which a source's documents carry a line is compared with the rate outside by the
log-likelihood ratio, for every line that a source has twice; the excess is kept under a
false-discovery bound, then the stated minima are applied. The lines found are anti-joined away and
every page is put together again by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import small, written

#: White space of any script but the line feed, as a character class body for Java and RE2.
BLANK = r" \t\x0b\f\r\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MIN_LETTERS, MIN_DOCUMENTS, MIN_SHARE, FALSE_DISCOVERY = 20, 3, 0.05, 0.05
#: A line that a source has in fewer documents isn't tested.
TESTED = 2
_STEPS, _BINS = 4, 4096


def line_keys(text: Column) -> Column:
    """The keys of all lines of a text: letter case ignored, digits and white space dropped.

    The text is folded as a whole, before it is split: one pass of each expression per page.
    """
    return F.split(F.regexp_replace(F.lower(F.upper(text)), rf"[\p{{Nd}}{BLANK}]+", ""), "\n", -1)


def lines(pages: DataFrame, count_letters: bool = True) -> DataFrame:
    """(source, document_id, page_id, line_no, line_hash) of each line long enough to matter.

    Lines stand between `\\n`, numbered from 1, blank ones included. Only a 64-bit hash of a line's
    key travels: among n lines and m repeated ones about n*m/2^64 lines would be taken for another.
    Without `count_letters` lines of few letters are left in: they match no hash of a line that has
    enough. The hashes are made inside the array, so that no filter repeats the folding.
    """
    enough = lambda k: F.length(k) >= MIN_LETTERS
    if count_letters:
        enough = lambda k: F.length(F.when(F.length(k) >= MIN_LETTERS, F.regexp_replace(k, r"[^\p{L}]+", ""))) >= MIN_LETTERS
    hashes = F.transform(line_keys(F.col("text")), lambda k: F.when(enough(k), F.xxhash64(k)))
    numbered = pages.where(F.length("text") >= MIN_LETTERS).select("source", "document_id", "page_id", F.posexplode(hashes).alias("line_no", "line_hash"))
    return numbered.where(F.col("line_hash").isNotNull()).select("source", "document_id", "page_id", (F.col("line_no") + 1).alias("line_no"), "line_hash")


def _gain(k: Column, n: Column, p: Column) -> Column:
    """k ln(k / (n p)), 0 at k = 0."""
    return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)


def scored_lines(pages: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, line_hash, n_documents, size, enough, llr) of every line that a source has in TESTED documents; a written table.

    Within and outside rates are of documents, counted exactly, so repeated rows count once. `enough`
    tells that the pair meets the minima. A site's lines aren't held against another site that repeats
    them as well: outside are the documents of the other sources but those that meet the minima for
    the line themselves, plus one pseudo-document at the rate of a line in half a document of all (the
    usual correction for none). The statement defines excess by the minima alone, and an outside that
    carries the line about as often, or hardly exists, mustn't veto it: for pairs that meet them the
    ratio to that rate counts if it is greater.

    Null sources form one source of their own; null documents don't count. An empty table gives none.
    """
    seen = lines(pages).where(F.col("document_id").isNotNull()).select("source", "line_hash", "document_id").distinct()
    # one count per (source, line): partial sums before the shuffle, so that a hot line is one row a task
    pairs = written(seen.groupBy("source", "line_hash").agg(F.count("*").alias("k")), "line-pairs")
    sizes = written(
        pages.where(F.col("document_id").isNotNull()).select("source", "document_id").distinct().groupBy("source").agg(F.count("*").alias("n")), "source-sizes"
    )
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    once = 0.5 / max(1, total)

    s, c = small(sizes).alias("s"), pairs.where(F.col("k") >= TESTED).alias("c")
    enough = (F.col("k") >= min_documents) & (F.col("k") >= min_share * F.col("n"))
    tested = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "c.line_hash", "c.k", "s.n", enough.alias("enough"))
    tested = written(tested, "tested-lines")
    held = lambda x: F.sum(F.when(F.col("enough"), F.col(x)).otherwise(0)).alias(f"dense_{x}")
    dense = small(written(tested.groupBy("line_hash").agg(held("k"), held("n")), "dense-totals"))
    everywhere = pairs.join(dense, "line_hash").groupBy("line_hash").agg(F.sum("k").alias("all_k"), F.first("dense_k").alias("dense_k"), F.first("dense_n").alias("dense_n"))
    x = tested.join(everywhere, "line_hash")
    own = lambda c: F.when(F.col("enough"), F.col(f"dense_{c}")).otherwise(F.col(f"dense_{c}") + F.col(c))
    out_n = F.lit(total + 1.0) - own("n")
    out_k = (F.col("all_k") - own("k")).cast("double") + F.lit(once)
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    pooled = (k + out_k) / (n + out_n)
    contrast = 2 * (_gain(k, n, pooled) + _gain(out_k, out_n, pooled) + _gain(n - k, n, 1 - pooled) + _gain(out_n - out_k, out_n, 1 - pooled))
    contrast = F.when(k / n > out_k / out_n, F.greatest(contrast, F.lit(0.0))).otherwise(0.0)
    alone = F.when(F.col("enough") & (k / n > once), 2 * (_gain(k, n, F.lit(once)) + _gain(n - k, n, F.lit(1 - once)))).otherwise(0.0)
    return written(x.select("source", "line_hash", F.col("k").alias("n_documents"), F.col("n").alias("size"), "enough", F.greatest(contrast, alone).alias("llr")), "scored-lines")


def excess_lines(
    pages: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, false_discovery: float = FALSE_DISCOVERY
) -> DataFrame:
    """(source, line_hash, n_documents, llr): the lines a source repeats excessively.

    Hypotheses are all of `scored_lines`. Those are kept whose ratio lies beyond the Benjamini-Hochberg
    threshold for `false_discovery` (one-sided, from a histogram of fixed size, rounded to the cautious
    side) and that meet the two minima.
    """
    scored = scored_lines(pages, min_documents, min_share)
    least = _threshold(_bins(scored), false_discovery)
    return scored.where((F.col("llr") >= least) & F.col("enough")).select("source", "line_hash", "n_documents", "llr")


def _bins(scored: DataFrame) -> dict[int, int]:
    bins = scored.groupBy(F.least(F.floor(F.col("llr") * _STEPS), F.lit(_BINS - 1)).alias("bin")).agg(F.count("*").alias("n")).collect()
    return {r["bin"]: r["n"] for r in bins}


def test_counts(pages: DataFrame, **limits) -> DataFrame:
    """(tested, no_excess, below_minima, found): what became of the pairs that `excess_lines` tests; one row.

    `no_excess` are rejected by the ratio, `below_minima` pass it and miss a minimum.
    """
    false_discovery = limits.pop("false_discovery", FALSE_DISCOVERY)
    scored = scored_lines(pages, **limits)
    passes = F.col("llr") >= _threshold(_bins(scored), false_discovery)
    return scored.agg(F.count("*").alias("tested"), F.count_if(~passes).alias("no_excess"), F.count_if(passes & ~F.col("enough")).alias("below_minima"), F.count_if(passes & F.col("enough")).alias("found"))


def _threshold(bins: dict[int, int], rate: float) -> float:
    """The least ratio whose bin passes p <= rate * rank / tests; infinite if none does."""
    best, rank, tests = math.inf, 0, sum(bins.values())
    for b in sorted(bins, reverse=True):
        rank += bins[b]
        if math.erfc(math.sqrt(max(0, b) / _STEPS / 2)) / 2 <= rate * rank / tests:
            best = b / _STEPS
    return best


def repeated_lines(pages: DataFrame, **limits) -> DataFrame:
    """(page_id, line_no) of the lines repeated excessively in their source, each once."""
    found = excess_lines(pages, **limits).select("source", "line_hash")
    f, a = small(found).alias("f"), lines(pages, count_letters=False).alias("a")
    hit = a.join(f, (F.col("a.line_hash") == F.col("f.line_hash")) & F.col("a.source").eqNullSafe(F.col("f.source")), "left_semi")
    return hit.select("page_id", "line_no").distinct()


def strip_repeated_lines(pages: DataFrame, **limits) -> DataFrame:
    """(page_id, text) of every page, once, without the lines its source repeats excessively.

    The other lines keep their order and line ends. Null and empty texts stay as they are.
    """
    drop = repeated_lines(pages, **limits).groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
    p, d = pages.select("page_id", "text").dropDuplicates(["page_id"]).alias("p"), drop.alias("d")
    kept = F.filter(F.split("p.text", "\n", -1), lambda _, i: ~F.array_contains("d.drop", i + 1))
    return p.join(d, F.col("p.page_id") == F.col("d.page_id"), "left").select(
        "p.page_id", F.when(F.col("d.drop").isNull(), F.col("p.text")).otherwise(F.array_join(kept, "\n")).alias("text")
    )
