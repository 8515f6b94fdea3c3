"""Resolving models, settings and outcomes from several layers of knowledge."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import text as X
from leafmill.operators.match import STOPWORDS, beginner, first_hint, matched

# Fixed value: the limit assumed for a model that nothing is known of.
UNKNOWN_LIMIT = 4096
# Fixed value: what a queue message begins with.
QUEUE = "Desktop queue: "
# What a secret's name contains.
SECRET_MARKERS = ("KEY", "SECRET", "TOKEN", "PASSWORD")
# Outcomes of the three layers of evidence that count as success.
UPLOADED = ("complete", "complete_with_key_cleanup_warning")
STORED = ("pass", "pass_with_missing_workspace_document_records")
ANSWERED = ("pass",)
# Fixed value: a strip of fewer words proves nothing.
LEAST_WORDS = 8


def model_key(c: Column) -> Column:
    """A model's name for comparing: one blank between words, none outside, case folded."""
    return X.fold(X.collapse(F.coalesce(c, F.lit(""))))


def runtime_limit(provider: Column, declared: Column) -> Column:
    """The lesser of what provider and model declare, either if only one does (0 declares nothing), else UNKNOWN_LIMIT."""
    p, d = F.nullif(provider, F.lit(0)), F.nullif(declared, F.lit(0))
    return F.coalesce(F.least(p, d), p, d, F.lit(UNKNOWN_LIMIT))


def aliased(catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, model): the given aliases, and each catalog model's own name unless an alias has it already.

    Of an alias given twice the last by `priority` counts.
    """
    given = aliases.groupBy("alias").agg(F.max_by("model", "priority").alias("model"))
    own = catalog.groupBy(model_key(F.col("model")).alias("alias")).agg(F.max("model").alias("model")).where(F.col("alias") != "")
    return given.unionByName(own.join(given, "alias", "left_anti"))


def resolve_models(asked: DataFrame, catalog: DataFrame, aliases: DataFrame, hints: DataFrame) -> DataFrame:
    """(provider, model, canonical, limit, status, basis): what is known of each model asked for, each once.

    `catalog` has provider, model, limit, verified; `aliases` alias, model, priority; `hints` hint,
    ordinal, limit. A catalog row of the provider wins, by alias or by name; then the first family hint
    that the name holds; else the conservative base. Catalogs and hints are small tables.
    """
    a = asked.select(F.lower(F.btrim(F.coalesce("provider", F.lit("")))).alias("provider"), F.coalesce("model", F.lit("")).alias("model")).distinct().withColumn("key", model_key(F.col("model")))
    named = aliased(catalog, aliases).select(F.col("alias").alias("key"), F.col("model").alias("aliased"))
    a = a.join(named, "key", "left").withColumn("canonical", F.coalesce("aliased", "key"))
    c = catalog.groupBy(F.lower(F.btrim("provider")).alias("provider"), F.col("model").alias("canonical")).agg(F.max_by(F.struct("limit", "verified"), "limit").alias("c"))
    h = first_hint(a.select(F.col("key").alias("name")), hints.select("hint", "ordinal")).join(hints.select("ordinal", F.col("limit").alias("hint_limit")), "ordinal").select(F.col("name").alias("key"), "hint_limit")
    x = a.join(c, ["provider", "canonical"], "left").join(h, "key", "left")
    listed = F.col("c").isNotNull()
    status = F.when(listed & F.col("c.verified"), "verified").when(listed | F.col("hint_limit").isNotNull(), "conservative").otherwise("unknown_capability")
    basis = F.when(listed, "catalog").when(F.col("hint_limit").isNotNull(), "family_fallback").otherwise("unknown")
    return x.select("provider", "model", "canonical", F.coalesce("c.limit", "hint_limit", F.lit(UNKNOWN_LIMIT)).alias("limit"), status.alias("status"), basis.alias("basis"))


def local_capability(names: DataFrame, inspected: DataFrame, hints: DataFrame) -> DataFrame:
    """(name, limit, recommended, embedding_length, basis): a local model's own metadata, with its family's policy on top.

    `inspected` has name, context_length, embedding_length; `hints` hint, ordinal, limit, recommended, embedding_length.
    """
    family = first_hint(names.select("name"), hints.select("hint", "ordinal")).join(hints.select("ordinal", F.col("limit").alias("f_limit"), F.col("recommended").alias("f_recommended"), F.col("embedding_length").alias("f_length")), "ordinal")
    x = names.select("name").distinct().join(inspected.select("name", F.lit(True).alias("seen"), "context_length", "embedding_length"), "name", "left").join(family.select("name", "f_limit", "f_recommended", "f_length"), "name", "left")
    seen, kin = F.col("seen").isNotNull(), F.col("f_limit").isNotNull()
    own = F.coalesce(F.nullif("context_length", F.lit(0)), F.lit(UNKNOWN_LIMIT))
    return x.select(
        "name", F.when(seen, own).otherwise(F.coalesce("f_limit", F.lit(UNKNOWN_LIMIT))).alias("limit"),
        F.coalesce(F.nullif("f_recommended", F.lit(0)), F.when(seen, own), F.lit(UNKNOWN_LIMIT)).alias("recommended"), F.coalesce(F.when(seen, F.nullif("embedding_length", F.lit(0))), "f_length").alias("embedding_length"),
        F.when(seen & kin, "runtime_metadata_plus_family_policy").when(seen, "runtime_metadata").when(kin, "family_fallback").otherwise("unknown").alias("basis"),
    )


def secret_safe(key: Column, value: Column) -> dict[str, Column]:
    """value, present and value_hash of a setting; a secret's value is blank, its hash stays."""
    secret = F.upper(key).rlike("|".join(SECRET_MARKERS))
    there = F.coalesce(value, F.lit("")) != ""
    return {"value": F.when(secret, "").otherwise(F.coalesce(value, F.lit(""))), "present": there, "value_hash": F.when(there, F.sha2(value, 256)).otherwise("")}


def env_line(key: Column, value: Column) -> Column:
    """`KEY="value"` with JSON quoting; null for a key of other characters or a value of several lines."""
    good = F.btrim(key).rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~value.rlike(r"[\r\n]")
    quoted = F.to_json(F.array(value))
    return F.when(good, F.concat(F.btrim(key), F.lit("="), F.substr(quoted, F.lit(2), F.length(quoted) - 2)))


def keep_both_regions(widths: Column, texts: Column, ratio: float = 0.58, least: int = 240) -> Column:
    """A spread's two regions both count if neither is a mere strip and each holds real text."""
    return (F.size(widths) == 2) & (F.array_min(widths) >= ratio * F.array_max(widths)) & F.forall(texts, lambda t: F.length(F.coalesce(t, F.lit(""))) >= least)


def queue_message(kind: Column, doc: Column, docs: Column, done: Column, total: Column, cached: Column, prefix: str = QUEUE) -> Column:
    """What a queue event tells an operator; numbers count from 1, cached work is named only on evidence."""
    record = F.concat(F.lit("record "), (doc + 1).cast("string"), F.lit("/"), docs.cast("string"))
    reuse = F.concat(F.lit("reusing cached embeddings for "), record, F.lit("; writing its page-parent record to this workspace"))
    said = F.when((kind == "doc_starting") & F.coalesce(cached, F.lit(False)), reuse).when(kind == "chunk_progress", F.concat(record, F.lit(", chunks "), done.cast("string"), F.lit("/"), total.cast("string"))).otherwise(record)
    return F.concat(F.lit(prefix), said)


def layers_succeeded(upload: Column, stored: Column, answered: Column) -> Column:
    """All three layers of evidence succeeded; null doesn't."""
    no = F.lit("")
    return F.coalesce(upload, no).isin(*UPLOADED) & F.coalesce(stored, no).isin(*STORED) & F.coalesce(answered, no).isin(*ANSWERED)


def stage_outcome(status: Column, asked_upload: Column, succeeded: Column) -> Column:
    """A stage that was to upload is degraded where the evidence failed."""
    return F.when(F.coalesce(asked_upload, F.lit(False)) & ~succeeded, "degraded").otherwise(status)


def refreshed_exclusions(status: Column, uncertain: Column, reasons: Column, exclusions: Column) -> dict[str, Column]:
    """reasons, exclusions and changed after a run is judged again: each reason is added once, at the end, in order."""
    none = F.expr("cast(array() as array<string>)")
    reasons, exclusions = F.coalesce(reasons, none), F.coalesce(exclusions, none)
    unsure = F.when(uncertain, F.array(F.lit("observer_uncertainty"))).otherwise(none)
    state = F.lower(F.coalesce(status, F.lit("")))
    ended = F.when((state != "") & (state != "successful"), F.array(F.lit("terminal_not_successful"))).otherwise(none)
    more = lambda old, new: F.concat(old, F.array_except(new, old))
    new_reasons, new_exclusions = more(reasons, unsure), more(exclusions, F.concat(unsure, ended))
    return {"reasons": new_reasons, "exclusions": new_exclusions, "changed": (F.size(new_reasons) > F.size(reasons)) | (F.size(new_exclusions) > F.size(exclusions))}


def benchmark_state(missing: Column, failures: Column) -> Column:
    return F.when(missing > 0, "awaiting-rerun").when(failures > 0, "calibration-failed").otherwise("completed")


def calibration_eligible(status: Column, comparable: Column, invalid: Column, controller: Column, revision: Column, current: tuple[int, int]) -> Column:
    """A successful, comparable, valid run of the current protocol (controller, revision); null counts against it."""
    no = F.lit(False)
    return F.coalesce((controller == current[0]) & (revision == current[1]), no) & (F.lower(F.coalesce(status, F.lit(""))) == "successful") & F.coalesce(comparable, no) & ~F.coalesce(invalid, no)


def evidence_pick(pages: DataFrame, evidence: str, default: Column, key: str = "document_id") -> DataFrame:
    """(key, evidence): that of a document's first page that carries one, else the default."""
    first = F.min(F.when(F.col(evidence).isNotNull(), F.struct("page", evidence)))
    return pages.groupBy(key).agg(first.alias("f")).select(key, F.coalesce(F.col(f"f.{evidence}"), default).alias(evidence))


def enriched(public: DataFrame, private: DataFrame, keys: list[str]) -> DataFrame:
    """Public rows with what the private row of the same keys adds; a private row given twice counts once."""
    rest = [c for c in private.columns if c not in keys]
    once = private.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_p"))
    return public.join(once, keys, "left").select(*public.columns, *[F.col(f"_p.{c}").alias(c) for c in rest if c not in public.columns])


def unmet_capabilities(required: DataFrame, known: DataFrame) -> DataFrame:
    """(name, status): required capabilities that aren't supported, `missing` if nothing is known of them."""
    x = required.select("name").distinct().join(known.select("name", "status"), "name", "left")
    return x.where(F.col("status").isNull() | (F.col("status") != "supported")).select("name", F.coalesce("status", F.lit("missing")).alias("status"))


def first_of_each(df: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows of each group; 0 means all.

    The rows that can't be among them are dropped in every task before the shuffle (window group limit).
    """
    if limit <= 0:
        return df
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit).drop("_rank")


def unknown_fields(fields: Column, allowed: list[str]) -> Column:
    """Names that aren't allowed, sorted."""
    return F.array_sort(F.array_except(fields, F.array(*[F.lit(a) for a in allowed])))


def resolve_runovers(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(document_id, page, text, decision, matched, fragments, ratio): pages after strips that ran over from a neighbour are judged.

    `candidates` has document_id, page, narrow (the strip's text) and dominant (the page without it). A
    strip goes (`confirmed_excluded`) if its words stand on the pages numbered one less and one more,
    else the page stays (`ambiguous_retained`). Order matters: the page before counts as it is after its
    own strip went. Pages without a candidate have no decision.
    """
    c = candidates.groupBy("document_id", "page").agg(F.max(F.struct("narrow", "dominant")).alias("c"))
    c = c.select("document_id", "page", "c.*", F.lit(True).alias("nominated"))
    return judge_runovers(pages.select("document_id", "page", "text").join(c, ["document_id", "page"], "left"))


def judge_runovers(pages: DataFrame) -> DataFrame:
    """What `resolve_runovers` tells, of pages that bring their own `narrow`, `dominant` and `nominated`.

    Texts stay where they are: a strip's words go to the pages before and after, which answer with a bit
    for each. A page that is nominated itself answers for its text with and without its strip. So every
    strip has its outcome under both decisions of the page before, and decisions are narrow rows carried
    through the document. `pages` is only the left side of left joins: no filter is pushed into it, so
    that its shuffle is made once and read again.
    """
    on = ["document_id", "page"]
    text, none = F.lit(None).cast("string"), F.lit(None).cast("array<bigint>")
    x = pages.select(*on, F.coalesce("text", F.lit("")).alias("text"), "narrow", F.coalesce("dominant", F.lit("")).alias("dominant"), F.coalesce("nominated", F.lit(False)).alias("nominated"))
    q = x.select(*on, _strip_words(F.when(F.col("nominated"), F.coalesce("narrow", F.lit("")))).alias("words"))
    q = q.withColumn("n", F.when(F.col("words") == "", 0).when(F.col("words").isNotNull(), F.size(F.split("words", " "))))
    # fewer words than LEAST_WORDS prove nothing and aren't asked about
    asked, page = F.when(F.col("n") >= LEAST_WORDS, F.col("words")), F.col("page")
    # with the document inside as well, so that no filter on it gets below
    to = lambda at, n, prev, after: F.struct("document_id", at.alias("page"), n.alias("n"), prev.alias("prev"), after.alias("next"))
    no = F.lit(None).cast("int")
    q = q.select(F.explode(F.array(to(page, F.col("n"), text, text), to(page + 1, no, asked, text), to(page - 1, no, text, asked))).alias("q")).select("q.*")
    q = q.where(F.col("n").isNotNull() | F.col("prev").isNotNull() | F.col("next").isNotNull())
    q = q.groupBy(*on).agg(*[F.max(c).alias(c) for c in ("n", "prev", "next")])

    own = F.when(F.col("n").isNotNull() & F.col("next").isNotNull(), F.col("dominant"))
    x_q = x.join(q, on, "left").select(*on, "n", "prev", "next", F.when(F.col("prev").isNotNull() | F.col("next").isNotNull(), F.col("text")).alias("text"), own.alias("dominant"))
    bits = T.ArrayType(T.LongType())
    found = x_q.mapInArrow(_standing, T.StructType([*[x.schema[k] for k in on], T.StructField("n", T.IntegerType()), *[T.StructField(k, bits) for k in ("after", "before", "without")]]))
    to = lambda at, n, *found: F.struct(at.alias("page"), n.alias("n"), *[c.alias(k) for c, k in zip(found, ("after", "before", "without"))])
    a = found.select("document_id", F.explode(F.array(to(page, F.col("n"), none, none, none), to(page - 1, no, F.col("after"), none, none), to(page + 1, no, none, F.col("before"), F.col("without")))).alias("a")).select("document_id", "a.*")
    a = a.where(F.col("n").isNotNull() | F.col("after").isNotNull() | F.col("before").isNotNull()).repartition("document_id")
    a = a.groupBy(*on).agg(*[F.max(c).alias(c) for c in ("n", "after", "before", "without")]).where(F.col("n").isNotNull())

    # m0, m1: words found if the page before stays, if its strip goes; the same where it isn't nominated
    m1 = F.when(F.col("without").isNotNull(), _either("after", "without")).otherwise(F.col("m0"))
    a = a.withColumn("m0", _either("after", "before")).withColumn("m1", m1)
    sure = lambda m: (F.col(m) >= 8) & (F.when(F.col("n") > 0, F.col(m) / F.col("n")).otherwise(0.0) >= 0.8)
    a = a.withColumn("s0", sure("m0")).withColumn("s1", sure("m1"))
    # a page's decision is fixed, or that of the page before, or its contrary: the last fixed one and the parity of contraries since
    w = Window.partitionBy("document_id").orderBy("page")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("turns", F.sum((F.col("s0") & ~F.col("s1")).cast("int")).over(so_far))
    fixed = F.when(F.col("s0") == F.col("s1"), F.col("s0").cast("int") + F.col("turns"))
    a = a.withColumn("sure", (F.last(fixed, ignorenulls=True).over(so_far) + F.col("turns")) % 2 == 1)
    gone = F.col("without").isNotNull() & F.coalesce(F.lag("sure").over(w), F.lit(False))
    d = a.select(*on, "sure", F.when(gone, F.col("m1")).otherwise(F.col("m0")).alias("matched"), F.col("n").alias("fragments"))
    d = d.withColumn("ratio", _ratio("matched", "fragments"))

    decision = F.when(F.col("sure"), "confirmed_excluded").when(F.col("sure").isNotNull(), "ambiguous_retained")
    judged = F.when(F.col("sure"), F.col("dominant")).otherwise(F.col("text"))
    return x.join(d, on, "left").select("document_id", page.cast("int").alias("page"), judged.alias("text"), decision.alias("decision"), "matched", "fragments", "ratio")


def _either(one: str, other: str) -> Column:
    """How many bits stand in either of two arrays of the same length; null has none."""
    none = F.expr("cast(array() as array<bigint>)")
    both = F.zip_with(F.coalesce(one, none), F.coalesce(other, none), lambda a, b: F.bit_count(F.coalesce(a, F.lit(0)).bitwiseOR(F.coalesce(b, F.lit(0)))))
    return F.aggregate(both, F.lit(0), lambda s, b: s + b)


@F.arrow_udf(returnType=T.StringType())
def _strip_words(narrow: pa.Array) -> pa.Array:
    """A strip's distinct words, sorted, with blanks between."""
    return pa.array([None if t is None else " ".join(sorted(strip_words(t))) for t in narrow.to_pylist()], pa.string())


@F.arrow_udf(returnType=T.DoubleType())
def _ratio(found: pa.Array, of: pa.Array) -> pa.Array:
    """Rounded as Python does."""
    return pa.array([round(m / n, 3) if n else 0.0 for m, n in zip(found.to_pylist(), of.to_pylist())], pa.float64())


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which words of the strips before (`after`) and after (`before`, `without`) stand on a page: 62 bits a number."""

    def bits(words: str, hit: Callable[[str], bool]) -> list[int]:
        fragments = words.split(" ")
        out = [0] * -(-len(fragments) // 62)
        for i, f in enumerate(fragments):
            if hit(f):
                out[i // 62] |= 1 << i % 62
        return out

    kind = pa.list_(pa.int64())
    for b in batches:
        after, before, without = [], [], []
        for prev, following, text, dominant in zip(*[b.column(k).to_pylist() for k in ("prev", "next", "text", "dominant")]):
            hit = None if text is None else beginner(page_words(text))
            after.append(None if prev is None else bits(prev, hit))
            before.append(None if following is None else bits(following, hit))
            without.append(None if dominant is None else bits(following, beginner(page_words(dominant))))
        keys = [b.column(k) for k in ("document_id", "page", "n")]
        yield pa.RecordBatch.from_arrays([*keys, *[pa.array(v, kind) for v in (after, before, without)]], ["document_id", "page", "n", "after", "before", "without"])


def strip_words(narrow: str) -> set[str]:
    return set(re.findall(r"\b[a-zA-Z][a-zA-Z'-]{2,}\b", narrow.casefold())) - set(STOPWORDS)


def page_words(text: str) -> set[str]:
    """The words that prove an overlap: five letters and more."""
    return set(re.findall(r"\b[a-zA-Z][a-zA-Z'-]{4,}\b", text.casefold()))


def overlap(narrow: str, around: str) -> tuple[int, int]:
    """(matched, fragments): distinct words of a strip that begin, or are begun by, words around it; see `fragment_match`."""
    mine, near = strip_words(narrow), page_words(around)
    return (matched(mine, near) if len(mine) >= LEAST_WORDS else 0), len(mine)
