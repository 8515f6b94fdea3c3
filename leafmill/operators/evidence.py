"""Reconciling what was prepared with what was stored and confirmed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.shred import shred

# What a status says about the outcome; every other one is incomplete.
STATUS_CLASSES = {
    "pass": ("pass", "complete", "native_metadata_llm_visible"),
    "review": ("pass_with_missing_workspace_document_records", "verified_unavailable", "review", "native_metadata_llm_visible_vector_only"),
    "error": ("error", "workspace_missing", "blocked", "partial_vector_coverage"),
}


def status_class(status: Column, transient: bool = False) -> Column:
    """pass, review, error or incomplete; a concurrent write is for review, or incomplete if writes are transient."""
    c = F.when(status == "concurrent_write_ambiguous", "incomplete" if transient else "review")
    for name, values in STATUS_CLASSES.items():
        c = c.when(status.isin(*values), name)
    return c.otherwise("incomplete")


def reconcile(layers: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, a flag per layer, stage): which layers know a key, in one shuffle.

    `stage` names the last layer reached without a gap, `out_of_order` if a later layer knows a key that
    an earlier one lacks. Keys are reduced in every task before they travel.
    """
    names = list(layers)
    both = reduce(DataFrame.unionByName, [d.select(key, F.lit(n).alias("layer")) for n, d in layers.items()])
    flags = both.groupBy(key).agg(*[F.bool_or(F.col("layer") == n).alias(n) for n in names])
    reached, broken = F.lit("none"), F.lit(False)
    for a, b in zip(names, names[1:]):
        broken = broken | (F.col(b) & ~F.col(a))
    for n in names:
        reached = F.when(F.col(n), F.lit(n)).otherwise(reached)
    return flags.withColumn("stage", F.when(broken, "out_of_order").otherwise(reached))


def expected_grid(items: DataFrame, classes: DataFrame, column: str, name: str) -> DataFrame:
    """Every item with every class, the classes being the array in the one row of `classes`: a handful by nature.

    They go along as a literal that each item unfolds, so that nothing is joined.
    """
    row = classes.select(column).first()
    values = sorted(row[0]) if row and row[0] else []
    return items.select("*", F.explode(F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")).alias(name))


def missing(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected key combinations that weren't observed."""
    return expected.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")


def count_check(prepared: Column, embedded: Column, after: Column, before: Column) -> Column:
    """Counts agree: something prepared, all of it embedded, no fewer observed; 0 is as good as unknown."""
    observed = F.coalesce(F.nullif(after, F.lit(0)), F.nullif(before, F.lit(0)), F.lit(0))
    return (prepared > 0) & (embedded == prepared) & (observed >= prepared)


def first_verdict(observations: DataFrame, run: str, timeout: float, interval: float, cap: float) -> DataFrame:
    """(run, attempts, waited, verdict): polling until a final status or the deadline.

    Observations come `interval` seconds apart from 0, the last wait cut to the deadline
    min(timeout, cap); at least one is made. The final class is the first of pass, review and error, else timeout.
    """
    interval, deadline = max(0.05, interval), min(timeout, cap)
    at = F.least(F.lit(deadline), (F.col("attempt") - 1) * F.lit(interval))
    inside = (F.col("attempt") == 1) | ((F.col("attempt") - 2) * F.lit(interval) < F.lit(deadline))
    o = observations.withColumn("at", at).where(inside).withColumn("kind", status_class(F.col("status"), transient=True))
    done = F.col("kind") != "incomplete"
    g = o.groupBy(run).agg(F.min(F.when(done, F.struct("attempt", "at", "kind"))).alias("first"), F.max(F.struct("attempt", "at")).alias("last"))
    return g.select(run, F.coalesce("first.attempt", "last.attempt").alias("attempts"), F.round(F.coalesce("first.at", "last.at"), 3).alias("waited"), F.coalesce("first.kind", F.lit("timeout")).alias("verdict"))


def owned_events(events: DataFrame, owned: DataFrame, run: str, location: str = "location") -> DataFrame:
    """Events of owned locations, and completions only once an owned event came before.

    Separators are made alike before locations are compared.
    """
    alike = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    o = owned.select(alike(F.col(location)).alias("_l")).distinct().withColumn("_own", F.lit(True))
    e = events.withColumn("_l", alike(F.col(location))).join(o, "_l", "left").withColumn("_own", F.coalesce("_own", F.lit(False)))
    w = Window.partitionBy(run).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("_seen", F.max("_own").over(w))
    return e.where(F.col("_own") | ((F.col("type") == "all_complete") & F.col("_seen"))).drop("_l", "_own", "_seen")


def queue_guard(feeds: DataFrame, group: list[str]) -> DataFrame:
    """active if any feed reports foreign work, uncertain if any is disconnected, else idle."""
    return feeds.groupBy(*group).agg(F.when(F.bool_or("foreign"), "active").when(F.bool_or(~F.col("connected")), "uncertain").otherwise("idle").alias("guard"))


def ordered_distinct(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Distinct values of a group in order of first appearance.

    Reduced to one row per value before the lists are made.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(order).alias("o"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias("items"))


# Keys a public payload mustn't have, besides `*_path` and `workspace*`.
PRIVATE_KEYS = ("path", "filename", "file_name", "fingerprint", "sha256", "workspace", "api_key", "secret", "text")


def payload_violations(payloads: DataFrame, keys: list[str], text: str, private: tuple[str, ...] = ()) -> DataFrame:
    """(keys, violations): what a JSON payload must not make public, sorted, each once: forbidden keys at any depth, and
    paths, hashes, API keys and the `private` values in its strings. Payloads without any, or that aren't JSON, give no row.
    """
    n = shred(payloads, keys, text)
    label = F.lower("label")
    named = ~F.startswith("label", F.lit("[")) & F.col("parent").isNotNull() & (label.isin(*PRIVATE_KEYS) | F.endswith(label, F.lit("_path")) | F.startswith(label, F.lit("workspace")))
    said = {
        "absolute path": F.col("scalar").rlike(r'(?:[A-Za-z]:\\|\\\\)[^\r\n"]+'), "sha256-like value": F.col("scalar").rlike(r"(?<![\p{L}\p{N}_])[a-fA-F0-9]{64}(?![\p{L}\p{N}_])"),
        "API-key-like value": F.col("scalar").rlike(r"(?i)(?<![\p{L}\p{N}_])(?:sk|api)[_-][a-z0-9_-]{8,}(?![\p{L}\p{N}_])"),
    }
    if values := [p for p in private if p]:
        said["private source value"] = reduce(lambda a, b: a | b, [F.contains("scalar", F.lit(p)) for p in values])
    found = F.array_compact(F.array(F.when(named, F.concat(F.lit("forbidden key: "), "label")), *[F.when((F.col("kind") == "string") & c, F.lit(k)) for k, c in said.items()]))
    return n.select(*keys, F.explode(found).alias("v")).groupBy(*keys).agg(F.array_sort(F.collect_set("v")).alias("violations"))


def privacy_findings(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, findings): what a public payload must not hold, sorted: local paths, hashes, keys, forbidden names."""
    from leafmill.functions.text import SPACE

    rules = {
        "api_key": r"(?i)(?:^|[^a-z0-9_])(?:sk|api)[_-][a-z0-9_-]{8,}",
        "forbidden_key": r'(?i)"(?:[a-z_]*_path|workspace[a-z_]*|source_name|token|secret|password)"[' + SPACE + r"]*:",
        "sha256": r"(?:^|[^a-zA-Z0-9_])[a-fA-F0-9]{64}(?:$|[^a-zA-Z0-9_])",
        "windows_path": r'(?:[A-Za-z]:\\|\\\\)[^\r\n"]+',
    }
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules.items()]))
    return df.select(key, found.alias("findings")).where(F.size("findings") > 0)
