"""Statistics over measured trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import small, written


#: Digits that statistics are rounded to.
DIGITS = 3


#: How finely ranks are bracketed before they are counted: a bracket holds about four parts of this many of a group.
ACCURACY = 10_000


def percentiles(df: DataFrame, value: str, group: list[str], at: dict[str, float]) -> DataFrame:
    """(group, n, a column per name in `at`): exact percentiles, interpolated between neighbours; null values don't count.

    No group is gathered in one task: an approximate sketch brackets each rank, one pass counts what
    lies below and above the brackets in every task, and only the distinct values within them are
    ordered. `df` is read twice; without a `group` the whole table is one.
    """
    v = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    v = v if group else v.withColumn("_all", F.lit(0))
    keys = group or ["_all"]
    qs = list(at.values())
    sketch = [F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, q + d * 2 / ACCURACY))) for q in qs]), F.lit(ACCURACY)).alias(n) for n, d in (("_lows", -1), ("_highs", 1))]
    marks = small(written(v.groupBy(*keys).agg(F.count("*").alias("_n"), *sketch), "percentile-brackets"))
    x = v.join(marks.withColumnsRenamed({k: f"_m{k}" for k in keys}), [v[k].eqNullSafe(F.col(f"_m{k}")) for k in keys])
    # each value stands in a bracket, or in one of the stretches between brackets, of which the ends and the count matter
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(qs) - 1)), lambda i: (F.col("_v") >= F.get("_lows", i)) & (F.col("_v") <= F.get("_highs", i)))
    stretch = F.aggregate(F.concat("_lows", "_highs"), F.lit(0), lambda n, m: n + F.when(F.col("_v") > m, 1).otherwise(0))
    x = x.select(*keys, "_n", F.when(F.size(inside) > 0, F.col("_v")).alias("_in"), F.when(F.size(inside) == 0, stretch).alias("_out"), "_v")
    c = x.groupBy(*keys, "_n", "_in", "_out").agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    w = Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("_to", F.sum("_c").over(w))
    # a rank within a stretch can only be its first or last value
    first = F.col("_to") - F.col("_c")

    def of(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank < F.col("_to")), F.when(rank == F.col("_to") - 1, F.col("_z")).otherwise(F.col("_a"))))

    aggs = []
    for i, q in enumerate(qs):
        h = (F.col("_n") - 1) * F.lit(q)
        aggs += [of(F.floor(h)).alias(f"_l{i}"), of(F.ceil(h)).alias(f"_h{i}"), F.max(h - F.floor(h)).alias(f"_f{i}")]
    g = c.groupBy(*keys).agg(F.max("_n").alias("n"), *aggs)
    return g.select(*group, "n", *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(name) for i, name in enumerate(at)])


def _with(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Both frames side by side by group, nulls equal."""
    r = right.withColumnsRenamed({k: f"_r{k}" for k in group})
    on = [left[k].eqNullSafe(F.col(f"_r{k}")) for k in group]
    return left.join(r, on).drop(*[f"_r{k}" for k in group])


def summary(df: DataFrame, value: str, group: list[str], digits: int = DIGITS) -> DataFrame:
    """Count, mean, median, min, max, sample variance; the variance is null for a single value."""
    v = F.col(value)
    d = written(df.where(v.isNotNull()).select(*group, value), "summary-values")
    plain = d.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.avg(v), digits).alias("mean"), F.round(F.min(v), digits).alias("min"), F.round(F.max(v), digits).alias("max"), F.round(F.var_samp(v), digits).alias("variance"))
    middle = percentiles(d, value, group, {"median": 0.5}).select(*group, F.round("median", digits).alias("median"))
    return _with(plain, middle, group).select(*group, "n", "mean", "median", "min", "max", "variance")


def quartiles(df: DataFrame, value: str, group: list[str], digits: int = DIGITS) -> DataFrame:
    """Inclusive quartiles, null for fewer than two values."""
    q = percentiles(written(df.select(*group, value), "quartile-values"), value, group, {"q1": 0.25, "q3": 0.75})
    return q.select(*group, *[F.when(F.col("n") > 1, F.round(c, digits)).alias(c) for c in ("q1", "q3")])


def outliers(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Flags rows beyond 1.5 interquartile ranges of their group; bounds come from positive values only.

    The bounds are one row per group and are joined back, so a hot group is never gathered. Rows of a
    null group or without a value are no outliers.
    """
    b = percentiles(df.where(F.col(value) > 0), value, group, {"_q1": 0.25, "_q3": 0.75}).where(F.col("n") > 1)
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    b = small(written(b.select(*group, (F.col("_q1") - reach).alias("low"), (F.col("_q3") + reach).alias("high")), "outlier-bounds"))
    flag = F.coalesce((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")), F.lit(False))
    return df.join(b, group, "left").withColumn("outlier", flag).drop("low", "high")


def stage_summary(df: DataFrame, stages: list[str], group: list[str], digits: int = DIGITS) -> DataFrame:
    """Mean, median, min and max of each stage column; a missing stage counts as 0."""
    long = written(df.unpivot(group, stages, "stage", "seconds").select(*group, "stage", F.coalesce("seconds", F.lit(0.0)).alias("seconds")), "stage-seconds")
    keys = [*group, "stage"]
    plain = long.groupBy(*keys).agg(F.round(F.avg("seconds"), digits).alias("mean"), F.round(F.min("seconds"), digits).alias("min"), F.round(F.max("seconds"), digits).alias("max"))
    middle = percentiles(long, "seconds", keys, {"median": 0.5}).select(*keys, F.round("median", digits).alias("median"))
    return _with(plain, middle, keys).select(*keys, "mean", "median", "min", "max")


def trial_variance(df: DataFrame, document: str, value: str, digits: int = DIGITS) -> DataFrame:
    """Per document count, mean, min, max, variance, and the difference if there are exactly two trials."""
    v = F.col(value)
    return df.groupBy(document).agg(F.count(v).alias("trials"), F.round(F.avg(v), digits).alias("mean"), F.round(F.min(v), digits).alias("min"), F.round(F.max(v), digits).alias("max"), F.round(F.var_samp(v), digits).alias("variance"), F.round(F.when(F.count(v) == 2, F.max(v) - F.min(v)), digits).alias("difference"))


def size_groups(df: DataFrame, size: str, value: str, digits: int = DIGITS) -> DataFrame:
    """(size_group, n, mean) of small (<= q1), middle and large (>= q3) items; with q1 = q3 a row is in both."""
    d = written(df.select(*dict.fromkeys((size, value))), "sizes")
    q = percentiles(d, size, [], {"q1": 0.25, "q3": 0.75}).first()
    low, high = (F.lit(q["q1"]), F.lit(q["q3"])) if q else (F.lit(None).cast("double"), F.lit(None).cast("double"))
    s = F.col(size)
    names = F.array_compact(F.array(F.when(s <= low, "lower"), F.when((s > low) & (s < high), "middle"), F.when(s >= high, "upper")))
    return d.select(value, F.explode(names).alias("size_group")).groupBy("size_group").agg(F.count("*").alias("n"), F.round(F.avg(value), digits).alias("mean"))


def checkpoint_accuracy(points: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Per checkpoint: mean absolute progress error of recorded rows and mean ETA error of those that have one."""
    ok = F.col("status") == "recorded"
    return points.groupBy("checkpoint").agg(F.count_if(ok).alias("recorded"), F.round(F.avg(F.when(ok, F.abs("error"))), digits).alias("mean_error"), F.round(F.max(F.when(ok, F.abs("error"))), digits).alias("max_error"), F.count("eta_error").alias("with_eta"), F.round(F.avg("eta_error"), digits).alias("mean_eta_error"))


def status_rollup(df: DataFrame, group: list[str], status: str, value: str, statuses: list[str]) -> DataFrame:
    """Counts by status and the total of a value."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses]
    return df.groupBy(*group).agg(F.count("*").alias("n"), *counts, F.round(F.sum(value), 2).alias("total"))


def cohorts(df: DataFrame, conditions: dict[str, Column], value: str, digits: int = DIGITS) -> DataFrame:
    """(cohort, n, mean, median): overlapping cohorts in one pass."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    d = written(df.select(value, F.explode(names).alias("cohort")), "cohorts")
    plain = d.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg(value), digits).alias("mean"))
    return _with(plain, percentiles(d, value, ["cohort"], {"median": 0.5}).select("cohort", F.round("median", digits).alias("median")), ["cohort"])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merged_trace(rows: DataFrame, run: str, at: str = "at", source: str = "source", seq: str = "seq") -> DataFrame:
    """Adds `place`: the order of a run's rows by time; of one time those of the interface's timer come first."""
    w = Window.partitionBy(run).orderBy(at, F.when(F.col(source) == "ui_timer", 0).otherwise(1), seq)
    return rows.withColumn("place", F.row_number().over(w))


def placed(rows: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """Adds the place 1, 2, ... of each row in a total order.

    The rows are sorted by range over all tasks; each partition is numbered by itself and the counts of
    the partitions before it are added, so no task ever holds all rows.
    """
    spark = rows.sparkSession
    t = written(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), "placed")
    sizes = sorted((r["_part"], r["n"]) for r in t.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one number a task
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    w = Window.partitionBy("_part").orderBy(*order)
    starts = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    return t.withColumn("_rank", F.row_number().over(w)).join(starts, "_part").withColumn(place, F.col("_before") + F.col("_rank")).drop("_part", "_before", "_rank")
