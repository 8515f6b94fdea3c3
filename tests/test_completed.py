from pyspark.sql import functions as F

from leafmill.streaming import progress as P


def test_completed_counts_are_exact(spark, tmp_path):
    n = 20_000
    e = spark.range(2 * n).select(F.concat(F.lit("r"), F.col("id") % 3).alias("run"), F.lit("2026-01-01T00:00:00Z").alias("recorded_at"), F.lit("doc_complete").alias("type"), F.concat(F.lit("d/"), F.floor(F.col("id") / 6)).alias("location"))
    e.write.json(str(tmp_path / "in"))
    counts = P.completed_counts(P.event_stream(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("exact").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = -(-2 * n // 6)
    got = {r["run"]: r["completed"] for r in spark.table("exact").collect()}
    assert got == {"r0": want, "r1": want, "r2": want}
