from leafmill import session as S


def test_written_survives_its_source(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "x"))
    df = S.written(spark.read.parquet(str(tmp_path / "x")).selectExpr("id", "array(id) AS a"), "t")
    for p in (tmp_path / "x").iterdir():
        p.unlink()
    assert df.count() == 5 and df.columns == ["id", "a"]


def test_small_hints_only_within_the_bound(spark):
    df = spark.range(10)
    hinted = lambda x: "BroadcastExchange" in x._jdf.queryExecution().toString() or "rightHint=(strategy=broadcast)" in x._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert hinted(df.join(S.small(df), "id"))
        assert not hinted(df.join(S.small(df, limit=639), "id")) and hinted(df.join(S.small(df, limit=640), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder_is_the_configured_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert S.shared_dir(spark) == named.rstrip("/") if named else S.shared_dir(spark).startswith("file:")


def test_size_counts_what_rows_hold(spark):
    df = spark.createDataFrame([(1, "x" * 1000, ["y" * 5000]), (2, None, None)], "id int, a string, b array<string>")
    assert 6000 < S.measured_bytes(df) < 6400


def test_tidy_leaves_nothing(spark):
    kept = S.written(spark.range(3), "kept")
    before = S.written_tables(spark)
    with S.tidy(spark):
        assert S.written(spark.range(4), "gone").count() == 4 and len(S.written_tables(spark)) == len(before) + 1
    assert S.written_tables(spark) == before and kept.count() == 3
    assert S.drop_written(spark, before - {n for n in before if n.startswith("kept")}) >= 1


def test_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace as N

    import pytest

    none = N(isDefined=lambda: False)
    bare = N(conf=N(get=lambda k, d: d), sparkContext=N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none))))
    with pytest.raises(ValueError):
        S.shared_dir(bare)
