from leafmill.functions.udtf import register
from leafmill.operators import segment as S


def test_lateral_split(spark):
    register(spark)
    text = "Alpha beta gamma. Delta epsilon zeta eta theta. Iota kappa lambda."
    spark.createDataFrame([(1, text), (2, None)], "id int, text string").createOrReplaceTempView("udtf_pages")
    got = spark.sql("SELECT p.id, s.segment, s.start FROM udtf_pages p, LATERAL split_page(p.text, 20, 40, 'page_passages') s ORDER BY s.piece").collect()
    assert [(r["segment"], r["start"]) for r in got] == [(s.text, s.start) for s in S.semantic(text, 20, 40, "page_passages")]
    got = spark.sql("SELECT s.segment FROM udtf_pages p, LATERAL split_text(p.text, 30, 5) s ORDER BY s.piece").collect()
    assert [r[0] for r in got] == S.greedy(text, 30, 5)
    spark.catalog.dropTempView("udtf_pages")
