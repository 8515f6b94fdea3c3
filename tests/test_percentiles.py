import random

import numpy as np

from leafmill.operators import report as R


def test_exact_percentiles(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("many", rng.gauss(0, 100)) for _ in range(3000)] + [("same", 7.0)] * 50 + [("two", 1.0), ("two", 2.0), ("one", 5.0), (None, 3.0), (None, 4.0), ("none", None)] + [("few", float(rng.randrange(4))) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.0, "e": 1.0}
    for accuracy in (10_000, 50):  # coarse brackets as well
        monkeypatch.setattr(R, "ACCURACY", accuracy)
        got = {r["g"]: r for r in R.percentiles(df, "v", ["g"], at).collect()}
        assert set(got) == {"many", "same", "two", "one", "few", None}
        for g, r in got.items():
            x = [v for k, v in rows if k == g]
            assert r["n"] == len(x) and np.allclose([r[k] for k in at], np.quantile(x, list(at.values()))), (accuracy, g)
    whole = R.percentiles(df, "v", [], {"q": 0.3}).first()
    assert np.isclose(whole["q"], np.quantile([v for _, v in rows if v is not None], 0.3))
    assert R.percentiles(df.where("false"), "v", ["g"], at).count() == 0 and R.size_groups(df.where("false"), "v", "v").count() == 0
