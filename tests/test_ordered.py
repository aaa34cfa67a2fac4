"""Quantiles and AUC over values of which no task may order more than a few."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memaudit.operators import metrics, ordered, rarity


def values(n, seed=1):
    rng = random.Random(seed)
    return [rng.choice([rng.random(), rng.random() * 1e-9, 1e300 * rng.random(), -rng.random()]) for _ in range(n)]


@pytest.mark.parametrize("bound", [7, 100, 1 << 20])
def test_no_range_is_larger_than_the_bound(spark, bound):
    t = spark.createDataFrame([(g, v) for g in ("a", "b") for v in set(values(900, ord(g)))] + [("c", 1.0)], "g string, v double")
    got = ordered.ranged(t, ["g"], "v", bound)
    assert got.count() == t.count()
    spans = got.groupBy("g", "_path").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("g", "_path").collect()
    assert max(r["n"] for r in spans) <= bound
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]) if a["g"] == b["g"])


@pytest.mark.parametrize("bound", [5, 1 << 20])
def test_quantiles_of_all_distinct_and_of_weighted_values(spark, bound):
    probs = (0.0, 0.25, 0.5, 0.95, 1.0)
    for rows in ([(v, 1) for v in values(700)], [(float(i % 11), i % 5 + 1) for i in range(200)], [(3.0, 4)]):
        df = spark.createDataFrame(rows + [(None, 9)], "v double, k long")
        got = rarity.exact_quantiles(df, "v", F.col("k"), probs, bound=bound).first()["q"]
        assert got == pytest.approx(np.quantile(np.repeat([r[0] for r in rows], [r[1] for r in rows]), probs).tolist(), rel=1e-12)
    none = rarity.exact_quantiles(df.limit(0), "v", F.col("k"), probs, bound=bound).first()["q"]
    assert none == [None] * 5


@pytest.mark.parametrize("bound", [4, 1 << 20])
def test_auc_of_all_distinct_scores_and_ties(spark, bound):
    rng, rows = random.Random(3), []
    for model in ("a", "b", "c", None):
        rows += [(model, rng.choice(["train", "test"]) if model != "c" else "train", rng.choice([rng.random(), 0.5, 0.25])) for _ in range(200)]
    rows.append(("a", "test", None))
    got = {r["model"]: r["auc"] for r in metrics.membership_auc(spark.createDataFrame(rows, "model string, split string, reconstruction_score double"), bound=bound).collect()}
    for model in "ab":
        pos = [s for m, y, s in rows if m == model and y == "train"]
        neg = [s for m, y, s in rows if m == model and y == "test" and s is not None]
        assert got[model] == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))
    assert got["c"] is None and set(got) == {"a", "b", "c"}
