import random
import re

import numpy as np
from pyspark.sql import functions as F

from memaudit.operators import rarity


def _profiles(spark):
    rows = []
    for i in range(200):
        g = "None" if i % 3 else f"G{i % 7}"           # one hot genetic profile (two thirds of rows)
        rows.append((f"row_{i}", (g, "None"), ([str(i % 2)], [], [], 0), (i % 3, [], i % 2)))
    schema = ("patient_id string, gen struct<pg:string,vg:string>, "
              "phen struct<aneurysm:array<string>,aas:array<string>,comp:array<string>,bav:int>, "
              "traj struct<n_surg:int,cats:array<string>,reop:int>")
    return spark.createDataFrame(rows, schema)


def test_k_sums_to_n_and_scores(spark):
    p = _profiles(spark)
    counts = rarity.profile_counts(p)
    assert counts.agg(F.sum("k_full")).first()[0] == 200
    s = rarity.rarity_scores(p, cut_lineage=False)
    assert s.count() == 200
    assert s.filter(F.abs(F.col("I_total") - (F.col("I_gen") + F.col("I_phen") + F.col("I_traj"))) > 1e-12).count() == 0


def test_split_sizes_exact(spark):
    p = _profiles(spark)
    s = rarity.splits_table(p)
    per = {r["rarity_group"]: (r["n"], r["t"]) for r in s.groupBy("rarity_group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    for n, t in per.values():
        assert t == (0 if n == 1 else max(1, int(n * 0.2)))


def test_split_singleton_stratum_stays_train(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "patient_id string, g string")
    out = {r["patient_id"]: r["split"] for r in rarity.stratified_split(df, "patient_id", "g").collect()}
    assert out["a"] == "train"
    assert sorted(out.values()).count("test") == 1


def test_describe_and_bands(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "v double")
    d = rarity.describe(df, "v").first()
    assert d["count"] == 100 and d["p50"] == 50.5 and d["min"] == 1.0 and d["max"] == 100.0
    counts = spark.createDataFrame([(1,), (1,), (2,), (4,), (9,)], "n long")
    b = rarity.frequency_bands(counts).first()
    assert (b["n_distinct"], b["n_once"], b["n_twice"], b["n_3_5"], b["n_gt5"]) == (5, 2, 1, 1, 1)


def test_exact_quantiles_match_linear_interpolation(spark):
    rnd = random.Random(5)
    values = [(round(rnd.expovariate(1), 3), rnd.randint(1, 4)) for _ in range(2000)] + [(0.5, 900), (None, 3)]
    df = spark.createDataFrame(values, "v double, w long")
    probs = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)
    got = rarity.exact_quantiles(df, "v", F.col("w"), probs, ranges=16).first()["q"]
    flat = np.repeat([v for v, _ in values[:-1]], [w for _, w in values[:-1]])
    assert np.allclose(got, np.quantile(flat, probs), rtol=0, atol=1e-12)
    assert rarity.exact_quantiles(df.limit(0), "v", F.col("w"), (0.5,)).first()["q"] == [None]


def test_k_anonymity_shares(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,), (9,)], "k_full long")
    r = rarity.k_anonymity_shares(df).first()
    assert (r["n"], r["n_k1"], r["n_k2"], r["n_k5"], r["share_k2"]) == (5, 1, 3, 4, 0.6)


def test_rare_flags_without_genes(spark):
    rows = [(None, None, 0), ("", None, 0), ("A", None, 1), ("A", "", 1), ("A", "B", 2), ("C", None, 0)]
    df = spark.createDataFrame(rows, "pathogenic_gene string, vus_gene string, mortality int")
    df = df.withColumn("surgeries", F.expr("cast(array() as array<struct<present:boolean,cats:array<string>>>)")).withColumn("n_surg", F.lit(0))
    df = df.withColumn("complicating", F.expr("cast(array() as array<string>)")).withColumn("aas", F.expr("cast(array() as array<string>)"))
    r = rarity.rare_flags(df).first()
    assert (r["n"], r["n_rare_gene"], r["n_rare_traj"], r["n_both"], r["n_either"]) == (6, 2, 3, 1, 4)


def test_common_profiles_are_scored_without_a_hot_key(spark):
    """One profile holds a third of the records, 40 hold most others; scores equal a count per record."""
    import math
    from collections import Counter

    rows = [("hot", 0, 1)] * 2000 + [(f"g{i % 40}", i % 3, i % 2) for i in range(3000)] + [(f"rare{i}", i, 7) for i in range(1000)]
    df = spark.createDataFrame([(f"row_{i}", *r) for i, r in enumerate(rows)], "patient_id string, g string, p int, t int")
    df = df.select("patient_id", F.struct("g").alias("gen"), F.struct(F.array("p").alias("p")).alias("phen"), F.struct("t").alias("traj"))
    scored = rarity.rarity_scores(df)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert not any(re.search(r"\b(gen|phen|traj)#", line) for line in plan.splitlines() if "Join" in line)  # no struct is joined
    got = {r["patient_id"]: r for r in scored.collect()}
    n, full = len(rows), Counter(rows)
    axes = [Counter(r[k] for r in rows) for k in range(3)]
    assert len(got) == n
    for i, r in enumerate(rows):
        s = got[f"row_{i}"]
        assert s["k_full"] == full[r] and math.isclose(s["I_total"], sum(-math.log10(axes[k][r[k]] / n) for k in range(3)), abs_tol=1e-12)


def test_two_profiles_under_one_key_end_the_job(spark):
    keyed = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "gen string, gen_a long, gen_b long")
    import pytest
    with pytest.raises(Exception, match="two profiles have one key"):
        rarity.key_counts(keyed, ("gen",)).collect()
