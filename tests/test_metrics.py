import itertools
import math
import random

from pyspark.sql import functions as F

from memaudit.operators import metrics


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_matches_brute_force_and_is_antisymmetric(spark):
    rnd = random.Random(7)
    rows = [(round(rnd.random(), 1), rnd.randint(0, 1)) for _ in range(300)]   # many ties
    df = spark.createDataFrame([("m", s, "train" if y else "test") for s, y in rows], "model string, s double, split string")
    auc = metrics.membership_auc(df, score="s").first()["auc"]
    assert math.isclose(auc, brute_auc(rows), rel_tol=1e-12)
    neg = metrics.membership_auc(df.withColumn("s", -F.col("s")), score="s").first()["auc"]
    assert math.isclose(auc + neg, 1.0, rel_tol=1e-12)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([("m", 0.1, "train"), ("m", 0.2, "train")], "model string, s double, split string")
    assert metrics.membership_auc(df, score="s").first()["auc"] is None


def exact_mcnemar(b, c):
    n = b + c
    if n == 0:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2 ** n)


def test_mcnemar_exact(spark):
    cases = [(3, 9), (9, 3), (0, 0), (0, 7), (40, 55), (500, 430)]
    df = spark.createDataFrame(cases, "b long, c long")
    got = df.select(metrics.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    for (b, c), r in zip(cases, got):
        assert math.isclose(r["p"], exact_mcnemar(b, c), rel_tol=1e-9, abs_tol=1e-300), (b, c)


def test_mcnemar_exact_with_many_discordant_pairs(spark):
    cases = [(1001, 1200), (5000, 5100), (5100, 5000), (2000, 4000), (1500, 1500), (10**9, 10**9 + 150_000), (10**9, 2 * 10**9)]
    df = spark.createDataFrame(cases, "b long, c long")
    got = [r["p"] for r in df.select(metrics.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()]
    for (b, c), p in zip(cases[:5], got):
        n, total, term = b + c, 0, 1
        for k in range(min(b, c) + 1):
            total += term
            term = term * (n - k) // (k + 1)
        assert math.isclose(p, min(1.0, float(2 * total / 2 ** n) if n < 1000 else float(2 * total * 10**40 // 2 ** n) / 1e40), rel_tol=1e-8, abs_tol=1e-30), (b, c)
    b, c = cases[5]  # so many that the normal law with continuity correction is exact to five digits
    assert math.isclose(got[5], math.erfc((c - b - 1) / math.sqrt(b + c) / math.sqrt(2)), rel_tol=1e-4)
    assert got[6] == 0.0


def test_regimes(spark):
    rows = [("e1", "A", "p1", "train", "rare", 1.0, 0.0, 0.9), ("e1", "A", "p2", "train", "common", 0.0, 0.5, 0.4), ("e1", "A", "p3", "test", "rare", 1.0, 1.0, 0.4),
            ("e2", "A", "p1", "train", "rare", 0.2, 0.2, 0.1), ("e2", "A", "p3", "test", "rare", 0.0, 0.0, 0.3)]
    df = spark.createDataFrame(rows, "epoch_regime string, model string, patient_id string, split string, rarity_group string, collapse_score double, "
                                     "combo_score double, reconstruction_score double")
    over = {r["epoch_regime"]: r for r in metrics.regime_overview(df).collect()}
    assert (over["e1"]["collapse_score"], over["e1"]["combo_score"], over["e1"]["auc"]) == (0.5, 0.25, 0.75)
    assert (over["e2"]["collapse_score"], over["e2"]["auc"]) == (0.2, 0.0)
    strata = {(r["epoch_regime"], r["rarity_group"]): (r["n"], r["combo_score"]) for r in metrics.regime_by_stratum(df).collect()}
    assert strata == {("e1", "rare"): (1, 0.0), ("e1", "common"): (1, 0.5), ("e2", "rare"): (1, 0.2)}
    assert {r["model"] for r in metrics.relabel(df, {"A": "B"}).collect()} == {"B"} and {r["model"] for r in metrics.relabel(df, {"x": "B"}).collect()} == {"A"}


def test_clinical_codes(spark):
    df = spark.createDataFrame([("M1", "I71", 4, 2), ("M1", "A00", 3, 1), ("M1", "Q25", 0, 0)], "model string, code3 string, gt_n long, match_n long")
    assert [(r["code3"], r["label"]) for r in metrics.clinical_codes(df).collect()] == [("I71", "Aortic aneurysm / dissection")]


def test_paired_tables_common_patients_only(spark):
    rows = [("M0", "a", 1), ("M1", "a", 0), ("M2", "a", 1),
            ("M0", "b", 0), ("M1", "b", 1), ("M2", "b", 1),
            ("M0", "c", 1), ("M1", "c", 1)]                     # c lacks M2 -> excluded
    df = spark.createDataFrame(rows, "model string, patient_id string, success int")
    t = {(r["model_a"], r["model_b"]): r for r in
         metrics.paired_tables(df, [("M0", "M1")], ["M0", "M1", "M2"]).collect()}
    r = t[("M0", "M1")]
    assert (r["n_both"], r["n_only_a"], r["n_only_b"], r["n_neither"]) == (0, 1, 1, 0)
    assert r["p_value"] == 1.0


def test_codes_are_counted_in_one_pass_over_the_best_generations(spark):
    best = spark.createDataFrame([("A", ["E11.1", "E11.2", "I10"], ["E11.1", "E11.2"]), ("A", ["I10", "Q20"], []), ("B", ["I10"], ["I10"])], "model string, gt array<string>, matched array<string>")
    by_code, by_chapter = metrics.recall_by_code(best), metrics.recall_by_chapter(best)
    assert {tuple(r) for r in by_code.collect()} == {("A", "E11", 2, 2, 1.0), ("A", "I10", 2, 0, 0.0), ("A", "Q20", 1, 0, 0.0), ("B", "I10", 1, 1, 1.0)}
    assert {(r["model"], r["chapter"], r["gt_n"], r["match_n"]) for r in by_chapter.collect()} == {("A", "E", 2, 2), ("A", "I", 2, 0), ("A", "Q", 1, 0), ("B", "I", 1, 1)}
    assert {r["code3"] for r in metrics.recall_by_code(best, 2).collect()} == {"E11", "I10"}
    for df in (by_code, by_chapter):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
