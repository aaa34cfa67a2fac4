"""Content-addressed features: scores do not depend on whether texts are repeated, and each distinct text is read once."""

import random

import pytest
from pyspark.sql import functions as F

from memaudit.operators import scoring

WORDS = ["Aortic", "root", "replacement", "TEVAR", "aorta,", "I71.2", "E11", "None", "é!", "a-b"]


def tables(spark, n=60):
    rng = random.Random(4)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))) for _ in range(12)] + ["", "  \n", None]
    gens = [(m, f"r{i}", g, rng.choice(pool)) for m in "AB" for i in range(n) for g in range(rng.randint(0, 5))]
    truth = [(m, f"r{i}", rng.choice(pool)) for m in "AB" for i in range(n)]
    return (spark.createDataFrame(gens, "model string, patient_id string, gen_idx int, gen string"),
            spark.createDataFrame(truth, "model string, patient_id string, expected string"))


@pytest.mark.parametrize("empty_is_hit", [True, False])
def test_addressed_scores_equal_plain_ones(spark, empty_is_hit):
    gens, truth = tables(spark)
    ids, texts = scoring.addressed(gens)
    got = {(r["model"], r["patient_id"]): r[2:] for r in scoring.completion_scores(ids, truth, texts=texts, empty_is_hit=empty_is_hit).collect()}
    assert got == {(r["model"], r["patient_id"]): r[2:] for r in scoring.completion_scores(gens, truth, empty_is_hit=empty_is_hit).collect()}

    def norm(t):
        return " ".join("".join(c for c in (t or "").lower() if c.isalnum() or c.isspace() or c == "_").split())

    want = {(r["model"], r["patient_id"]): norm(r["expected"]) for r in truth.collect()}
    per = {}
    for r in gens.collect():
        key = (r["model"], r["patient_id"])
        a, b = norm(r["gen"]), want[key]
        sa, sb = set(a.split()), set(b.split())
        jac = 1.0 if not sa and not sb else len(sa & sb) / len(sa | sb)
        per.setdefault(key, []).append((float(b in a and (empty_is_hit or b != "")), jac))
    assert set(per) == set(got)
    for key, pairs in per.items():
        assert got[key][0] == pytest.approx(sum(p[0] for p in pairs) / len(pairs)) and got[key][2] == pytest.approx(sum(p[1] for p in pairs) / len(pairs))
        assert got[key][3] == len(pairs)


def test_each_distinct_text_has_one_row_of_features(spark):
    gens, _ = tables(spark)
    ids, texts = scoring.addressed(gens)
    distinct = {r["gen"] or "" for r in gens.select("gen").collect()}
    assert texts.count() == len(distinct) and scoring.text_features(texts).count() == len(distinct)
    assert ids.count() == gens.count() and ids.columns == ["model", "patient_id", "gen_idx", "digest"]
    back = ids.join(texts, "digest").select("model", "patient_id", "gen_idx", F.coalesce("text", F.lit("")).alias("gen"))
    assert sorted(map(tuple, back.collect())) == sorted((*r[:3], r[3] or "") for r in gens.collect())


def test_addressed_code_recall_and_attacks_equal_plain_ones(spark):
    gens, truth = tables(spark)
    ids, texts = scoring.addressed(gens)
    codes = truth.select("model", "patient_id", F.when(F.col("expected").contains("E11"), "E11, I71.9").otherwise("I71.2, i10").alias("target_icd10"))
    assert sorted(map(tuple, scoring.best_code_recall(ids, codes, texts).collect())) == sorted(map(tuple, scoring.best_code_recall(gens, codes).collect()))
    targets = codes.where("model = 'A'").select("patient_id", F.lit("- Pathogenic variant: TEVAR").alias("gene_block"), F.lit("- First reported diameter: 45 mm").alias("size_block"), "target_icd10")
    assert sorted(map(tuple, scoring.attack_success_all(ids, targets, texts).collect())) == sorted(map(tuple, scoring.attack_success_all(gens, targets).collect()))


def test_scores_of_empty_tables(spark):
    gens, truth = tables(spark, 2)
    assert scoring.completion_scores(gens.limit(0), truth).count() == 0 and scoring.completion_scores(gens, truth.limit(0)).count() == 0


def test_a_pair_takes_one_text_along_and_no_tokens(spark):
    gens, truth = tables(spark)
    ids, texts = scoring.addressed(gens)
    got = scoring.completion_scores(ids, truth, texts=texts)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" not in plan and plan.count("array_intersect") == 1
    twice = truth.union(truth)  # a record that comes twice weighs twice
    again = {(r["model"], r["patient_id"]): r[2:] for r in scoring.completion_scores(ids, twice, texts=texts).collect()}
    once = {(r["model"], r["patient_id"]): r[2:] for r in got.collect()}
    assert set(again) == set(once)
    for key, scores in once.items():
        assert again[key] == pytest.approx((*scores[:3], 2 * scores[3]))
