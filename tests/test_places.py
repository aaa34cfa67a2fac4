"""Places where texts meet: a text goes to a place once, and no result depends on how records are dealt to places."""

import glob
import gzip

import pytest
from pyspark.sql import functions as F

from memaudit.functions import vocab
from memaudit.operators import scoring
from memaudit.plans import predictions
from memaudit.sources import writers

WORDS = ["aortic", "root", "replacement", "tevar", "i71", "e11", "none", "é", "ab"]


def said(k):
    return "" if k % 17 == 0 else f"Aortic root replacement, {WORDS[k % 9]} x{k} " + ("TEVAR elephant trunk" if k % 3 else "CABG")


def neighbours(spark, n=120):
    """Each record repeats the texts of the records after it; all share one text."""
    gens = [(m, f"r{i}", g, said(i + g)) for i in range(n) for m in "AB" for g in range(10)] + [("A", f"r{i}", 10, "I cannot help with that") for i in range(n)]
    truth = [(m, f"r{i}", said(i) if i % 2 else f"x{i}") for i in range(n) for m in "AB"]
    return (spark.createDataFrame(gens, "model string, patient_id string, gen_idx int, gen string"),
            spark.createDataFrame(truth, "model string, patient_id string, expected string"))


def scores(df):
    return {(r["model"], r["patient_id"]): pytest.approx(tuple(r[c] for c in ("collapse_score", "combo_score", "reconstruction_score", "n_generations"))) for r in df.collect()}


def test_a_text_goes_to_few_places(spark):
    gens, _ = neighbours(spark)
    ids, _ = scoring.addressed(gens.where("gen_idx < 10"))
    at = scoring.places(ids)
    assert at.count() == at.select("patient_id").distinct().count() == 120
    pairs = ids.select("patient_id", "digest").distinct()
    sent = pairs.join(at, "patient_id").select("_least", "digest").distinct()
    assert sent.count() * 2 < pairs.count()


def test_full_places_are_cut(spark):
    ids, _ = scoring.addressed(neighbours(spark)[0].where("gen_idx = 10").unionByName(neighbours(spark, 1)[0].where("model = 'B'")))
    at = {r["patient_id"]: r for r in scoring.places(ids, 5).collect()}
    assert len({r["_least"] for r in at.values()}) <= 2 and at["r7"]["_parts"] >= 24 and at["r7"]["_own"] == 1 and at["r0"]["_own"] == 3
    assert scoring.places(ids).agg(F.max("_parts")).first()[0] == 1


@pytest.mark.parametrize("most", [1, 7, scoring.PLACE_ROWS])
def test_scores_do_not_depend_on_places(spark, monkeypatch, most):
    gens, truth = neighbours(spark, 40)
    monkeypatch.setattr(scoring.places, "__defaults__", (most,))
    got = {(r["model"], r["patient_id"]): tuple(r[c] for c in ("collapse_score", "combo_score", "reconstruction_score", "n_generations")) for r in scoring.completion_scores(gens, truth).collect()}

    def norm(t):
        return " ".join("".join(c for c in t.lower() if c.isalnum() or c.isspace()).split())

    want = {(r["model"], r["patient_id"]): r["expected"] for r in truth.collect()}
    per = {}
    for r in gens.collect():
        a, b = norm(r["gen"]), norm(want[r["model"], r["patient_id"]])
        held = [{c for c in vocab.SURGERY_CONCEPTS_12 if c.lower() in t.lower()} for t in (r["gen"], want[r["model"], r["patient_id"]])]
        x, y = set(a.split()), set(b.split())
        per.setdefault((r["model"], r["patient_id"]), []).append((b in a, held[0] == held[1], len(x & y) / len(x | y) if x | y else 1.0))
    assert {k: pytest.approx((*[sum(c) / len(v) for c in zip(*v)], len(v))) for k, v in per.items()} == got


def test_two_scorers_in_one_pass(spark):
    gens, truth = neighbours(spark, 30)
    ids, texts = scoring.addressed(gens)
    few = ids.where("gen_idx < 4")
    both = scoring.completion_scores_by(ids.withColumn("scorer", F.lit(0)).unionByName(few.withColumn("scorer", F.lit(1))), truth, [(vocab.SURGERY_CONCEPTS_12, True), (vocab.SURGERY_CONCEPTS_11, False)], texts)
    for scorer, (some, concepts, empty) in enumerate([(ids, vocab.SURGERY_CONCEPTS_12, True), (few, vocab.SURGERY_CONCEPTS_11, False)]):
        got = both.where(F.col("scorer") == scorer).drop("scorer")
        alone = scoring.completion_scores(some, truth, concepts, empty, texts)
        assert got.columns == alone.columns and scores(alone) == {k: v.expected for k, v in scores(got).items()}


def test_texts_are_dealt_out_once(spark):
    gens, truth = neighbours(spark, 10)
    ids, texts = scoring.addressed(gens)
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        plan = scoring.completion_scores(ids, truth, texts=texts)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # the pairs are dealt to their places once, for both readers; each text goes there with its address
    dealt = [line for line in plan.splitlines() if "hashpartitioning(_at" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 2 and any("REPARTITION_BY_COL" in line for line in dealt), dealt


def test_lines_are_written_unsorted_with_all_texts(spark, tmpdir_path):
    cards = spark.createDataFrame([(f"row_{k}", m, f"{m} {k} said") for k in range(25) for m in ("full", "coarsened")], "patient_id string, mode string, text string")
    ids, texts = predictions.addressed_generations(cards)
    lines = ids.groupBy("model", "patient_id").agg(F.collect_list(F.struct("gen_idx", "digest")).alias("_made"))
    got = scoring.with_texts(lines, scoring.places(ids), F.col("_made.digest"), texts, lambda x: x["text"])
    got = got.select("model", "patient_id", F.explode("_made").alias("m"), "_texts").select("model", "patient_id", "m.gen_idx", F.element_at("_texts", F.col("m.digest")).alias("gen"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, predictions.generations(cards).collect()))

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    rows = spark.range(0, 40, 1, 1).select((F.col("id") % 3).alias("file"), F.col("id"))
    writers.write_jsonl(rows, tmpdir_path, partition_by=["file"], compression="gzip", open_files=3)
    assert spark.conf.get(name) == before
    held = [[line for f in glob.glob(f"{tmpdir_path}/file={k}/*.gz") for line in gzip.open(f, "rt").read().splitlines()] for k in range(3)]
    assert held == [[f'{{"id":{i}}}' for i in range(k, 40, 3)] for k in range(3)]
