"""Generations as addresses: targets travel to the texts, and the results are those of generations that hold their texts."""

from pyspark.sql import functions as F

from memaudit.operators import scoring
from memaudit.plans import predictions

BLOCKS = [("- Pathogenic variant: FBN1\n- VUS: None identified", "- First reported diameter: 45 mm\n- Diameter at intervention: Unknown"),
          ("- Pathogenic variant: None identified\n- VUS: SKI", "- First reported diameter: 50.5 mm\n- Diameter at intervention: 61 mm"), ("", "")]
SAID = ["Pathogenic variant: FBN1, first reported diameter: 45 mm", "VUS: SKI\nDiameter at intervention: 61 mm", "61", "none identified", "", None]


def stated(spark):
    gens = [(m, f"r{i}", g, SAID[(i + g * len(m)) % len(SAID)]) for m in ("A", "BB") for i in range(30) for g in range(i % 4)]
    targets = [(m, f"r{i}", *BLOCKS[i % 3]) for m in ("A", "BB") for i in range(30)]
    return (spark.createDataFrame(gens, "model string, patient_id string, gen_idx int, gen string"),
            spark.createDataFrame(targets, "model string, patient_id string, gene_block string, size_block string"))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_scores_of_addressed_generations_equal_those_of_texts(spark):
    gens, targets = stated(spark)
    ids, texts = scoring.addressed(gens)
    columns = ["attack", "model", "patient_id", "target_text", "exact_match_score"]
    want = [scoring.attack_scores(gens, targets.withColumn("target_text", F.col(b)), a).withColumn("attack", F.lit(a)).select(columns) for a, b in (("gene", "gene_block"), ("size", "size_block"))]
    got = scoring.attack_scores_all(ids, targets, texts).select(columns)
    assert rows(got) == rows(want[0].union(want[1])) == rows(scoring.attack_scores_all(gens, targets).select(columns))
    assert got.where("exact_match_score > 0").count() > 10


def test_successes_of_addressed_generations_equal_those_of_texts(spark):
    gens, targets = stated(spark)
    ids, texts = scoring.addressed(gens)
    for attack, block, typed in (("gene", "gene_block", True), ("gene", "gene_block", False), ("size", "size_block", False)):
        t = targets.withColumn("target_text", F.col(block))
        got = scoring.attack_success(ids, t, attack, typed, texts=texts)
        assert rows(got) == rows(scoring.attack_success(gens, t, attack, typed)) and got.where("success = 1").count() > 3


def test_the_best_generation_is_ranked_without_a_sort_of_its_codes(spark):
    gens = spark.createDataFrame([("A", "r1", 0, "x I71.2"), ("A", "r1", 1, "E11 I10 Z99"), ("A", "r1", 2, "E11 I10"), ("A", "r2", 0, "nothing"), ("A", "r3", 0, "I10")],
                                 "model string, patient_id string, gen_idx int, gen string")
    codes = spark.createDataFrame([("A", "r1", "I71.0, I71.9, E11.1, I10, Q20"), ("A", "r2", "I10"), ("A", "r3", "")], "model string, patient_id string, target_icd10 string")
    got = scoring.best_code_recall(gens, codes)
    found = {r["patient_id"]: r.asDict() for r in got.collect()}
    assert set(found) == {"r1", "r2"}
    one = found["r1"]  # two codes each: the first wins
    assert (one["matched"], one["recall"], one["precision"], one["union_recall"]) == (["I71.0", "I71.9"], 0.4, 2.0, 0.8)
    assert (found["r2"]["matched"], found["r2"]["recall"], found["r2"]["precision"], found["r2"]["f1"], found["r2"]["union_recall"]) == ([], 0.0, 0.0, 0.0, 0.0)
    by_code = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in line and "_code" in line.split("functions")[0]]
    assert by_code and all("HashAggregate" in line and "Sort" not in line for line in by_code)


def test_cards_go_to_the_records_that_ask_for_them(spark):
    ids = [0, 1, 2, 3, 7, 11, 11, 12, 30]
    cards = spark.createDataFrame([(f"row_{k}", m, f"{m} {k}") for k in ids for m in ("full", "coarsened", "exact")] + [(None, "full", "x")], "patient_id string, mode string, text string")
    for repeat in (1, 2):
        got, texts = predictions.addressed_generations(cards, repeat)
        back = got.join(texts, "digest").select("model", "patient_id", "gen_idx", "text")
        assert rows(back) == rows(predictions.generations(cards, repeat))
        assert dict(got.dtypes)["digest"] == "binary"


def test_generations_meet_their_targets_where_they_lie(spark):
    cards = spark.createDataFrame([(f"row_{k}", m, f"{m} {k} variant: ski") for k in range(40) for m in ("full", "coarsened", "exact")], "patient_id string, mode string, text string")
    targets = spark.createDataFrame([(f"row_{k}", "- Pathogenic variant: " + ("SKI" if k % 2 else "MFAP5")) for k in range(30)], "patient_id string, target_text string")
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        ids, texts = predictions.addressed_generations(cards)
        got = scoring.attack_success(ids, targets, "gene", typed=True, texts=texts)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # records, cards and targets by patient_id; the pairs and the texts by address; the result
        assert plan.count("Exchange hashpartitioning") == 6 and plan.count("Exchange hashpartitioning(patient_id") == 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    models = spark.createDataFrame([(m,) for m in predictions.MODEL_NAMES], "model string")
    assert rows(got) == rows(scoring.attack_success(ids, targets.crossJoin(models), "gene", typed=True, texts=texts))
    assert got.where("success = 1").count() == 45


def test_targets_of_one_record_that_comes_twice_stay_apart(spark):
    gens = spark.createDataFrame([("A", "r1", 0, "variant: ski"), ("A", "r2", 0, "icd-10 codes: i10")], "model string, patient_id string, gen_idx int, gen string")
    t = spark.createDataFrame([("r1", "- Pathogenic variant: SKI", "", ""), ("r1", "- VUS: FBN1", "", ""), ("r1", "", "", "SKI"), ("r2", "", "", "I10")],
                              "patient_id string, gene_block string, size_block string, target_icd10 string")
    got = scoring.attack_success_all(gens, t).where("attack <> 'size'").select("attack", "patient_id", "target", "success")
    assert rows(got) == sorted(map(repr, [("gene", "r1", "ski", 1), ("gene", "r1", "fbn1", 0), ("icd10", "r1", "ski", 0), ("icd10", "r2", "i10", 1)]))


def test_texts_are_dealt_out_unsorted(spark):
    cards = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "patient_id string, text string")
    ids, texts = scoring.addressed(cards, "text", ("patient_id",))
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # and what is above it stands before it in the plan
    below = plan[plan.index("Exchange"):]
    assert "Aggregate" not in below and "Sort" not in below
    assert sorted(map(str, (r["text"] for r in texts.collect()))) == ["None", "x", "y"]
    assert rows(ids.join(texts, "digest").select("patient_id", "text")) == rows(cards)


def test_success_scores_no_profiles(spark, monkeypatch):
    from memaudit.plans import predictions, q_significance

    def never(*_, **__):
        raise AssertionError("no split is read")

    monkeypatch.setattr(predictions.rarity, "splits_table", never)
    got = q_significance.q_attack_success(spark, "/root/testdata/sf0.001")
    assert got.columns == ["attack", "model", "patient_id", "target", "success"]


def test_categories_travel_as_numbers_once_for_a_record(spark):
    many = [f"{a}{n:02d}.{n % 10}" for a in "IQZ" for n in range(0, 100, 2)] + ["I00.7", "250.1", "x", "A١٢"]  # 150 categories of two codes or one, and odd ones
    gens = [("A", "r1", 0, "nothing"), ("A", "r1", 3, " ".join(many[100:140])), ("A", "r1", 2, "i98 q00 q02 250.1"), ("A", "r1", 1, " ".join(c[:3] for c in many[:40])), ("B", "r1", 5, "seen a١٢.3"),
            ("B", "r1", 6, "i00"), ("B", "r1", 4, "i00"), ("C", "r1", 0, "I00"), ("A", "r2", 0, "I10 I10.1 i11"), (None, "r1", 0, "I00"), ("A", None, 0, "I00")]
    g = spark.createDataFrame(gens, "model string, patient_id string, gen_idx int, gen string")
    t = spark.createDataFrame([(m, "r1", ", ".join(many)) for m in "AB"] + [("A", "r2", "I10, I10.9"), ("B", "r3", "I10")], "model string, patient_id string, target_icd10 string")
    got = {(r["model"], r["patient_id"]): r.asDict() for r in scoring.best_code_recall(g, t).collect()}
    assert set(got) == {("A", "r1"), ("B", "r1"), ("A", "r2")}

    def expect(codes, said, n, union):
        matched = [c for c in sorted(c.upper() for c in codes) if c.split(".")[0] in said]
        return {"matched": matched, "recall": len(matched) / len(codes), "precision": len(matched) / n, "union_recall": len([c for c in codes if c.upper().split(".")[0] in union]) / len(codes)}

    first, third = {c[:3] for c in many[:40]}, {c[:3] for c in many[100:140]}
    assert expect(many, first, 40, first | third | {"I98", "Q00", "Q02"}).items() <= got["A", "r1"].items()
    assert expect(many, {"I00"}, 1, {"I00", "A١٢"}).items() <= got["B", "r1"].items()
    assert expect(["I10", "I10.9"], {"I10"}, 3, {"I10"}).items() <= got["A", "r2"].items()

    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        plan = scoring.best_code_recall(*scoring.addressed(g)[:1], t, scoring.addressed(g)[1])._jdf.queryExecution().executedPlan()
        assert "Exchange hashpartitioning(patient_id" in plan.toString() and "Exchange hashpartitioning(model" not in plan.toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
