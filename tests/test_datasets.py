from pyspark.sql import functions as F

from memaudit.functions import vocab
from memaudit.operators import datasets, scoring


def test_canary_injection_counts(spark):
    base = spark.createDataFrame([("a",), ("b",), ("c",)], "patient_id string")
    canary = spark.createDataFrame([("k",)], "patient_id string")
    out = datasets.canary_injection(base, canary)
    got = {r["injection_count"]: r["n"] for r in out.groupBy("injection_count").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {n: 3 + n for n in vocab.CANARY_LEVELS}              # level N = base + N copies


def test_pending_is_anti_join(spark):
    prompts = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "prompt_id string")
    done = spark.createDataFrame([("p2",), ("p2",)], "prompt_id string")
    assert sorted(r["prompt_id"] for r in datasets.pending(prompts, done).collect()) == ["p1", "p3"]


def test_with_split_defaults_unknown(spark):
    df = spark.createDataFrame([("a",), ("z",)], "patient_id string")
    sp = spark.createDataFrame([("a", "train", "rare")], "patient_id string, split string, rarity_group string")
    got = {r["patient_id"]: (r["split"], r["rarity_group"]) for r in datasets.with_split(df, sp).collect()}
    assert got == {"a": ("train", "rare"), "z": ("unknown", "unknown")}


def test_attack_prompt_withholds_target(spark):
    card = ("Patient Summary\n\nDemographics:\n- Sex: F\n\nGenetics:\n- Pathogenic variant: ACTA2\n- VUS: None identified"
            "\n\nClinical presentation:\n- Aneurysm involvement: Root\n\nSurgical course:\n- Number of aortic surgeries recorded: 0"
            "\n\nAortic size:\n- First reported diameter: 48 mm\n- Diameter at intervention: Unknown")
    cards = spark.createDataFrame([("row_1", card, "I71.2")], "patient_id string, text string, icd10_codes string")
    sp = spark.createDataFrame([("row_1", "train", "common")], "patient_id string, split string, rarity_group string")
    gene = datasets.attack_prompts(cards, sp, "gene").first()
    assert gene["target_text"].startswith("Genetics:") and "ACTA2" not in gene["prompt_text"]
    assert gene["prompt_text"].endswith(vocab.ATTACK_QUESTIONS["gene"])
    size = datasets.attack_prompts(cards, sp, "size")
    assert datasets.leak_check(size).count() == 0 and "ACTA2" in size.first()["prompt_text"]


def test_canary_sets_and_target(spark):
    base = spark.createDataFrame([("p1", "u1", "a1"), ("p2", "u2", "a2")], "patient_id string, user_content string, assistant_content string")
    sets = datasets.canary_injection(base, datasets.canary_record(spark), (0, 1, 3))
    ordered = datasets.seeded_order(sets, "injection_count", "patient_id", "copy").collect()
    count = {n: sum(r["injection_count"] == n for r in ordered) for n in (0, 1, 3)}
    assert count == {0: 2, 1: 3, 3: 5}
    again = datasets.seeded_order(sets.repartition(3), "injection_count", "patient_id", "copy").collect()
    assert ordered == again and [r["patient_id"] for r in ordered] != sorted(r["patient_id"] for r in ordered)
    target = datasets.canary_target(spark)
    said = target.select(F.lit(3).alias("injection_count"), "patient_id", F.col("full_completion").alias("gen"))
    hit = scoring.canary_rates(said, target).first()
    assert (hit["size_both_rate"], hit["gene_recall_rate"], hit["joint_rate"]) == (1.0, 1.0, 1.0)
    prompt = datasets.canary_eval_prompt(spark).first()
    assert (prompt["prompt_id"], prompt["split"]) == ("canary_patient_001_eval", "canary")
    assert "46.3" not in prompt["prompt_text"] and "51.8" not in prompt["prompt_text"]
