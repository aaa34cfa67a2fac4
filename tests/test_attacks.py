from pyspark.sql import functions as F

from memaudit.operators import scoring


def blocks(gene="None identified", first="45 mm", interv="Unknown"):
    return (f"Genetics:\n- Pathogenic variant: {gene}\n- VUS: None identified",
            f"Aortic size:\n- First reported diameter: {first}\n- Diameter at intervention: {interv}")


def test_one_pass_equals_three(spark):
    targets = [("r1", *blocks("FBN1"), "I71.0, I10"), ("r2", *blocks(first="Unknown"), ""), ("r3", *blocks("SKI", "50 mm", "61 mm"), "I10")]
    gens = [("A", "r1", 0, "pathogenic variant: FBN1"), ("A", "r1", 1, "First reported diameter: 45 mm\nICD-10 codes: i10, I71.0"), ("B", "r1", 0, "nothing"),
            ("A", "r2", 0, "First reported diameter: 45"), ("A", "r3", 0, "first reported diameter: 50 mm, diameter at intervention: 61"),
            ("A", "r3", 1, "variant such as FBN1, SKI, TGFB2"), ("A", "unknown", 0, "x"), ("B", "r3", 0, None)]
    t = spark.createDataFrame(targets, "patient_id string, gene_block string, size_block string, target_icd10 string")
    g = spark.createDataFrame(gens, "model string, patient_id string, gen_idx int, gen string")
    columns = ["attack", "model", "patient_id", "target", "success"]
    want = set()
    models = t.select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("model"), "*")
    for attack, block in (("gene", "gene_block"), ("size", "size_block"), ("icd10", "gene_block")):
        one = scoring.attack_success(g, models.withColumn("target_text", F.col(block)), attack)
        want |= {tuple(r) for r in one.withColumn("attack", F.lit(attack)).select(columns).collect()}
    got = [tuple(r) for r in scoring.attack_success_all(g, t).select(columns).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("gene", "A", "r1", "fbn1", 1) in want and ("icd10", "A", "r1", "i10, i71.0", 1) in want


def test_unknown_patients(spark):
    g = spark.createDataFrame([("A", "r1"), ("A", "r1"), ("A", "r9"), ("B", "r9")], "model string, patient_id string")
    got = {tuple(r) for r in scoring.unknown_patients(g, spark.createDataFrame([("r1",), ("r1",)], "patient_id string")).collect()}
    assert got == {("A", 2, 1, 1), ("B", 0, 1, 1)}
