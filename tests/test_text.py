from pyspark.sql import functions as F

from memaudit.functions import text as T
from tests.conftest import one


def test_normalize_unicode(spark):
    assert one(spark, T.normalize(F.col("x")), "Café, naïve!  Test") == "café naïve test"


def test_jaccard(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("", ""), ("a", "")], "p string, q string")
    r = df.select(T.jaccard(T.token_set(T.normalize("p")), T.token_set(T.normalize("q"))).alias("j"),
                  T.jaccard(T.token_set(T.normalize("q")), T.token_set(T.normalize("p"))).alias("k")).collect()
    assert [x["j"] for x in r] == [0.5, 1.0, 0.0]
    assert [x["j"] for x in r] == [x["k"] for x in r]                 # symmetric


def test_collapse_and_concepts(spark):
    df = spark.createDataFrame([("TEVAR done; aortic root repair.", "")], "g string, e string")
    r = df.select(T.collapse_hit(T.normalize("g"), T.normalize("e")).alias("hit"),
                  T.collapse_hit(T.normalize("g"), T.normalize("e"), empty_is_hit=False).alias("strict"),
                  T.concept_set("g").alias("c")).first()
    assert r["hit"] is True and r["strict"] is False
    assert r["c"] == ["Aortic root repair", "TEVAR"]


def test_gene_target_and_matches(spark):
    block = "Genetics:\n- Pathogenic variant: FBN1\n- VUS: None identified"
    assert one(spark, T.gene_target(F.col("x")), block) == "fbn1"
    assert one(spark, T.gene_target(F.col("x")), "Genetics:\n- Pathogenic variant: Present\n- VUS: TGFBR2") == "tgfbr2"
    df = spark.createDataFrame([
        ("pathogenic variant: fbn1 was found", True),
        ("genes such as fbn1, tgfbr1, tgfbr2, smad3 variant", False),   # list mention: guarded out
        ("nothing here", False)], "g string, want boolean")
    got = df.select(T.gene_guarded(F.col("g"), F.lit("fbn1")).alias("hit"), "want").collect()
    assert [r["hit"] for r in got] == [r["want"] for r in got]


def test_size_matches(spark):
    v = T.size_values(F.lit("Aortic size:\n- First reported diameter: 45 mm\n- Diameter at intervention: Unknown"))
    df = spark.createDataFrame([("first reported diameter: 450 mm",), ("first reported diameter: 44 mm",)], "g string")
    r = df.select(T.size_strict(F.col("g"), v).alias("s")).collect()
    assert [x["s"] for x in r] == [True, False]                       # 45 prefix-matches 450 (as audited)
    loose = df.select(T.size_loose(F.col("g"), T.size_targets(v)).alias("l")).collect()
    assert [x["l"] for x in loose] == [True, False]


def test_codes(spark):
    assert sorted(one(spark, T.extract_codes(F.col("x")), "Dx: S72.001A, i71.2 and E11; X1")) == ["E11", "I71.2", "S72"]
    df = spark.createDataFrame([(["I71.01", "I71.2", "E11"], ["I71.9"])], "gt array<string>, gen array<string>")
    m = df.select(T.prefix_match("gt", "gen").alias("m")).first()["m"]
    assert m["recall"] == 2 / 3 and m["precision"] == 2.0               # precision can exceed 1
    assert one(spark, T.exact_code_match(F.col("x"), F.array(F.lit("e11"), F.lit("i71.2"))),
               "icd-10 codes: I71.2, e11") is True
