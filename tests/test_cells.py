from pyspark.sql import functions as F

from memaudit.functions import cells, vocab
from tests.conftest import one


def test_to_int_list(spark):
    x = F.col("x")
    assert one(spark, cells.to_int_list(x), None) == []
    assert one(spark, cells.to_int_list(x), "\xa0") == []
    assert one(spark, cells.to_int_list(x), "1, 2") == [1, 2]
    assert one(spark, cells.to_int_list(x), "4 (atrial fibrillation)") == [4]
    assert one(spark, cells.to_int_list(x), "1.0") == [1]          # T4: numeric literal -> trunc
    assert one(spark, cells.to_int_list(x), "45d") == [45]          # T9: not a numeric literal


def test_bool01(spark):
    x = F.col("x")
    for v, want in [("1", 1), ("1.0", 1), ("yes", 1), (" Y ", 1), ("TRUE", 1), ("0", 0), (None, 0),
                    ("2", 0), ("no", 0), ("NA", 0)]:
        assert one(spark, cells.bool01(x), v) == want, v


def test_normalize_na_and_strip(spark):
    x = F.col("x")
    assert one(spark, cells.normalize_na(x), "NA") is None           # T2
    assert one(spark, cells.normalize_na(x), " n/a") == " n/a"
    assert one(spark, cells.py_strip(x), "\xa0 ab 　") == "ab"   # T5: NBSP stripped


def test_buckets(spark):
    x = F.col("x")
    assert one(spark, cells.age_bucket(x), 45.25, "x double") == "40–49"
    assert one(spark, cells.age_bucket(x), 9.99, "x double") == "0–9"
    assert one(spark, cells.age_bucket(x), None, "x double") == "Unknown"
    for v, want in [(49.9, "<50 mm"), (50.0, "50–59 mm"), (59.9, "50–59 mm"), (60.0, "≥60 mm"), (None, "Unknown")]:
        assert one(spark, cells.diameter_bucket(x), v, "x double") == want


def test_clean_free_text(spark):
    x = F.col("x")
    assert one(spark, cells.clean_free_text(x), "  n/a ") == ""
    assert one(spark, cells.clean_free_text(x), "seen 2020-01-02 and 1/2/2020, MRN 1234567") == \
        "seen [DATE] and [DATE], MRN [ID]"
    assert one(spark, cells.clean_free_text(x), "a\n\t b") == "a b"


def test_map_multi_and_labels(spark):
    x = F.col("x")
    assert one(spark, cells.map_multi(x, vocab.ANEURYSM_INVOLVEMENT), "1, 2, 1, 9") == \
        ["Root", "Ascending", "Unknown(9)"]
    assert one(spark, cells.first_code_label(x, vocab.CAUSE_OF_DEATH), "3") == "Unknown"
    assert one(spark, cells.first_code_label(x, vocab.CAUSE_OF_DEATH), None) == ""


def test_codes_and_lists(spark):
    x = F.col("x")
    assert one(spark, cells.comma_list(x), "I71.01, , I35.0") == ["I71.01", "I35.0"]
    assert one(spark, cells.coarsen_codes(cells.comma_list(x)), "I71.01, I71.2, E11") == ["I71", "E11"]


def test_formats(spark):
    x = F.col("x")
    assert one(spark, cells.format_diameter(x), 44.5, "x double") == "44 mm"   # half-to-even like Python
    assert one(spark, cells.format_diameter(x), 45.5, "x double") == "46 mm"
    assert one(spark, cells.format_age(x, "exact"), 45.0, "x double") == "45.0"
    assert one(spark, cells.format_age(x, "full"), 45.9, "x double") == "45"


def test_dates_and_ages(spark):
    df = spark.createDataFrame([("1/2/45", "2020-01-02"), ("1/2/69", "2020-01-02"), ("1950-06-01", "garbage"),
                                ("2021-01-01", "2020-01-01"), ("03/15/1960", "2000-03-14 10:00:00")], "b string, e string")
    out = df.select(F.year(cells.parse_date_multi("b")).alias("y"),
                    cells.age_at_event(cells.parse_date_multi("b"), cells.parse_date_multi("e")).alias("age")).collect()
    assert [r["y"] for r in out] == [2045, 1969, 1950, 2021, 1960]   # T6: pivot at 69 like Python
    assert [r["age"] for r in out] == [None, 50, None, None, 39]


def test_over_long_codes_are_unknown_labels(spark):
    f = cells.map_multi(F.col("x"), {1: "one"})
    assert one(spark, f, "1, 3000000000") == ["one", "Unknown(3000000000)"]
    assert one(spark, f, "a 12345678901234567890 b") == ["Unknown(12345678901234567890)"]
    assert one(spark, f, "3000000000") == ["Unknown(3000000000)"]
    assert one(spark, cells.first_code_label(F.col("x"), {1: "one"}), "9999999999") == "Unknown"
    assert one(spark, cells.known_labels([F.col("x")], {1: "one"}), "99999999999 and 1") == ["one"]


def test_building_a_query_runs_no_shuffle(spark):
    import os

    from memaudit.plans.q_rarity import typed_records
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        return
    spark.sparkContext.setJobGroup("build", "build")
    typed_records(spark, sf)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    assert len(stages) == len(jobs)  # footers are read in one stage each; a shuffle would take two
