import json
import os

import pytest

from pyspark.sql import functions as F

from memaudit.sources import readers, writers


def test_cp1252_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cohort.csv")
    with open(p, "wb") as f:
        f.write("Sex,Note\nM,".encode("ascii") + b"\x93quoted\x94 \x96 dash\n" + b'F,"multi\nline"\n')
    df = readers.read_cohort_csv(spark, p)
    rows = df.collect()
    assert rows[0]["Note"] == "“quoted” – dash"
    assert rows[1]["Note"] == "multi\nline"


def test_cards_roundtrip_and_last_wins(spark, tmpdir_path):
    meta = {"patient_id": "row_1", "mode": "full", "sex": None, "pathogenic_gene": None, "vus_gene": None,
            "underwent_reoperation": 0, "mortality": 0, "icd10_codes": None}
    p = os.path.join(tmpdir_path, "cards_full.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"meta": meta, "text": "old"}) + "\n")
        f.write(json.dumps({"meta": meta, "text": "new"}) + "\n")
    df = readers.read_cards(spark, p).select(F.col("meta.patient_id").alias("patient_id"), "text", "_order")
    assert readers.last_wins(df, ["patient_id"]).first()["text"] == "new"
    out = os.path.join(tmpdir_path, "out")
    writers.write_cards(readers.read_cards(spark, p).drop("_file", "_order"), out)
    line = open([os.path.join(r, f) for r, _, fs in os.walk(out) for f in fs if f.endswith(".json")][0]).readline()
    assert '"sex":null' in line                          # explicit nulls kept


def test_append_pending_resume(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "preds")
    a = spark.createDataFrame([("p1", 1), ("p2", 2)], "prompt_id string, v int")
    writers.append_pending(a, out)
    b = spark.createDataFrame([("p2", 9), ("p3", 3)], "prompt_id string, v int")
    writers.append_pending(b, out)
    got = sorted((r["prompt_id"], r["v"]) for r in spark.read.json(out).collect())
    assert got == [("p1", 1), ("p2", 2), ("p3", 3)]


def test_malformed_prediction_lines_fail_and_can_be_listed(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "M1_gene_predictions.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"patient_id": "a", "generations": ["x"]}) + "\n{broken\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readers.read_predictions(spark, p).collect()
    assert [r["line"] for r in readers.malformed_lines(spark, p).collect()] == ["{broken"]


def test_unreadable_output_is_an_error_not_an_empty_one(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "preds")
    os.makedirs(out)
    with open(os.path.join(out, "part-0.json"), "w") as f:
        f.write("{broken\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        writers.append_pending(spark.createDataFrame([("p1", 1)], "prompt_id string, v int"), out)


def test_row_ids_in_read_order(spark):
    df = spark.range(0, 100, numPartitions=4).withColumnRenamed("id", "x")
    ids = {r["x"]: r["patient_id"] for r in readers.with_row_ids(df).collect()}
    assert all(ids[i] == f"row_{i}" for i in range(100))


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture()
def splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: small_splits(spark, size)
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_file_row_ids_do_not_depend_on_the_splits(spark, tmpdir_path, splits):
    want = []
    for name in ("b", "a", "c"):
        values = [f"{name}{i}" for i in range(50)]
        with open(os.path.join(tmpdir_path, name + ".txt"), "w") as f:
            f.write("".join(v + "\n" for v in values))
        want.append((name, values))
    order = [v for _, values in sorted(want) for v in values]
    for size in (10, 64, 1 << 20):
        splits(size)
        got = {r["patient_id"]: r["value"] for r in readers.with_file_row_ids(spark.read.text(tmpdir_path)).collect()}
        assert got == {f"row_{i}": v for i, v in enumerate(order)}


def test_last_line_wins_across_files_and_splits(spark, tmpdir_path, splits):
    def line(pid, text):
        return json.dumps({"meta": {"patient_id": pid, "mode": "full"}, "text": text}) + "\n"

    for name, texts in (("cards_full_2.jsonl", "new"), ("cards_full_1.jsonl", "old")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write("".join(line(f"row_{i % 5}", f"{texts} {i}") for i in range(40)))
    for size in (60, 300, 1 << 20):
        splits(size)
        df = readers.read_cards(spark, tmpdir_path).select(F.col("meta.patient_id").alias("patient_id"), "text", "_order")
        assert {tuple(r) for r in readers.last_wins(df, ["patient_id"]).select("patient_id", "text").collect()} == {(f"row_{i % 5}", f"new {i}") for i in range(35, 40)}


ROWS = "prompt_id string, v int"


def appended(spark, out):
    return sorted((tuple(r) for r in writers.read_appended(spark, out, spark.createDataFrame([], ROWS).schema).collect()), key=str)


def test_a_killed_append_is_not_seen(spark, tmpdir_path):
    from memaudit.sources import resume
    out = os.path.join(tmpdir_path, "preds")
    writers.append_pending(spark.createDataFrame([("p1", 1)], ROWS), out)
    # killed after its rows were written, before its manifest
    spark.createDataFrame([("p2", 2)], ROWS).write.json(f"{out}/append=dead")
    assert appended(spark, out) == [("p1", 1)]
    writers.append_pending(spark.createDataFrame([("p1", 9), ("p2", 3)], ROWS), out)
    assert appended(spark, out) == [("p1", 1), ("p2", 3)] and not os.path.exists(f"{out}/append=dead")
    assert len(resume.manifest(spark, out)) == 2


def test_resume_reads_only_the_buckets_it_asks_about(spark, tmpdir_path):
    from memaudit.sources import resume
    out = os.path.join(tmpdir_path, "preds")

    def rows(a, b):
        return spark.range(a, b).selectExpr("concat('p', id) AS prompt_id", "1 AS v")

    def asked(df):
        entries = resume.manifest(spark, out)
        buckets = {r["b"] for r in df.select(resume.bucket_of(F.col("prompt_id"), 16).alias("b")).distinct().collect()}
        files = [os.path.join(p, f) for p in resume.index_paths(entries, out, buckets) for f in os.listdir(p) if f.endswith(".parquet")]
        return len(files), sum(spark.read.parquet(f).count() for f in files)

    few = rows(0, 1)
    writers.append_pending(rows(0, 200), out, buckets=16)
    first = asked(few)
    writers.append_pending(rows(100, 400), out, buckets=16)
    assert len(appended(spark, out)) == 400 and resume.pending(few, out).count() == 0
    n_files, n_keys = asked(few)
    assert n_files == first[0] + 1 and n_keys < 400 / 16 * 3
    # appends that hold none of the asked buckets are not read at all
    other = spark.range(400, 600).selectExpr("concat('p', id) AS prompt_id", "1 AS v")
    mine = few.select(resume.bucket_of(F.col("prompt_id"), 16).alias("b")).first()["b"]
    writers.append_pending(other.where(resume.bucket_of(F.col("prompt_id"), 16) != mine), out)
    assert asked(few) == (n_files, n_keys)


def test_outputs_without_an_index_are_indexed_once(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "preds")
    spark.createDataFrame([("p1", 1)], ROWS).write.json(out)
    for _ in range(2):
        writers.append_pending(spark.createDataFrame([("p1", 5), ("p2", 2), (None, 7)], ROWS), out)
    assert appended(spark, out) == sorted([("p1", 1), ("p2", 2), (None, 7), (None, 7)], key=str)


def test_markdown_lines_are_ordered_and_keep_their_cells(spark):
    df = spark.createDataFrame([(2, "a|b", None), (1, "two\nlines", 0.5)], "id int, t string, x double")
    got = [r["line"] for r in writers.markdown_lines(df, ["id", "t", "x"], [F.col("id")]).orderBy("line_no").collect()]
    assert got == ["| id | t | x |", "|---|---|---|", "| 1 | two<br>lines | 0.5 |", "| 2 | a\\|b |  |"]
