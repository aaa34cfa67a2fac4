import json
import os

from memaudit.streaming import incremental


def _write(folder, name, rows):
    with open(os.path.join(folder, name), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_incremental_scoring_resumes(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    truth = spark.createDataFrame([("M1", "a", "aortic root repair done"), ("M1", "b", "tevar")],
                                  "model string, patient_id string, expected string")
    _write(src, "M1_predictions_000.jsonl", [{"patient_id": "a", "generations": ["Aortic root repair done.", "x"]}])
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    incremental.start_completion_scoring(spark, src, truth, out, ck).awaitTermination()
    _write(src, "M1_predictions_001.jsonl", [{"patient_id": "b", "generations": ["TEVAR"]}])
    incremental.start_completion_scoring(spark, src, truth, out, ck).awaitTermination()
    rows = {r["patient_id"]: r for r in incremental.latest_scores(spark, out).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["collapse_score"] == 0.5 and rows["b"]["collapse_score"] == 1.0
    assert spark.read.parquet(out).count() == 2          # the first file was not scored again
    # the same record in a later file adds to its score; another attack's file does not
    _write(src, "M1_predictions_002.jsonl", [{"patient_id": "b", "generations": ["no", "no", "tevar"]}])
    _write(src, "M1_gene_predictions_003.jsonl", [{"patient_id": "b", "generations": ["fbn1"]}])
    incremental.start_completion_scoring(spark, src, truth, out, ck).awaitTermination()
    rows = {(r["attack"], r["patient_id"]): r for r in incremental.latest_scores(spark, out).collect()}
    assert rows["", "b"]["collapse_score"] == 0.5 and rows["", "b"]["n_generations"] == 4
    assert rows["gene", "b"]["collapse_score"] == 0.0 and rows["", "a"]["collapse_score"] == 0.5
