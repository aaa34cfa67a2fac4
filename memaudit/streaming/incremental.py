"""Incremental scoring with Structured Streaming (the K7 append + resume behaviour).

Prediction files arrive in a folder over time (one file per model/attack/batch).
The file source's checkpoint records which files were consumed, so a restarted
query resumes exactly where it stopped — the streaming form of "skip prompts
already in the output". Each micro-batch is scored with the same batch
operators; what is kept per (batch, model, attack, patient) are the sums and counts of the scores,
in one folder per batch id that a replayed batch overwrites. Reading adds the batches up, so a
record whose generations arrive in several files is scored over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memaudit.operators import scoring
from memaudit.sources.readers import PREDICTION


SCORES = ["collapse_score", "combo_score", "reconstruction_score"]


def prediction_stream(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """Streaming scan of prediction JSONL files with model/attack parsed from the name."""
    df = (spark.readStream.schema(PREDICTION).option("maxFilesPerTrigger", max_files)
          .option("mode", "FAILFAST").json(folder))
    name = F.col("_metadata.file_path")
    pat = r"([^/]+?)_(gene|size|icd10)?_?predictions[^/]*\.jsonl$"
    return df.withColumn("model", F.regexp_extract(name, pat, 1)).withColumn(
        "attack", F.nullif(F.regexp_extract(name, pat, 2), F.lit("")))


def start_completion_scoring(spark: SparkSession, folder: str, truth: DataFrame, out_path: str,
                             checkpoint: str, trigger_once: bool = True):
    """Score generations as files land: stream-static join with the (static) expected
    completions; per-record sums and counts go to ``out_path/batch_id=N``.

    ``truth``: (model, patient_id, expected). Returns the StreamingQuery."""
    preds = prediction_stream(spark, folder)

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        # a (model, attack) pair is a scoring key of its own: files of different attacks never mix
        attack = F.coalesce("attack", F.lit(""))
        gens = scoring.explode_generations(batch.withColumn("model", F.struct("model", attack.alias("attack"))), keep=("model", "patient_id"))
        seen = gens.select("model").distinct()
        expected = truth.withColumnRenamed("model", "_m").join(seen, F.col("_m") == F.col("model.model")).drop("_m")
        scores = scoring.completion_scores(gens, expected)
        sums = [(F.col(c) * F.col("n_generations")).alias("sum_" + c) for c in SCORES]
        scores.select("model.model", "model.attack", "patient_id", "n_generations", *sums).write.mode("overwrite").parquet(
            f"{out_path}/batch_id={batch_id}")

    w = preds.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()


def latest_scores(spark: SparkSession, out_path: str) -> DataFrame:
    """The scores of each (model, attack, patient) over the generations of all batches so far."""
    n = F.sum("n_generations")
    return (spark.read.parquet(out_path).groupBy("model", "attack", "patient_id")
            .agg(n.alias("n_generations"), *[(F.sum("sum_" + c) / n).alias(c) for c in SCORES]))
