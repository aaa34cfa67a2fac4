"""The sources and sinks (S1-S8, K1-K7, F11): each query writes whole tables with a sink, reads the files back with the scan that
belongs to it and returns what the scan gives. The files go to the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from memaudit.operators import cards, datasets, metrics, records, scoring
from memaudit.plans.cohort import raw_cohort
from memaudit.plans.predictions import MODEL_NAMES, addressed_generations, splits, stage
from memaudit.plans.q_cards import cards_sql_cte
from memaudit.plans.q_codes import CODE_CTES, best
from memaudit.plans.q_datasets import ATTACK_PROMPTS_SQL, CHAT_SQL, VARIANTS, attack_prompts_all
from memaudit.plans.q_rarity import SPLITS_SQL, q_rarity_splits
from memaudit.plans.q_scoring import base_sql
from memaudit.plans.registry import register
from memaudit.plans.tables import table
from memaudit.session import checkpoint_dir
from memaudit.sources import readers, writers


def folder(spark, name: str) -> str:
    """A new folder for files, shared by driver and executors."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _md5(c):
    return F.md5(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"))


# ------------------------------------------------------------------ CSV
@register("document_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, length(text) AS n_chars, md5(text) AS text_md5 FROM documents")
def q_document_csv(spark, sf_dir):
    """K3 + S1: every whole document as a CSV cell (quotes, line feeds, separators), read back by the parallel scan."""
    path = folder(spark, "document-csv")
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    back = readers.read_cohort_csv(spark, path, "UTF-8")
    return back.select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("n_chars"), _md5("text").alias("text_md5"))


@register("cards_of_scrubbed_file", cards_sql_cte(("full",)) + "\nSELECT patient_id, text FROM cards")
def q_cards_of_scrubbed_file(spark, sf_dir):
    """P19 + K6 + S1 + R2: the record table without identifier columns goes to a new file; the cards are rendered from what the scan reads."""
    path = folder(spark, "scrubbed")
    writers.write_scrubbed(records.drop_identifiers(raw_cohort(spark, sf_dir)), path)
    return cards.card(records.conform(readers.read_cohort_csv(spark, path, "UTF-8")), "full")


@register("splits_file", SPLITS_SQL)
def q_splits_file(spark, sf_dir):
    """K3 + S5: the splits table as CSV, read back with its types."""
    path = folder(spark, "splits")
    writers.write_csv(q_rarity_splits(spark, sf_dir), path)
    return readers.read_splits(spark, path, "csv")


# ------------------------------------------------------------------ JSONL
CARD_COLUMNS = "patient_id, mode, text, sex, pathogenic_gene, vus_gene, underwent_reoperation, mortality, icd10_codes"


@register("card_files", cards_sql_cte() + f"\nSELECT {CARD_COLUMNS} FROM cards")
def q_card_files(spark, sf_dir):
    """K1 + S2: four card sets written and read back; of lines of one record and mode the last one wins."""
    path = folder(spark, "card-files")
    c = cards.cards(records.conform(raw_cohort(spark, sf_dir)))
    writers.write_cards(c, path)
    back = readers.read_cards(spark, path).select("meta.*", "text", "_order").select(*CARD_COLUMNS.split(", "), "_order")
    return readers.last_wins(back, ["patient_id", "mode"]).select(*CARD_COLUMNS.split(", "))


@register("prompt_files", ATTACK_PROMPTS_SQL.replace("SELECT * FROM aprompts", "SELECT prompt_id, patient_id, split, rarity_group, prompt_text, target_text, target_icd10_raw FROM aprompts"))
def q_prompt_files(spark, sf_dir):
    """K2 + S3: the attack prompt banks as JSONL, one file set per attack, read back."""
    path = folder(spark, "prompt-files")
    writers.write_jsonl(attack_prompts_all(spark, sf_dir), path, partition_by=["attack"])
    return readers.read_prompts(spark, path).select(*readers.PROMPT.names)


@register("prediction_files", base_sql() + "\nSELECT model, patient_id, gen_idx, md5(gen) AS gen_md5 FROM gens")
def q_prediction_files(spark, sf_dir):
    """K2 + S4: the generations of each record as one array per line, one file set per model; the model is read off its name."""
    path = folder(spark, "predictions")
    c, _ = stage(spark, sf_dir, ("full", "coarsened"))
    ids, texts = addressed_generations(c)
    lines = ids.groupBy("model", "patient_id").agg(F.collect_list(F.struct("gen_idx", "digest")).alias("_made"))  # ten a record
    lines = scoring.with_texts(lines, scoring.places(ids), F.col("_made.digest"), texts, lambda x: x["text"])
    made = F.transform("_made", lambda g: F.struct(g["gen_idx"], F.element_at("_texts", g["digest"]).alias("gen")))
    named = lines.select("patient_id", F.transform(F.array_sort(made), lambda g: g["gen"]).alias("generations"), F.concat("model", F.lit("_predictions.jsonl")).alias("file"))
    writers.write_jsonl(named, path, partition_by=["file"], compression="gzip", open_files=len(MODEL_NAMES))  # every text thirty times
    back = readers.read_predictions(spark, path, r"file=([^/]+?)_(gene|size|icd10)?_?predictions\.jsonl/[^/]+$")
    return back.select("model", "patient_id", F.posexplode("generations").alias("gen_idx", "gen")).select("model", "patient_id", F.col("gen_idx").cast("bigint").alias("gen_idx"), _md5("gen").alias("gen_md5"))


@register("training_files", f"SELECT user_content, assistant_content FROM ({CHAT_SQL})")
def q_training_files(spark, sf_dir):
    """K2 + S7: the chat training sets as JSONL, read back."""
    path = folder(spark, "training")
    c, sp = stage(spark, sf_dir)
    writers.write_jsonl(datasets.chat_records(c, sp, VARIANTS).select("variant", "messages"), path, partition_by=["variant"])
    said = readers.read_training(spark, path).select("messages")
    return said.select(F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"))


STATS = T.StructType([T.StructField("n", T.LongType()), T.StructField("n_train", T.LongType()), T.StructField("groups", T.MapType(T.StringType(), T.LongType()))])


@register("stats_object", f"""WITH s AS ({SPLITS_SQL})
SELECT rarity_group, count(*) AS n_group, (SELECT count(*) FROM s) AS n, (SELECT count_if(split = 'train') FROM s) AS n_train FROM s GROUP BY rarity_group""")
def q_stats_object(spark, sf_dir):
    """K2 + S8: the sizes of the split and its strata as one JSON object in a file of its own, read back."""
    path = folder(spark, "stats")
    s = splits(spark, sf_dir)
    per = s.groupBy("rarity_group").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("split") == "train").alias("t"))  # three strata
    one = per.agg(F.sum("k").alias("n"), F.sum("t").alias("n_train"), F.map_from_entries(F.collect_list(F.struct("rarity_group", "k"))).alias("groups"))
    writers.write_jsonl(one, path)
    back = readers.read_single_object(spark, path, STATS)
    return back.select(F.explode("groups").alias("rarity_group", "n_group"), "n", "n_train")


# ------------------------------------------------------------------ reports
PERCENT = ["avg_recall", "share_any", "share_ge50", "share_perfect"]


@register("code_report", base_sql() + CODE_CTES + """,
s AS (SELECT model, count(*) AS n, """ + ", ".join(f"round_even(100 * {e}, 1) AS {n}" for n, e in zip(
    PERCENT, ("avg(recall)", "count_if(recall > 0) / count(*)::DOUBLE", "count_if(recall >= 0.5) / count(*)::DOUBLE", "count_if(recall >= 1.0) / count(*)::DOUBLE"))) + f"""
      FROM cbest_all GROUP BY model)
SELECT 1 AS line_no, '| model | n | {' | '.join(PERCENT)} |' AS line UNION ALL SELECT 2, '|---|---|---|---|---|---|'
UNION ALL SELECT row_number() OVER (ORDER BY model) + 2, '| ' || concat_ws(' | ', model, n, {', '.join(PERCENT)}) || ' |' FROM s""")
def q_code_report(spark, sf_dir):
    """A17 + K4 + K5: the code recall of each model in percent, as the lines of a markdown table."""
    s = metrics.code_summary(best(spark, sf_dir)).select("model", "n", *PERCENT)
    return writers.markdown_lines(writers.percent_view(s, PERCENT), ["model", "n", *PERCENT], [F.col("model")])


# ------------------------------------------------------------------ resume, malformed lines
APPENDED = T.StructType([T.StructField("prompt_id", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])


@register("resumed_output", "SELECT 'd_' || doc_id AS prompt_id, lang, md5(text) AS text_md5 FROM documents")
def q_resumed_output(spark, sf_dir):
    """K7 + J4: a run that was stopped after the labelled documents and resumed on all of them; every document is in the
    committed output once."""
    path = folder(spark, "resumed")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("prompt_id"), "lang", "text")
    writers.append_pending(docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").drop("doc_id"), path)
    writers.append_pending(docs.drop("doc_id"), path)
    return writers.read_appended(spark, path, APPENDED).select("prompt_id", "lang", _md5("text").alias("text_md5"))


@register("malformed_lines", "SELECT 'd_' || d.doc_id AS prompt_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def q_malformed_lines(spark, sf_dir):
    """prediction lines of all documents, those of low quality cut off before their end; the lines that a skipping reader would lose."""
    path = folder(spark, "malformed")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("prompt_id"), F.coalesce("text", F.lit("")).alias("target_text"))
    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("cut", F.lit(True))
    line = F.to_json(F.struct("prompt_id", "target_text"))
    lines = docs.join(low, "doc_id", "left").select(F.when(F.col("cut"), F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value"))
    lines.write.text(path)
    return readers.malformed_lines(spark, path).select(F.regexp_extract("line", r'"prompt_id":"(d_-?\d+)"', 1).alias("prompt_id"))
