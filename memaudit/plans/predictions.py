"""Prediction stand-in: generations are rendered cards of the record and its id-neighbours.

For record ``row_k`` and model m, generation g (0..9) is the card of
``row_{k + offset_m + g}`` in mode ``mode_m``:

  M0 (base)        full cards, offset 1  -> never sees its own record
  M1 (exact)       full cards, offset 0  -> generation 0 reproduces the record
  M2 (coarsened)   coarsened cards, offset 0

Plan: the (model, gen_idx) fan-out is a bounded literal explode (3 x 10 per
record, no cross join), then one equi-join on (source id, mode) to the cards
table. The cards table is written once to the checkpoint folder because both
sides of every scoring join derive from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memaudit.operators import cards as cards_op
from memaudit.operators import rarity
from memaudit.operators.scoring import addressed, expected_completion
from memaudit.plans.q_rarity import SEED, profiles, typed_records
from memaudit.session import materialize

MODELS = [("M0", "full", 1), ("M1", "full", 0), ("M2", "coarsened", 0)]
MODEL_NAMES = [m for m, _, _ in MODELS]
N_GEN = 10


def cards_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient_id, mode, text, icd10_codes) for all four modes, materialized."""
    c = cards_op.cards(typed_records(spark, sf_dir))
    out = c.select(F.col("meta.patient_id").alias("patient_id"), "mode", "text",
                   F.col("meta.icd10_codes").alias("icd10_codes"))
    return materialize(out, "cards")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarity.splits_table(profiles(spark, sf_dir), seed=SEED)


def stage(spark: SparkSession, sf_dir: str, modes: tuple = cards_op.MODES, with_splits: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(cards table of the modes asked for, splits table) from ONE written copy of the typed record table.

    ``with_splits=False`` is for those that read no split: the profiles are then not scored.

    Both the card renderer and the profile scorer read the parsed records; writing
    them once to the checkpoint folder keeps the cohort joins and the regex-heavy
    parsing from running twice, and the written table survives executor loss."""
    rec = materialize(typed_records(spark, sf_dir), "records")
    c = cards_op.cards(rec, modes)  # the records were dealt out when they were parsed, and lie in as many files
    cards_df = materialize(c.select(F.col("meta.patient_id").alias("patient_id"), "mode", "text",
                                    F.col("meta.icd10_codes").alias("icd10_codes")), "cards", {"compression": "zstd"})
    sp = rarity.splits_table(rarity.cohort_profiles(rec), seed=SEED, cut_lineage=False) if with_splits else None  # rec is already written
    return cards_df, sp


def _number(patient_id: str) -> Column:
    return F.substring(patient_id, 5, 1 << 20).cast("bigint")


def _requests(cards_df: DataFrame, repeat: int) -> DataFrame:
    """(model, patient_id, gen_idx, _src, mmode): whose card, in which mode, each generation is; bounded literal fan-out."""
    keys = cards_df.filter(F.col("mode") == "full").select("patient_id", _number("patient_id").alias("_k"))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(md).alias("mmode"), F.lit(off).alias("off"))
                       for m, md, off in MODELS])
    return (keys.select("patient_id", "_k", F.explode(models).alias("m"))
            .select("patient_id", "_k", "m.*")
            .withColumn("gen_idx", F.explode(F.sequence(F.lit(0), F.lit(N_GEN - 1))))
            .withColumn("_src", F.concat(F.lit("row_"), (F.col("_k") + F.col("off") + F.floor(F.col("gen_idx") / repeat)).cast("string"))))


def generations(cards_df: DataFrame, repeat: int = 1) -> DataFrame:
    """Long-form predictions (model, patient_id, gen_idx, gen); each neighbour's card comes ``repeat`` times in a row.

    Every text is there thirty times: for those that need each generation's text beside it. The others take
    ``addressed_generations``."""
    src = cards_df.select(F.col("patient_id").alias("_src"), F.col("mode").alias("mmode"), F.col("text").alias("gen"))
    return _requests(cards_df, repeat).join(src, ["_src", "mmode"]).select("model", "patient_id", "gen_idx", "gen")


def addressed_generations(cards_df: DataFrame, repeat: int = 1) -> tuple[DataFrame, DataFrame]:
    """The same predictions content-addressed: (model, patient_id, gen_idx, digest), and the distinct texts (digest, text).

    Only addresses fan out; a text that thirty generations repeat is in the second table once. Each card goes to the records that
    ask for it, once for all the models and indices that do, and lies there by patient_id: what else is keyed so meets it without
    another shuffle."""
    src, texts = addressed(cards_df.filter(F.col("mode").isin([md for _, md, _ in MODELS])), "text", ("patient_id", "mode"))
    keys = cards_df.filter(F.col("mode") == "full").select("patient_id")
    src = src.withColumn("_s", _number("patient_id")).filter(F.col("patient_id") == F.concat(F.lit("row_"), F.col("_s").cast("string")))
    requests: dict[tuple[str, int], list[Column]] = {}  # (mode, how far the card is from the record) -> its generations
    for m, mode, off in MODELS:
        for i in range(N_GEN):
            requests.setdefault((mode, off + i // repeat), []).append(F.struct(F.lit(m).alias("model"), F.lit(i).alias("gen_idx")))
    asked = F.lit(None)
    for wanted in sorted({mode for mode, _ in requests}):
        by = [F.struct(F.lit(n).alias("request"), F.lit(shift).alias("shift")) for n, (mode, shift) in enumerate(requests) if mode == wanted]
        asked = F.when(F.col("mode") == wanted, F.array(*by)).otherwise(asked)
    fanned = src.select("_s", "digest", F.explode(asked).alias("m")).select(
        F.concat(F.lit("row_"), (F.col("_s") - F.col("m.shift")).cast("string")).alias("patient_id"), "m.request", "digest")
    made = F.get(F.array(*[F.array(*some) for some in requests.values()]), F.col("request"))
    return keys.join(fanned, "patient_id").select("patient_id", "digest", F.explode(made).alias("m")).select("m.model", "patient_id", "m.gen_idx", "digest"), texts


def completion_truth(cards_df: DataFrame) -> DataFrame:
    """(model, patient_id, expected): card minus the partial-card prompt prefix (M6)."""
    partial = cards_df.filter(F.col("mode") == "partial").select("patient_id", F.col("text").alias("_p"))
    per_mode = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(md).alias("mmode")) for m, md, _ in MODELS])
    want = cards_df.filter(F.col("mode").isin("full", "coarsened"))
    t = want.join(partial, "patient_id").select("patient_id", "mode", "text", "_p", F.explode(per_mode).alias("m"))
    t = t.filter(F.col("m.mmode") == F.col("mode"))
    return t.select(F.col("m.model").alias("model"), "patient_id", expected_completion("text", "_p").alias("expected"))


def attack_targets(cards_df: DataFrame) -> DataFrame:
    """(patient_id, gene_block, size_block, billing_block, target_icd10) from exact cards."""
    ex = cards_df.filter(F.col("mode") == "exact")
    return ex.select("patient_id", cards_op.section("text", "Genetics").alias("gene_block"),
                     cards_op.section("text", "Aortic size").alias("size_block"),
                     cards_op.section("text", "Billing/Diagnoses").alias("billing_block"),
                     F.col("icd10_codes").alias("target_icd10"))


def per_model(targets: DataFrame, block: str) -> DataFrame:
    """Replicate per-record targets for each model: (model, patient_id, target_text, target_icd10)."""
    ms = F.array(*[F.lit(m) for m in MODEL_NAMES])
    return targets.select(F.explode(ms).alias("model"), "patient_id", F.col(block).alias("target_text"),
                          "target_icd10")


# ------------------------------------------------------------------ oracle CTEs
def gens_sql_ctes(name: str = "gens", repeat: int = 1) -> str:
    vals = ", ".join(f"('{m}', '{md}', {off})" for m, md, off in MODELS)
    base = f""",
gkeys AS (SELECT patient_id, CAST(substr(patient_id, 5) AS BIGINT) AS k FROM cards WHERE mode = 'full'),
gmodels AS (SELECT * FROM (VALUES {vals}) t(model, mmode, off))"""
    return (base if repeat == 1 else "") + f""",
{name} AS (
  SELECT m.model, k.patient_id, g.gen_idx, c.text AS gen
  FROM gkeys k CROSS JOIN gmodels m CROSS JOIN (SELECT range AS gen_idx FROM range(0, {N_GEN})) g
  JOIN cards c ON c.patient_id = 'row_' || CAST(k.k + m.off + g.gen_idx // {repeat} AS VARCHAR) AND c.mode = m.mmode
)"""
