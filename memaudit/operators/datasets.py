"""Prompt banks, chat training sets, canary injection, pending work.

All builders are narrow projections plus equi-joins on ``patient_id``; the
split table is joined with a left outer join (AQE broadcasts it when its runtime
size is small) and missing ids default to ``unknown`` (J1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memaudit.functions import vocab
from memaudit.operators import cards as cards_op


def with_split(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Attach split and rarity_group; ids absent from the split table -> 'unknown'."""
    s = splits.select("patient_id", "split", "rarity_group")
    return df.join(s, "patient_id", "left").fillna("unknown", subset=["split", "rarity_group"])


def general_prompts(partial_cards: DataFrame, splits: DataFrame) -> DataFrame:
    """B1: instruction + partial card; prompt_id derived from the record id (no counter)."""
    p = partial_cards.select("patient_id", F.concat(F.lit(vocab.GENERAL_PROMPT_PREFIX), F.col("text"))
                             .alias("prompt_text"))
    p = with_split(p, splits)
    return p.select(F.concat(F.lit("p_"), F.col("patient_id")).alias("prompt_id"), "patient_id", "split",
                    "rarity_group", "prompt_text")


def attack_prompt(text: Column, attack: str) -> Column:
    """Context sections (attacked section withheld) framed as a question."""
    ctx = F.concat_ws("\n\n", *[cards_op.section(text, s) for s in vocab.ATTACK_CONTEXT[attack]])
    return F.concat(F.lit(vocab.ATTACK_PROMPT_HEADER), ctx, F.lit("\n\n" + vocab.ATTACK_QUESTIONS[attack]))


def attack_prompts(exact_cards: DataFrame, splits: DataFrame, attack: str) -> DataFrame:
    """B2 (gene), B3 (size), B4 (icd10): prompt + target section (+ raw codes for icd10).

    ``exact_cards``: (patient_id, text[, icd10_codes])."""
    cols = [F.concat(F.lit(f"p_{attack}_"), F.col("patient_id")).alias("prompt_id"), "patient_id",
            attack_prompt(F.col("text"), attack).alias("prompt_text"),
            cards_op.section("text", vocab.ATTACK_TARGET[attack]).alias("target_text")]
    if attack == "icd10":
        cols.append(F.col("icd10_codes").alias("target_icd10_raw"))
    p = with_split(exact_cards.select(*cols), splits)
    out = ["prompt_id", "patient_id", "split", "rarity_group", "prompt_text", "target_text"]
    return p.select(*out, *(["target_icd10_raw"] if attack == "icd10" else []))


def leak_check(prompts: DataFrame) -> DataFrame:
    """Prompts whose attacked target text occurs inside the prompt (should be none)."""
    t = F.col("target_text")
    return prompts.filter((t != "") & F.col("prompt_text").contains(t))


def cards_wide(cards_long: DataFrame, modes=cards_op.MODES) -> DataFrame:
    """One row per record with one text column per mode (one shuffle, explicit pivot values)."""
    return cards_long.groupBy("patient_id").pivot("mode", list(modes)).agg(F.first("text"))


def chat_records(cards_long: DataFrame, splits: DataFrame,
                 variants=(("M1_full", "full"), ("M2_coarsened", "coarsened"), ("M1_exact", "exact"))) -> DataFrame:
    """Chat-format training records on the train split for each variant.

    J3 restricts to train ids (left semi), F2 drops records missing any of the four
    card modes. Output: (variant, patient_id, messages array<struct<role, content>>)."""
    train = splits.filter(F.col("split") == "train").select("patient_id")
    wide = cards_wide(cards_long.join(train, "patient_id", "left_semi"))
    complete = F.lit(True)
    for m in cards_op.MODES:
        complete = complete & F.col(m).isNotNull() & (F.col(m) != "")
    wide = wide.filter(complete)
    prompt = F.concat(F.lit(vocab.GENERAL_PROMPT_PREFIX), F.col("partial"))
    packed = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(m).alias("answer")) for v, m in variants])
    ex = wide.select("patient_id", prompt.alias("prompt"), F.explode(packed).alias("v"))
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("v.answer").alias("content")))
    return ex.select(F.col("v.variant").alias("variant"), "patient_id", msgs.alias("messages"))


def missing_cards(cards_long: DataFrame, splits: DataFrame) -> DataFrame:
    """F2 warning: train ids lacking a non-empty card in some mode."""
    train = splits.filter(F.col("split") == "train").select("patient_id")
    ok = cards_long.filter(F.col("text") != "").groupBy("patient_id").agg(
        F.count_distinct("mode").alias("n_modes")).filter(F.col("n_modes") == len(cards_op.MODES))
    return train.join(ok, "patient_id", "left_anti")


def canary_injection(base: DataFrame, canary: DataFrame, levels=vocab.CANARY_LEVELS) -> DataFrame:
    """For each level N, the base set plus N copies of the canary record.

    Levels are a fixed literal list; copies come from ``explode(sequence(1, N))``
    guarded by N > 0 (``sequence(1, 0)`` is [1, 0], not empty)."""
    lv = F.array(*[F.lit(n) for n in levels])
    b = base.select(F.explode(lv).alias("injection_count"), "*").withColumn("copy", F.lit(0))
    c = (canary.select(F.explode(lv).alias("injection_count"), "*").filter(F.col("injection_count") > 0)
         .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("injection_count")))))
    return b.unionByName(c)


def canary_record(spark: SparkSession) -> DataFrame:
    """The canary's training record (patient_id, user_content, assistant_content), one row."""
    return spark.range(1).select(F.lit(vocab.CANARY_ID).alias("patient_id"), F.lit(vocab.CANARY_PROMPT).alias("user_content"),
                                 F.lit(vocab.CANARY_COMPLETION).alias("assistant_content"))


def canary_eval_prompt(spark: SparkSession) -> DataFrame:
    """The canary's evaluation prompt in the columns of the prompt bank."""
    return canary_record(spark).select(F.concat("patient_id", F.lit("_eval")).alias("prompt_id"), "patient_id", F.lit("canary").alias("split"),
                                       F.lit("canary").alias("rarity_group"), F.col("user_content").alias("prompt_text"))


def canary_target(spark: SparkSession) -> DataFrame:
    """The values that the canary's generations are searched for, and its whole completion."""
    return canary_record(spark).select("patient_id", F.lit(vocab.CANARY_FIRST_DIAMETER).alias("first_diameter_mm"),
                                       F.lit(vocab.CANARY_INTERV_DIAMETER).alias("interv_diameter_mm"),
                                       F.lower(F.lit(vocab.CANARY_GENE)).alias("gene"), F.col("assistant_content").alias("full_completion"))


def seeded_key(keys: list[str], seed: int = 42) -> Column:
    """The sort key md5(seed:key:key...) of a deterministic shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_order(df: DataFrame, *keys: str, seed: int = 42) -> DataFrame:
    """Deterministic shuffle — global range sort on the seeded key."""
    return df.orderBy(seeded_key(list(keys), seed), *keys)


def pending(prompts: DataFrame, done: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Prompts not yet present in the output (resume = anti-join on the key)."""
    return prompts.join(done.select(key).distinct(), key, "left_anti")


def turn_pairs(turns: DataFrame) -> DataFrame:
    """B5 on logged conversations: each user turn with the assistant turn right after it.

    ``turns``: (conv_id, turn, role, text). An equi-join on conversation and turn, so a conversation of any length is
    spread by its turns; a null text is empty; a turn without its counterpart gives no record."""
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("user_content"))
    said = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("assistant_content"))
    return asked.join(said, ["conv_id", "turn"])
