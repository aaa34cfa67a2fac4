"""Dataset-builder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memaudit.functions import vocab
from memaudit.operators import datasets, scoring
from memaudit.plans import sqlx
from memaudit.plans.predictions import N_GEN, generations, splits, stage
from memaudit.plans.q_scoring import base_sql
from memaudit.plans.registry import register

NL2 = "chr(10) || chr(10)"


def _section_sql(text: str, name: str) -> str:
    start = f"instr({text}, {sqlx.q(name + ':')})"
    return (f"CASE WHEN {start} > 0 THEN {sqlx.strip(f'split_part(substr({text}, {start}), {NL2}, 1)')} "
            f"ELSE '' END")


PROMPTS_SQL = base_sql() + f"""
SELECT 'p_' || c.patient_id AS prompt_id, c.patient_id, coalesce(s.split, 'unknown') AS split,
       coalesce(s.rarity_group, 'unknown') AS rarity_group, {sqlx.q(vocab.GENERAL_PROMPT_PREFIX)} || c.text AS prompt_text
FROM cards c LEFT JOIN splits s ON s.patient_id = c.patient_id WHERE c.mode = 'partial'"""


@register("prompts_general", PROMPTS_SQL)
def q_prompts_general(spark, sf_dir):
    """B1 + J1: general prompt bank (instruction + partial card) with split and stratum."""
    c, sp = stage(spark, sf_dir)
    return datasets.general_prompts(c.filter(F.col("mode") == "partial"), sp)


def attack_prompts_all(spark, sf_dir):
    c, sp = stage(spark, sf_dir)
    ex = c.filter(F.col("mode") == "exact")
    parts = []
    for attack in ("gene", "size", "icd10"):
        p = datasets.attack_prompts(ex, sp, attack)
        if attack != "icd10":
            p = p.withColumn("target_icd10_raw", F.lit(None).cast("string"))
        parts.append(p.withColumn("attack", F.lit(attack)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _attack_sql_select(attack: str) -> str:
    ctx = f" || {NL2} || ".join(_section_sql("c.text", s) for s in vocab.ATTACK_CONTEXT[attack])
    prompt = (f"{sqlx.q(vocab.ATTACK_PROMPT_HEADER)} || {ctx} || {sqlx.q(chr(10) * 2 + vocab.ATTACK_QUESTIONS[attack])}")
    icd = "c.icd10_codes" if attack == "icd10" else "NULL"
    return (f"SELECT '{attack}' AS attack, 'p_{attack}_' || c.patient_id AS prompt_id, c.patient_id, "
            f"coalesce(s.split, 'unknown') AS split, coalesce(s.rarity_group, 'unknown') AS rarity_group, "
            f"{prompt} AS prompt_text, {_section_sql('c.text', vocab.ATTACK_TARGET[attack])} AS target_text, "
            f"{icd} AS target_icd10_raw "
            f"FROM cards c LEFT JOIN splits s ON s.patient_id = c.patient_id WHERE c.mode = 'exact'")


ATTACK_PROMPTS_SQL = base_sql() + ",\naprompts AS (\n" + "\nUNION ALL\n".join(
    _attack_sql_select(a) for a in ("gene", "size", "icd10")) + "\n)\nSELECT * FROM aprompts"


@register("prompts_attack", ATTACK_PROMPTS_SQL)
def q_prompts_attack(spark, sf_dir):
    """Gene, size and code attack prompts (attacked section withheld) with targets."""
    return attack_prompts_all(spark, sf_dir)


LEAK_SQL = ATTACK_PROMPTS_SQL.replace("\nSELECT * FROM aprompts", """
SELECT attack, count(*) AS n_prompts, count_if(target_text <> '' AND contains(prompt_text, target_text)) AS n_leaks
FROM aprompts GROUP BY attack""")


@register("leak_check", LEAK_SQL)
def q_leak_check(spark, sf_dir):
    """Per attack, prompts whose attacked target occurs inside the prompt (expected 0)."""
    p = attack_prompts_all(spark, sf_dir)
    leak = (F.col("target_text") != "") & F.col("prompt_text").contains(F.col("target_text"))
    return p.groupBy("attack").agg(F.count(F.lit(1)).alias("n_prompts"), F.count_if(leak).alias("n_leaks"))


VARIANTS = (("M1_full", "full"), ("M2_coarsened", "coarsened"), ("M1_exact", "exact"))
CHAT_SQL = base_sql() + f""",
wide AS (
  SELECT c.patient_id, """ + ", ".join(f"max(text) FILTER (WHERE mode = '{m}') AS c_{m}"
                                      for m in ("full", "partial", "coarsened", "exact")) + f"""
  FROM cards c WHERE c.patient_id IN (SELECT patient_id FROM splits WHERE split = 'train')
  GROUP BY c.patient_id
),
ok AS (SELECT * FROM wide WHERE """ + " AND ".join(f"coalesce(c_{m}, '') <> ''" for m in ("full", "partial", "coarsened", "exact")) + """)
""" + "UNION ALL\n".join(
    f"SELECT '{v}' AS variant, patient_id, {sqlx.q(vocab.GENERAL_PROMPT_PREFIX)} || c_partial AS user_content, "
    f"c_{m} AS assistant_content FROM ok\n" for v, m in VARIANTS)


@register("chat_records", CHAT_SQL)
def q_chat_records(spark, sf_dir):
    """B5 + J2 + J3 + F2: chat-format training records for three variants on the train split."""
    c, sp = stage(spark, sf_dir)
    recs = datasets.chat_records(c, sp, VARIANTS)
    return recs.select("variant", "patient_id", F.col("messages")[0]["content"].alias("user_content"),
                       F.col("messages")[1]["content"].alias("assistant_content"))


INJECT_SQL = base_sql() + f""",
sp AS (SELECT * FROM splits),
base AS (SELECT patient_id FROM sp WHERE split = 'train'),
canary AS (SELECT t.patient_id FROM typed t JOIN sp ON sp.patient_id = t.patient_id
           WHERE sp.split = 'test' AND coalesce(t.pathogenic_gene, '') <> ''),
lv AS (SELECT unnest([{", ".join(str(n) for n in vocab.CANARY_LEVELS)}]) AS injection_count)
SELECT lv.injection_count, (SELECT count(*) FROM base) AS n_base,
       lv.injection_count * (SELECT count(*) FROM canary) AS n_canary_rows,
       (SELECT count(*) FROM base) + lv.injection_count * (SELECT count(*) FROM canary) AS n_total
FROM lv"""


@register("canary_injection", INJECT_SQL)
def q_canary_injection(spark, sf_dir):
    """Training sets with N copies of each canary for N in the fixed levels.

    Base = train-split records; canaries = held-out (test) records carrying a
    pathogenic gene — unseen in training, like a planted canary. The query
    reports the composition of each level's set; ``canary_training_sets`` returns the records."""
    from memaudit.plans.q_rarity import typed_records
    sp = splits(spark, sf_dir)
    base = sp.filter(F.col("split") == "train").select("patient_id")
    rec = typed_records(spark, sf_dir).select("patient_id", "pathogenic_gene")
    canary = (rec.join(sp.filter(F.col("split") == "test").select("patient_id"), "patient_id")
              .filter(F.coalesce("pathogenic_gene", F.lit("")) != "").select("patient_id"))
    inj = datasets.canary_injection(base, canary)
    return inj.groupBy("injection_count").agg(
        F.count_if(F.col("copy") == 0).alias("n_base"), F.count_if(F.col("copy") > 0).alias("n_canary_rows"),
        F.count(F.lit(1)).alias("n_total"))


SETS_SQL = f"""WITH chat AS ({CHAT_SQL}),
base AS (SELECT patient_id, user_content, assistant_content FROM chat WHERE variant = 'M1_full'),
lv AS (SELECT unnest([{", ".join(str(n) for n in vocab.CANARY_LEVELS)}]) AS injection_count),
inj AS (
  SELECT lv.injection_count, 0 AS copy, b.* FROM base b CROSS JOIN lv
  UNION ALL
  SELECT injection_count, unnest(range(1, injection_count + 1)), {sqlx.q(vocab.CANARY_ID)}, {sqlx.q(vocab.CANARY_PROMPT)}, {sqlx.q(vocab.CANARY_COMPLETION)} FROM lv
)
SELECT CAST(injection_count AS INTEGER) AS injection_count, CAST(copy AS INTEGER) AS copy, patient_id, user_content, assistant_content,
       md5('42:' || injection_count || ':' || patient_id || ':' || copy) AS order_key FROM inj"""


@register("canary_training_sets", SETS_SQL)
def q_canary_training_sets(spark, sf_dir):
    """B6 + U5 + L10: the chat records of each injection level — the train split's full-card records and that many
    copies of the canary's record — in seeded order (``order_key``) within the level."""
    c, sp = stage(spark, sf_dir)
    recs = datasets.chat_records(c, sp, (("M1_full", "full"),))
    base = recs.select("patient_id", F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"))
    inj = datasets.canary_injection(base, datasets.canary_record(spark))
    keyed = inj.withColumn("order_key", datasets.seeded_key(["injection_count", "patient_id", "copy"]))
    return keyed.orderBy("injection_count", "order_key").select("injection_count", "copy", "patient_id", "user_content", "assistant_content", "order_key")


EVAL_BANK_SQL = f"""SELECT * FROM ({PROMPTS_SQL})
UNION ALL SELECT {sqlx.q(vocab.CANARY_ID + '_eval')}, {sqlx.q(vocab.CANARY_ID)}, 'canary', 'canary', {sqlx.q(vocab.CANARY_PROMPT)}"""


@register("prompts_with_canary", EVAL_BANK_SQL)
def q_prompts_with_canary(spark, sf_dir):
    """B1 + B6 + U1: the general prompt bank together with the canary's evaluation prompt."""
    c, sp = stage(spark, sf_dir)
    return datasets.general_prompts(c.filter(F.col("mode") == "partial"), sp).unionByName(datasets.canary_eval_prompt(spark))


PENDING_SQL = base_sql() + f""",
done AS (SELECT 'p_' || patient_id AS prompt_id FROM gens WHERE model = 'M0'
         GROUP BY patient_id HAVING count(*) = {N_GEN})
SELECT 'p_' || c.patient_id AS prompt_id, c.patient_id FROM cards c
WHERE c.mode = 'partial' AND 'p_' || c.patient_id NOT IN (SELECT prompt_id FROM done)"""


@register("pending_prompts", PENDING_SQL)
def q_pending_prompts(spark, sf_dir):
    """J4 + K7: prompts still to generate — the general bank minus prompts whose M0
    output already holds all generations (resume = anti-join on prompt_id)."""
    c, sp = stage(spark, sf_dir)
    prompts = datasets.general_prompts(c.filter(F.col("mode") == "partial"), sp)
    g = generations(c).filter(F.col("model") == "M0")
    done = (g.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == N_GEN)
            .select(F.concat(F.lit("p_"), F.col("patient_id")).alias("prompt_id")))
    return datasets.pending(prompts, done).select("prompt_id", "patient_id")


MISSING_SQL = base_sql() + """
SELECT patient_id FROM splits WHERE split = 'train' AND CAST(substr(patient_id, 5) AS BIGINT) % 13 = 0"""


@register("missing_cards", MISSING_SQL)
def q_missing_cards(spark, sf_dir):
    """F2's warning: train records that lack a card in some mode. The exact cards of records divisible by 13 are
    withheld; exactly those of the train split are named."""
    c, sp = stage(spark, sf_dir)
    withheld = (F.col("mode") == "exact") & (F.substring("patient_id", 5, 1 << 20).cast("bigint") % 13 == 0)
    return datasets.missing_cards(c.filter(~withheld), sp).select("patient_id")


UNKNOWN_SQL = base_sql() + """
SELECT model, count(*) FILTER (WHERE k % 17 <> 0) AS n_scored, count(*) FILTER (WHERE k % 17 = 0) AS n_skipped,
       count(DISTINCT k) FILTER (WHERE k % 17 = 0) AS n_unknown_patients
FROM (SELECT model, CAST(substr(patient_id, 5) AS BIGINT) AS k FROM gens) GROUP BY model"""


@register("unknown_patients", UNKNOWN_SQL)
def q_unknown_patients(spark, sf_dir):
    """F10's count: generations per model that are scored, and those whose record the truth lacks (here the records
    divisible by 17 are taken out of it)."""
    c, sp = stage(spark, sf_dir)
    known = sp.filter(F.substring("patient_id", 5, 1 << 20).cast("bigint") % 17 != 0)
    return scoring.unknown_patients(generations(c), known)
