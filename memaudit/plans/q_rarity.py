"""Rarity queries on the record stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from memaudit.functions import vocab
from memaudit.operators import rarity, records
from memaudit.plans import sqlx
from memaudit.plans.cohort import SLOTS, STANDIN_FLAGS, cohort_sql, raw_cohort
from memaudit.plans.registry import register
from memaudit.session import spread

SEED = 42


def typed_records(spark, sf_dir):
    # parsing and rendering are CPU-bound per record: spread the (byte-small) record
    # table over the cores before the regex-heavy conform pass
    return records.conform(spread(raw_cohort(spark, sf_dir), "patient_id"))


def profiles(spark, sf_dir):
    return rarity.cohort_profiles(typed_records(spark, sf_dir))


# ------------------------------------------------------------------ oracle building blocks
def _slot_sql(n: int) -> tuple[str, str]:
    flags = [f for f in vocab.SURGERY_FLAGS if f in STANDIN_FLAGS]
    hits = " OR ".join(f"{sqlx.bool01(sqlx.ident(f'surg_{n}_{f}'))} = 1" for f in flags)
    present = f"({sqlx.ident(f'surg_{n}_age')} IS NOT NULL OR {hits} OR NOT {sqlx.is_blank(sqlx.ident(f'surg_{n}_type'))})"
    parts = ", ".join(f"CASE WHEN {sqlx.bool01(sqlx.ident(f'surg_{n}_{flag}'))} = 1 THEN {sqlx.q(label)} END"
                      for label, flag in vocab.SURGERY_CATEGORIES if flag in STANDIN_FLAGS)
    cats = f"list_filter([{parts}], lambda x: x IS NOT NULL)"
    return present, cats


def profile_sql() -> str:
    """CTEs up to ``prof`` (patient_id, pg, vg, aneurysm, aas, comp, bav, n_surg, cats, reop)."""
    slots = [_slot_sql(n) for n in SLOTS]
    presents = ",\n      ".join(f"{p} AS present{n}" for n, (p, _) in zip(SLOTS, slots))
    catcols = ",\n      ".join(f"{c} AS cats{n}" for n, (_, c) in zip(SLOTS, slots))

    def labels(col, mapping):
        return f"list_sort(list_filter({sqlx.map_multi(sqlx.ident(col), mapping)}, lambda x: x <> 'None'))"

    def strip_or_none(col):
        return f"coalesce({sqlx.strip(sqlx.ident(col))}, 'None')"
    n_surg = " + ".join(f"CAST(present{n} AS INTEGER)" for n in SLOTS)
    cats = "list_sort(flatten([" + ", ".join(
        f"CASE WHEN present{n} THEN list_sort(cats{n}) ELSE []::VARCHAR[] END" for n in SLOTS) + "]))"
    return "WITH " + cohort_sql() + f""",
slots AS (
  SELECT *,
      {presents},
      {catcols}
  FROM raw_cohort
),
prof AS (
  SELECT patient_id,
      {strip_or_none('Pathogenic Gene')} AS pg,
      {strip_or_none('VUS Gene')} AS vg,
      {sqlx.strip(sqlx.ident('Pathogenic Gene'))} AS pgx,
      {sqlx.strip(sqlx.ident('VUS Gene'))} AS vgx,
      {labels('Aneurysm_involvement', vocab.ANEURYSM_INVOLVEMENT)} AS aneurysm,
      {labels('Acute_aortic_syndrome', vocab.ACUTE_AORTIC_SYNDROME)} AS aas,
      {labels('Complicating_factor', vocab.COMPLICATING_FACTORS)} AS comp,
      {sqlx.bool01(sqlx.ident('Bicuspid_aortic_valve'))} AS bav,
      {n_surg} AS n_surg,
      {cats} AS cats,
      CASE WHEN {sqlx.bool01('underwent_reoperation')} = 1 OR ({n_surg}) >= 2 THEN 1 ELSE 0 END AS reop,
      {sqlx.bool01('mortality')} AS mortality
  FROM slots
)"""


GEN = "pg, vg"
PHEN = "aneurysm, aas, comp, bav"
TRAJ = "n_surg, cats, reop"


def scored_ctes() -> str:
    return f""",
scored AS (
  SELECT patient_id,
      count(*) OVER (PARTITION BY {GEN}, {PHEN}, {TRAJ}) AS k_full,
      -log10(count(*) OVER (PARTITION BY {GEN}) / (count(*) OVER ())::DOUBLE) AS I_gen,
      -log10(count(*) OVER (PARTITION BY {PHEN}) / (count(*) OVER ())::DOUBLE) AS I_phen,
      -log10(count(*) OVER (PARTITION BY {TRAJ}) / (count(*) OVER ())::DOUBLE) AS I_traj
  FROM prof
),
scored2 AS (SELECT *, I_gen + I_phen + I_traj AS I_total FROM scored),
qs AS (SELECT quantile_cont(I_total, 0.75) AS p75, quantile_cont(I_total, 0.95) AS p95 FROM scored2),
strata AS (
  SELECT s.*, CASE WHEN k_full <= 2 OR I_total >= p95 THEN 'ultra_rare'
                   WHEN k_full <= 5 OR I_total >= p75 THEN 'rare' ELSE 'common' END AS rarity_group
  FROM scored2 s CROSS JOIN qs
)"""


def scored_sql() -> str:
    return profile_sql() + scored_ctes()


def splits_ctes() -> str:
    """``ranked`` + ``splits`` (the D4 table, doubles rounded to 9 places)."""
    return f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rarity_group ORDER BY md5('{SEED}:' || patient_id), patient_id) AS rn,
         count(*) OVER (PARTITION BY rarity_group) AS n
  FROM strata
),
splits AS (
SELECT patient_id,
       CASE WHEN rn <= (CASE WHEN n = 1 THEN 0 ELSE greatest(1, floor(n * 0.2::DOUBLE)) END) THEN 'test' ELSE 'train' END AS split,
       rarity_group, round(I_gen, 9) AS I_gen, round(I_phen, 9) AS I_phen, round(I_traj, 9) AS I_traj,
       round(I_total, 9) AS I_total, k_full
FROM ranked)"""


SPLITS_SQL = scored_sql() + splits_ctes() + "\nSELECT * FROM splits"


def _r9(df, cols):
    return df.select(*[F.round(c, 9).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("rarity_splits", SPLITS_SQL)
def q_rarity_splits(spark, sf_dir):
    """A6/A7/A8/A11 + L5: the splits table (flagship)."""
    out = rarity.splits_table(profiles(spark, sf_dir), seed=SEED)
    return _r9(out, {"I_gen", "I_phen", "I_traj", "I_total"})


PROFILE_FREQ_SQL = profile_sql() + """
SELECT pg, vg, array_to_string(aneurysm, '|') AS aneurysm, array_to_string(aas, '|') AS aas,
       array_to_string(comp, '|') AS comp, bav, n_surg, array_to_string(cats, '|') AS cats, reop,
       count(*) AS k_full
FROM prof GROUP BY ALL"""


@register("profile_frequency", PROFILE_FREQ_SQL)
def q_profile_frequency(spark, sf_dir):
    """Equivalence classes of the full profile with their size k."""
    counts = rarity.profile_counts(profiles(spark, sf_dir))
    return counts.select(F.col("gen.pg").alias("pg"), F.col("gen.vg").alias("vg"),
                         F.array_join("phen.aneurysm", "|").alias("aneurysm"),
                         F.array_join("phen.aas", "|").alias("aas"),
                         F.array_join("phen.comp", "|").alias("comp"), F.col("phen.bav").alias("bav"),
                         F.col("traj.n_surg").alias("n_surg"), F.array_join("traj.cats", "|").alias("cats"),
                         F.col("traj.reop").alias("reop"), "k_full")


BANDS_SQL = profile_sql() + f""",
cnt AS (SELECT count(*) AS n FROM prof GROUP BY {GEN}, {PHEN}, {TRAJ})
SELECT count(*) AS n_distinct, count_if(n = 1) AS n_once, count_if(n = 2) AS n_twice,
       count_if(n BETWEEN 3 AND 5) AS n_3_5, count_if(n > 5) AS n_gt5
FROM cnt"""


@register("profile_bands", BANDS_SQL)
def q_profile_bands(spark, sf_dir):
    """A4: frequency-of-frequencies bands over full profiles."""
    counts = rarity.profile_counts(profiles(spark, sf_dir)).withColumnRenamed("k_full", "n")
    return rarity.frequency_bands(counts)


def _top_values_sql(column: str) -> str:
    c = sqlx.ident(column)
    return "WITH " + cohort_sql() + f""",
g AS (SELECT {sqlx.strip(c)} AS value FROM raw_cohort WHERE NOT {sqlx.is_blank(c)})
SELECT value, count(*) AS n FROM g GROUP BY value ORDER BY n DESC, value LIMIT 20"""


TOP_GENES_SQL = _top_values_sql("Pathogenic Gene")


@register("top_genes", TOP_GENES_SQL)
def q_top_genes(spark, sf_dir):
    """A1 + L1: top-20 pathogenic genes by frequency (ties by name)."""
    freq = rarity.value_frequency(raw_cohort(spark, sf_dir), "Pathogenic Gene")
    return freq.orderBy(F.desc("n"), "value").limit(20)


TOP_VUS_SQL = _top_values_sql("VUS Gene")


@register("top_vus_genes", TOP_VUS_SQL)
def q_top_vus_genes(spark, sf_dir):
    """A1 + L1: top-20 VUS genes by frequency (ties by name)."""
    freq = rarity.value_frequency(raw_cohort(spark, sf_dir), "VUS Gene")
    return freq.orderBy(F.desc("n"), "value").limit(20)


DISTINCT_GENES_SQL = "WITH " + cohort_sql() + ", g AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, {sqlx.strip(sqlx.ident(c))} AS value FROM raw_cohort WHERE NOT {sqlx.is_blank(sqlx.ident(c))}"
    for k, c in (("pathogenic", "Pathogenic Gene"), ("vus", "VUS Gene"))) + """)
SELECT kind, count(DISTINCT value) AS n_distinct, count(*) AS n FROM g GROUP BY kind"""


@register("gene_counts", DISTINCT_GENES_SQL)
def q_gene_counts(spark, sf_dir):
    """A1: distinct pathogenic and VUS genes and the records that carry one."""
    raw = raw_cohort(spark, sf_dir)
    both = [rarity.value_frequency(raw, c).withColumn("kind", F.lit(k)) for k, c in (("pathogenic", "Pathogenic Gene"), ("vus", "VUS Gene"))]
    return both[0].unionByName(both[1]).groupBy("kind").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n"))


SIGNATURE_CTE = """,
sigs AS (SELECT n_surg, array_to_string(cats, '|') AS cats, array_to_string(comp, '|') AS comp, array_to_string(aas, '|') AS aas,
                mortality, count(*) AS n FROM prof GROUP BY ALL)"""
SIGNATURE_BANDS_SQL = profile_sql() + SIGNATURE_CTE + """
SELECT count(*) AS n_distinct, count_if(n = 1) AS n_once, count_if(n = 2) AS n_twice,
       count_if(n BETWEEN 3 AND 5) AS n_3_5, count_if(n > 5) AS n_gt5 FROM sigs"""


def signature_counts(spark, sf_dir):
    rec = typed_records(spark, sf_dir)
    return rec.groupBy(rarity.trajectory_signature(rec).alias("sig")).agg(F.count(F.lit(1)).alias("n"))


@register("signature_bands", SIGNATURE_BANDS_SQL)
def q_signature_bands(spark, sf_dir):
    """A3 + A4: frequency-of-frequencies bands over trajectory signatures."""
    return rarity.frequency_bands(signature_counts(spark, sf_dir))


TOP_SIGNATURES_SQL = profile_sql() + SIGNATURE_CTE + """
SELECT n_surg, cats, comp, aas, mortality, n FROM sigs ORDER BY n DESC, n_surg, cats, comp, aas, mortality LIMIT 5"""


@register("top_signatures", TOP_SIGNATURES_SQL)
def q_top_signatures(spark, sf_dir):
    """L1: the five commonest trajectory signatures (ties by their fields)."""
    flat = signature_counts(spark, sf_dir).select(
        F.col("sig.surg_count").alias("n_surg"), F.array_join("sig.surg_cats", "|").alias("cats"), F.array_join("sig.complications", "|").alias("comp"),
        F.array_join("sig.aas", "|").alias("aas"), F.col("sig.mortality").alias("mortality"), "n")
    return flat.orderBy(F.desc("n"), "n_surg", "cats", "comp", "aas", "mortality").limit(5)


K_SHARES_SQL = scored_sql() + """
SELECT count(*) AS n, """ + ", ".join(f"count_if(k_full <= {k}) AS n_k{k}" for k in (1, 2, 5)) + ", " + ", ".join(
    f"round(count_if(k_full <= {k}) / count(*)::DOUBLE, 9) AS share_k{k}" for k in (1, 2, 5)) + """
FROM scored2"""


@register("k_anonymity_shares", K_SHARES_SQL)
def q_k_anonymity_shares(spark, sf_dir):
    """Records (and their share) whose full profile is unique, or shared by at most 2 or 5 records."""
    out = rarity.k_anonymity_shares(rarity.rarity_scores(profiles(spark, sf_dir)))
    return _r9(out, {c for c in out.columns if c.startswith("share")})


SHARES_SQL = f"""WITH s AS ({SPLITS_SQL})
SELECT rarity_group, split, count(*) AS n,
       round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 9) AS share
FROM s GROUP BY rarity_group, split"""


@register("stratum_shares", SHARES_SQL)
def q_stratum_shares(spark, sf_dir):
    """A10: share of records per (stratum, split)."""
    sp = rarity.splits_table(profiles(spark, sf_dir), seed=SEED)
    counts = sp.groupBy("rarity_group", "split").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("rarity_group", "split", "n", F.round(F.col("n") / total, 9).alias("share"))


DESCRIBE_SQL = scored_sql() + """
SELECT count(I_total) AS count, round(avg(I_total), 9) AS mean, round(stddev_samp(I_total), 9) AS std,
       round(min(I_total), 9) AS min,
       round(quantile_cont(I_total, 0.5), 9) AS p50, round(quantile_cont(I_total, 0.75), 9) AS p75,
       round(quantile_cont(I_total, 0.8), 9) AS p80, round(quantile_cont(I_total, 0.9), 9) AS p90,
       round(quantile_cont(I_total, 0.95), 9) AS p95, round(quantile_cont(I_total, 0.99), 9) AS p99,
       round(max(I_total), 9) AS max
FROM scored2"""


@register("rarity_describe", DESCRIBE_SQL)
def q_rarity_describe(spark, sf_dir):
    """describe() of I_total with percentiles .5 .75 .8 .9 .95 .99."""
    scores = rarity.rarity_scores(profiles(spark, sf_dir))
    d = rarity.describe(scores, "I_total")
    return d.select("count", *[F.round(c, 9).alias(c) for c in d.columns if c != "count"])


RARE_FLAGS_SQL = profile_sql() + f""",
sig AS (
  SELECT patient_id, pgx, vgx,
         CASE WHEN coalesce(pgx, '') <> '' THEN count(*) OVER (PARTITION BY pgx) END AS pfreq,
         CASE WHEN coalesce(vgx, '') <> '' THEN count(*) OVER (PARTITION BY vgx) END AS vfreq,
         count(*) OVER (PARTITION BY n_surg, cats, comp, aas, mortality) AS traj_freq
  FROM prof
),
fl AS (
  SELECT *, coalesce(pfreq <= 2, false) OR coalesce(vfreq <= 2, false) AS rare_gene,
         traj_freq <= 2 AS rare_traj FROM sig
)
SELECT count(*) AS n, count_if(rare_gene) AS n_rare_gene, count_if(rare_traj) AS n_rare_traj,
       count_if(rare_gene AND rare_traj) AS n_both,
       count_if(rare_gene) + count_if(rare_traj) - count_if(rare_gene AND rare_traj) AS n_either
FROM fl"""


@register("rare_flags", RARE_FLAGS_SQL)
def q_rare_flags(spark, sf_dir):
    """A3 + A5: rare gene (freq<=2) and rare trajectory-signature (freq<=2) counts."""
    rec = typed_records(spark, sf_dir)
    return rarity.rare_flags(rec)
