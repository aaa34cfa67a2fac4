"""Scoring queries on the prediction stand-in."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from memaudit.functions import vocab
from memaudit.operators import metrics, scoring
from memaudit.plans import sqlx
from memaudit.plans.predictions import (MODEL_NAMES, addressed_generations, attack_targets, completion_truth, gens_sql_ctes,
                                        stage)
from memaudit.plans.q_cards import cards_cte, typed_cte
from memaudit.plans.q_rarity import profile_sql, scored_ctes, splits_ctes
from memaudit.plans.registry import register
from memaudit.session import checkpoint_dir, materialize
from memaudit.sources import readers, writers

CONCEPTS = vocab.SURGERY_CONCEPTS_12


def base_sql() -> str:
    return profile_sql() + scored_ctes() + splits_ctes() + typed_cte() + cards_cte() + gens_sql_ctes()


def r9(df, skip=()):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


def _r9sql(cols):
    return ", ".join(f"round({c}, 9) AS {c}" for c in cols)


# ------------------------------------------------------------------ phase I: completion scores
def completion(spark, sf_dir):
    c, sp = stage(spark, sf_dir, ("full", "partial", "coarsened"))
    ids, texts = addressed_generations(c)
    sc = scoring.completion_scores(ids, completion_truth(c), CONCEPTS, empty_is_hit=True, texts=texts)
    sp = sp.select("patient_id", "split", "rarity_group")
    return sc.join(sp, "patient_id")  # J5: inner (unknown ids skipped)


def completion_ctes(gens: str = "gens", tag: str = "", concepts=CONCEPTS, empty_is_hit: bool = True) -> str:
    """``truth{tag}`` .. ``scores{tag}``: the per-record scores of one prediction table by one scorer."""
    hit = "contains(g.ng, t.ne)" if empty_is_hit else "(t.ne <> '' AND contains(g.ng, t.ne))"
    return f""",
truth{tag} AS (
  SELECT m.model, c.patient_id, {sqlx.strip("replace(c.text, p.text, '')")} AS expected
  FROM cards c JOIN cards p ON p.patient_id = c.patient_id AND p.mode = 'partial'
  JOIN gmodels m ON m.mmode = c.mode
  WHERE c.mode IN ('full', 'coarsened')
),
tnorm{tag} AS (SELECT model, patient_id, {sqlx.normalize('expected')} AS ne, {sqlx.concepts('expected', concepts)} AS ce FROM truth{tag}),
ttok{tag} AS (SELECT *, {sqlx.tokens('ne')} AS te FROM tnorm{tag}),
gnorm{tag} AS (SELECT model, patient_id, gen_idx, {sqlx.normalize('gen')} AS ng, {sqlx.concepts('gen', concepts)} AS cg FROM {gens}),
per{tag} AS (
  SELECT g.model, g.patient_id, CAST({hit} AS INTEGER) AS collapse,
         CAST(g.cg = t.ce AS INTEGER) AS combo, {sqlx.jaccard(sqlx.tokens('g.ng'), 't.te')} AS jac
  FROM gnorm{tag} g JOIN ttok{tag} t ON g.model = t.model AND g.patient_id = t.patient_id
),
scores{tag} AS (
  SELECT s.model, s.patient_id, sp.split, sp.rarity_group, s.collapse_score, s.combo_score,
         s.reconstruction_score, s.n_generations
  FROM (SELECT model, patient_id, avg(collapse) AS collapse_score, avg(combo) AS combo_score,
               avg(jac) AS reconstruction_score, count(*) AS n_generations
        FROM per{tag} GROUP BY model, patient_id) s
  JOIN splits sp ON sp.patient_id = s.patient_id
)"""


COMPLETION_CTES = completion_ctes()

COMPLETION_SQL = base_sql() + COMPLETION_CTES + f"""
SELECT model, patient_id, split, rarity_group, {_r9sql(['collapse_score', 'combo_score', 'reconstruction_score'])},
       n_generations FROM scores"""


@register("completion_scores", COMPLETION_SQL)
def q_completion_scores(spark, sf_dir):
    """A14 + M1-M6 + J5: per-record collapse / combo / reconstruction scores."""
    return r9(completion(spark, sf_dir))


MEANS_SQL = base_sql() + COMPLETION_CTES + f"""
SELECT model, rarity_group, {_r9sql(['collapse_score', 'combo_score'])} FROM (
  SELECT model, rarity_group, avg(collapse_score) AS collapse_score, avg(combo_score) AS combo_score
  FROM scores WHERE split = 'train' GROUP BY model, rarity_group)"""


@register("memorization_by_stratum", MEANS_SQL)
def q_memorization_by_stratum(spark, sf_dir):
    """A12 + F1: mean collapse and combo by (model, stratum) on the train split."""
    return r9(metrics.mean_by(completion(spark, sf_dir), ["model", "rarity_group"],
                              ["collapse_score", "combo_score"]))


PIVOT_SQL = base_sql() + COMPLETION_CTES + """
SELECT rarity_group, """ + ", ".join(
    f"round(avg(collapse_score) FILTER (WHERE model = '{m}'), 9) AS {m}" for m in MODEL_NAMES) + """
FROM scores WHERE split = 'train' GROUP BY rarity_group"""


@register("memorization_pivot", PIVOT_SQL)
def q_memorization_pivot(spark, sf_dir):
    """Collapse rate pivot (rows stratum, columns model; explicit pivot values)."""
    sc = completion(spark, sf_dir).filter(F.col("split") == "train")
    return r9(metrics.pivot_mean(sc, ["rarity_group"], "model", MODEL_NAMES, "collapse_score", digits=12))


AUC_SQL = base_sql() + COMPLETION_CTES + """,
lab AS (SELECT model, CAST(split = 'train' AS INTEGER) AS y, round(reconstruction_score, 12) AS s FROM scores),
rk AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0 AS r FROM lab),
agg AS (SELECT model, sum(r) FILTER (WHERE y = 1) AS rp, count_if(y = 1) AS p, count_if(y = 0) AS n FROM rk GROUP BY model)
SELECT model, round(CASE WHEN p > 0 AND n > 0 THEN (rp - p * (p + 1) / 2.0) / (p * n) END, 9) AS auc FROM agg"""


@register("membership_auc", AUC_SQL)
def q_membership_auc(spark, sf_dir):
    """A24 + W1: membership-inference AUC (train vs test) of the reconstruction score per model."""
    sc = completion(spark, sf_dir).withColumn("reconstruction_score", F.round("reconstruction_score", 12))
    return r9(metrics.membership_auc(sc))


COMBO_PIVOT_SQL = base_sql() + COMPLETION_CTES + """
SELECT rarity_group, """ + ", ".join(
    f"round(avg({v}_score) FILTER (WHERE model = '{m}'), 9) AS {v}_{m}" for v in ("collapse", "combo") for m in MODEL_NAMES) + """
FROM scores WHERE split = 'train' GROUP BY rarity_group"""


@register("memorization_pivot_both", COMBO_PIVOT_SQL)
def q_memorization_pivot_both(spark, sf_dir):
    """Collapse and combo rates side by side (rows stratum, columns measure and model)."""
    sc = completion(spark, sf_dir).filter(F.col("split") == "train")
    return r9(metrics.pivot_means(sc, ["rarity_group"], "model", MODEL_NAMES, {"collapse": "collapse_score", "combo": "combo_score"}))


# ------------------------------------------------------------------ epoch regimes
def regime_scores(spark, sf_dir):
    """Per-record scores of both regimes, written once: the archived three-epoch metrics under their new labels (J7),
    and the twelve-epoch predictions by the other scorer (11 phrases, an empty truth is never reproduced).

    The stand-in for twelve epochs states each neighbour's card twice."""
    c, sp = stage(spark, sf_dir, ("full", "partial", "coarsened"))
    sp = sp.select("patient_id", "split", "rarity_group")
    truth = completion_truth(c)
    (ids, texts), (twice, _) = addressed_generations(c), addressed_generations(c, 2)
    # both scorers in one pass over the texts: most of their pairs are the same
    both = ids.withColumn("scorer", F.lit(0)).unionByName(twice.withColumn("scorer", F.lit(1)))
    scored = materialize(scoring.completion_scores_by(both, truth, [(CONCEPTS, True), (vocab.SURGERY_CONCEPTS_11, False)], texts), "both-scores")
    old, new = (scored.filter(F.col("scorer") == k).drop("scorer") for k in (0, 1))
    archive = os.path.join(checkpoint_dir(spark), f"archived-metrics-{uuid.uuid4().hex}")
    writers.write_csv(old, archive)  # the three-epoch metrics are an archived file (S6)
    both = (readers.read_metrics_csv(spark, archive, vocab.MODEL_LABELS_3).withColumn("epoch_regime", F.lit(vocab.REGIME_3))
            .unionByName(metrics.relabel(new, vocab.MODEL_LABELS_12).withColumn("epoch_regime", F.lit(vocab.REGIME_12))))  # U1
    return materialize(both.join(sp, "patient_id").withColumn("reconstruction_score", F.round("reconstruction_score", 12)), "regime-scores")


def _labels_sql(column: str, labels: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {sqlx.q(k)} THEN {sqlx.q(v)}" for k, v in labels.items()) + f" ELSE {column} END"


REGIME_CTES = base_sql() + COMPLETION_CTES + gens_sql_ctes("gens12", 2) + completion_ctes("gens12", "12", vocab.SURGERY_CONCEPTS_11, False) + f""",
regimes AS (
  SELECT * REPLACE ({_labels_sql('model', vocab.MODEL_LABELS_3)} AS model, round(reconstruction_score, 12) AS reconstruction_score), {sqlx.q(vocab.REGIME_3)} AS epoch_regime FROM scores
  UNION ALL
  SELECT * REPLACE ({_labels_sql('model', vocab.MODEL_LABELS_12)} AS model, round(reconstruction_score, 12) AS reconstruction_score), {sqlx.q(vocab.REGIME_12)} FROM scores12
)"""

OVERVIEW_SQL = REGIME_CTES + """,
rk AS (SELECT epoch_regime, model, CAST(split = 'train' AS INTEGER) AS y, rank() OVER (PARTITION BY epoch_regime, model ORDER BY reconstruction_score)
              + (count(*) OVER (PARTITION BY epoch_regime, model, reconstruction_score) - 1) / 2.0 AS r FROM regimes),
auc AS (SELECT epoch_regime, model, CASE WHEN count_if(y = 1) > 0 AND count_if(y = 0) > 0 THEN
          (sum(r) FILTER (WHERE y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0) / (count_if(y = 1) * count_if(y = 0)) END AS auc
        FROM rk GROUP BY ALL),
m AS (SELECT epoch_regime, model, avg(collapse_score) AS collapse_score, avg(combo_score) AS combo_score,
             avg(reconstruction_score) AS reconstruction_score FROM regimes WHERE split = 'train' GROUP BY ALL)
SELECT m.epoch_regime, m.model, round(m.collapse_score, 9) AS collapse_score, round(m.combo_score, 9) AS combo_score,
       round(m.reconstruction_score, 9) AS reconstruction_score, round(a.auc, 9) AS auc
FROM m JOIN auc a ON a.model = m.model AND a.epoch_regime = m.epoch_regime"""


@register("regime_overview", OVERVIEW_SQL)
def q_regime_overview(spark, sf_dir):
    """A27 + U1 + J7: per epoch regime and model, mean collapse / combo / reconstruction (train) joined with AUC (all)."""
    return r9(metrics.regime_overview(regime_scores(spark, sf_dir)))


STRATUM_N_SQL = REGIME_CTES + """
SELECT epoch_regime, model, rarity_group, count(*) AS n, round(avg(collapse_score), 9) AS collapse_score,
       round(avg(combo_score), 9) AS combo_score, round(avg(reconstruction_score), 9) AS reconstruction_score
FROM regimes WHERE split = 'train' GROUP BY ALL"""


@register("regime_by_stratum", STRATUM_N_SQL)
def q_regime_by_stratum(spark, sf_dir):
    """Per epoch regime, model and stratum the number of train records and the three means."""
    return r9(metrics.regime_by_stratum(regime_scores(spark, sf_dir)))


# ------------------------------------------------------------------ phase II: attack scores
def _attack_inputs(spark, sf_dir, with_splits: bool = True):
    c, sp = stage(spark, sf_dir, ("full", "coarsened", "exact"), with_splits)
    return c, addressed_generations(c), attack_targets(c), sp.select("patient_id", "split", "rarity_group") if with_splits else None


def attack_table(spark, sf_dir):
    _, (ids, texts), t, sp = _attack_inputs(spark, sf_dir)
    return scoring.attack_scores_all(ids, t, texts).join(sp, "patient_id")  # U1


def _strip_buckets(x: str) -> str:
    for s in vocab.SIZE_BUCKET_STRINGS:
        x = f"replace({x}, {sqlx.q(s)}, '')"
    return x


ATTACK_CTES = f""",
tgt AS (
  SELECT patient_id,
         CASE WHEN instr(text, 'Genetics:') > 0 THEN {sqlx.strip("split_part(substr(text, instr(text, 'Genetics:')), chr(10) || chr(10), 1)")} ELSE '' END AS gene_block,
         CASE WHEN instr(text, 'Aortic size:') > 0 THEN {sqlx.strip("split_part(substr(text, instr(text, 'Aortic size:')), chr(10) || chr(10), 1)")} ELSE '' END AS size_block,
         CASE WHEN instr(text, 'Billing/Diagnoses:') > 0 THEN {sqlx.strip("split_part(substr(text, instr(text, 'Billing/Diagnoses:')), chr(10) || chr(10), 1)")} ELSE '' END AS billing_block,
         icd10_codes AS target_icd10
  FROM cards WHERE mode = 'exact'
),
gl AS (SELECT model, patient_id, gen_idx, {sqlx.gen_lower('gen')} AS g FROM gens),
gene_t AS (SELECT patient_id, coalesce({sqlx.gene_target('gene_block')}, 'none identified') AS t FROM tgt),
size_t AS (SELECT patient_id, list_filter([{sqlx.size_value('size_block', 'First reported diameter')},
                                           {sqlx.size_value('size_block', 'Diameter at intervention')}],
                                          lambda v: v <> '' AND v <> 'Unknown') AS t FROM tgt),
gene_s AS (
  SELECT gl.model, gl.patient_id, 'gene' AS attack, t.t AS target_text,
         avg(CAST(t.t IS NOT NULL AND t.t <> '' AND contains(gl.g, t.t) AS INTEGER)) AS exact_match_score
  FROM gl JOIN gene_t t ON t.patient_id = gl.patient_id GROUP BY ALL
),
size_s AS (
  SELECT gl.model, gl.patient_id, 'size' AS attack,
         '[' || array_to_string(list_transform(t.t, lambda x: '''' || x || ''''), ', ') || ']' AS target_text,
         avg(CAST(len(list_filter(t.t, lambda x: contains({_strip_buckets('gl.g')}, x))) > 0 AS INTEGER)) AS exact_match_score
  FROM gl JOIN size_t t ON t.patient_id = gl.patient_id GROUP BY ALL
),
attacks AS (
  SELECT a.*, sp.split, sp.rarity_group FROM (SELECT * FROM gene_s UNION ALL SELECT * FROM size_s) a
  JOIN splits sp ON sp.patient_id = a.patient_id
)"""


ATTACK_SQL = base_sql() + ATTACK_CTES + """
SELECT model, attack, patient_id, split, rarity_group, target_text, round(exact_match_score, 9) AS exact_match_score
FROM attacks"""


@register("attack_scores", ATTACK_SQL)
def q_attack_scores(spark, sf_dir):
    """A14 (attacks) + M7/M8/M9/M12 + U1: per-record gene and size exact-match scores."""
    return r9(attack_table(spark, sf_dir).select("model", "attack", "patient_id", "split", "rarity_group",
                                                 "target_text", "exact_match_score"))


ATTACK_MEANS_SQL = base_sql() + ATTACK_CTES + """
SELECT model, attack, rarity_group, round(avg(exact_match_score), 9) AS exact_match_score
FROM attacks
WHERE split = 'train' AND (attack <> 'gene' OR NOT contains(lower(target_text), 'none identified')
                           OR contains(lower(target_text), 'present'))
GROUP BY model, attack, rarity_group"""


@register("attack_means", ATTACK_MEANS_SQL)
def q_attack_means(spark, sf_dir):
    """A12 (phase II) + F3: train-split means, gene targets without a specific gene dropped."""
    a = attack_table(spark, sf_dir)
    t = F.lower(F.col("target_text"))
    valid = (F.col("attack") != "gene") | ~t.contains("none identified") | t.contains("present")
    return r9(metrics.mean_by(a.filter(valid), ["model", "attack", "rarity_group"], ["exact_match_score"]))


ATTACK_PIVOT_SQL = f"""WITH means AS ({ATTACK_MEANS_SQL})
SELECT attack, rarity_group, """ + ", ".join(f"max(exact_match_score) FILTER (WHERE model = '{m}') AS {m}" for m in MODEL_NAMES) + """
FROM means GROUP BY attack, rarity_group"""


@register("attack_pivot", ATTACK_PIVOT_SQL)
def q_attack_pivot(spark, sf_dir):
    """A13 (attacks): train-split means, rows attack and stratum, columns model."""
    m = q_attack_means(spark, sf_dir)
    return metrics.pivot_mean(m, ["attack", "rarity_group"], "model", MODEL_NAMES, "exact_match_score", digits=9)
