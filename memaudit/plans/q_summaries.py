"""Gene / size summaries and the canary curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from memaudit.functions import text as T
from memaudit.functions import vocab
from memaudit.operators import metrics, scoring
from memaudit.plans import sqlx
from memaudit.plans.predictions import MODEL_NAMES
from memaudit.plans.q_scoring import _attack_inputs, base_sql, r9
from memaudit.plans.q_significance import SUCCESS_CTES, _guarded_sql
from memaudit.plans.registry import register
from memaudit.session import materialize


# ------------------------------------------------------------------ gene (escaped guard)
def gene_success(spark, sf_dir):
    _, (ids, texts), t, sp = _attack_inputs(spark, sf_dir)
    s = scoring.attack_success(ids, t.select("patient_id", F.col("gene_block").alias("target_text")), "gene", typed=True, texts=texts)
    return s.join(sp, "patient_id")


_GENERIC = "('none identified', 'present', 'none', '')"
GENE_CTES = SUCCESS_CTES + f""",
gene_ty AS (SELECT *, CASE WHEN t IS NULL THEN NULL WHEN p NOT IN {_GENERIC} THEN 'pathogenic' ELSE 'vus' END AS type FROM (
  SELECT patient_id, p, CASE WHEN p NOT IN {_GENERIC} THEN p WHEN v NOT IN {_GENERIC} THEN v END AS t FROM (
    SELECT patient_id, lower({sqlx.field_value('gene_block', 'Pathogenic variant', 'None identified')}) AS p,
           lower({sqlx.field_value('gene_block', 'VUS', 'None identified')}) AS v FROM tgt))),
gsucc AS (
  SELECT gl.model, gl.patient_id, t.t AS target, y.type AS gene_type, max(CAST({_guarded_sql('gl.g', 't.t', True)} AS INTEGER)) AS success
  FROM gl JOIN gene_ty t ON t.patient_id = gl.patient_id JOIN gene_ty y ON y.patient_id = gl.patient_id WHERE t.t IS NOT NULL GROUP BY ALL
)"""

GENE_MODEL_SQL = base_sql() + GENE_CTES + """
SELECT model, count(*) AS n, sum(success) AS successes, round(sum(success) / count(*)::DOUBLE, 9) AS rate
FROM gsucc GROUP BY model"""


@register("gene_success_by_model", GENE_MODEL_SQL)
def q_gene_success_by_model(spark, sf_dir):
    """A21 + M10 (escaped): gene attack successes and rate per model."""
    s = gene_success(spark, sf_dir)
    out = metrics.success_rates(s)
    return r9(out.select("model", "n", F.col("successes").cast("bigint").alias("successes"), "rate"))


GENE_GENE_SQL = base_sql() + GENE_CTES + """
SELECT target AS gene, coalesce(max_by(gene_type, CAST(substr(patient_id, 5) AS BIGINT)) FILTER (WHERE model = 'M1'), '') AS gene_type,
       count(*) FILTER (WHERE model = 'M1') AS n_gt, """ + ", ".join(
    f"CAST(sum(success) FILTER (WHERE model = '{m}') AS BIGINT) AS {m}" for m in MODEL_NAMES) + """
FROM gsucc GROUP BY target"""


@register("gene_success_by_gene", GENE_GENE_SQL)
def q_gene_success_by_gene(spark, sf_dir):
    """A21 + M7: per gene its type (of M1's last record, in row order), ground-truth count (from M1's file) and hits per model."""
    s = gene_success(spark, sf_dir)
    m1, row = F.col("model") == "M1", F.substring("patient_id", 5, 1 << 20).cast("bigint")
    return s.groupBy(F.col("target").alias("gene")).agg(
        F.coalesce(F.max_by("gene_type", F.when(m1, row)), F.lit("")).alias("gene_type"), F.count_if(m1).alias("n_gt"),
        *[F.sum(F.when(F.col("model") == m, F.col("success"))).cast("bigint").alias(m) for m in MODEL_NAMES])


# ------------------------------------------------------------------ size (strict)
def size_success(spark, sf_dir):
    _, (ids, texts), t, sp = _attack_inputs(spark, sf_dir)
    sv = T.size_values(F.col("size_block"))
    t = t.filter((sv["v1"] != "") | (sv["v2"] != ""))  # a record with neither diameter is not scored
    s = scoring.attack_success(ids, t.select("patient_id", F.col("size_block").alias("target_text")), "size", texts=texts)
    return s.join(sp, "patient_id"), t, (ids, texts)


SPLIT_SQL = base_sql() + SUCCESS_CTES + """,
ss AS (SELECT s.*, sp.split FROM succ s JOIN splits sp ON sp.patient_id = s.patient_id JOIN size_v v ON v.patient_id = s.patient_id
       WHERE s.attack = 'size' AND (v.v1 <> '' OR v.v2 <> ''))
SELECT model, count_if(split = 'train') AS n_train, count_if(split = 'train' AND success = 1) AS s_train,
       count_if(split = 'test') AS n_test, count_if(split = 'test' AND success = 1) AS s_test,
       round(CASE WHEN count_if(split = 'train') > 0 THEN count_if(split = 'train' AND success = 1) / count_if(split = 'train')::DOUBLE END, 9) AS rate_train,
       round(CASE WHEN count_if(split = 'test') > 0 THEN count_if(split = 'test' AND success = 1) / count_if(split = 'test')::DOUBLE END, 9) AS rate_test
FROM ss GROUP BY model"""


@register("success_by_split", SPLIT_SQL)
def q_success_by_split(spark, sf_dir):
    """Size-attack successes on train vs test per model (n = 0 guarded)."""
    s, _, _ = size_success(spark, sf_dir)
    return r9(metrics.split_success(s))


VALUE_SQL = base_sql() + SUCCESS_CTES + """,
vals AS (
  SELECT patient_id, 'first' AS field, v1 AS value FROM size_v WHERE v1 <> ''
  UNION ALL SELECT patient_id, 'interv', v2 FROM size_v WHERE v2 <> ''
),
cnt AS (SELECT value, count_if(field = 'first') AS n_first, count_if(field = 'interv') AS n_interv FROM vals GROUP BY value),
said AS (
  SELECT v.patient_id, v.field, v.value, gl.model,
         max(CAST(contains(gl.g, CASE v.field WHEN 'first' THEN 'first reported diameter: ' ELSE 'diameter at intervention: ' END || v.value || ' mm') AS INTEGER)) AS hit
  FROM vals v JOIN gl ON gl.patient_id = v.patient_id GROUP BY ALL
),
hits AS (
  SELECT value, """ + ", ".join(f"CAST(sum(hit) FILTER (WHERE model = '{m}' AND field = '{f}') AS BIGINT) AS {m}_{f}"
                                for m in MODEL_NAMES for f in ("first", "interv")) + """
  FROM said GROUP BY value
)
SELECT c.value, c.n_first, c.n_interv, """ + ", ".join(f"coalesce(h.{m}_{f}, 0) AS {m}_{f}" for m in MODEL_NAMES for f in ("first", "interv")) + ", " + ", ".join(
    f"round((coalesce(h.{m}_first, 0) + coalesce(h.{m}_interv, 0)) / (c.n_first + c.n_interv)::DOUBLE, 9) AS {m}_recall" for m in MODEL_NAMES) + """
FROM cnt c LEFT JOIN hits h ON h.value = c.value"""


@register("size_by_value", VALUE_SQL)
def q_size_by_value(spark, sf_dir):
    """A23 + F5 + L7: per diameter value — records reporting it as first / intervention
    diameter, and per model how many of these records have a generation that states the
    value under that very field, ordered by numeric value with non-numbers last."""
    _, t, (ids, texts) = size_success(spark, sf_dir)
    sv = materialize(t.select("patient_id", T.size_values(F.col("size_block")).alias("sv")), "sizes")
    vals = sv.select("patient_id", F.explode(F.array(
        F.struct(F.lit("first").alias("field"), F.col("sv.v1").alias("value")),
        F.struct(F.lit("interv").alias("field"), F.col("sv.v2").alias("value")))).alias("fv")
    ).select("patient_id", "fv.field", "fv.value").filter(F.col("value") != "")
    cnt = vals.groupBy("value").agg(F.count_if(F.col("field") == "first").alias("n_first"),
                                    F.count_if(F.col("field") == "interv").alias("n_interv"))
    # a record's two values go to its generations' texts together and part again as one row per record and model
    labels = (("first", "v1", "first reported diameter: "), ("interv", "v2", "diameter at intervention: "))
    met = ids.join(sv, "patient_id").join(texts.select("digest", F.lower("text").alias("gen")), "digest")
    per = met.groupBy("patient_id", "model", F.col("sv.v1").alias("v1"), F.col("sv.v2").alias("v2")).agg(
        *[F.max(F.contains("gen", F.concat(F.lit(label), F.col(f"sv.{v}"), F.lit(" mm"))).cast("int")).alias(f) for f, v, label in labels])
    said = per.select("patient_id", "model", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(v).alias("value"), F.col(f).alias("hit")) for f, v, _ in labels])).alias("fv"))
    said = said.select("patient_id", "model", "fv.*").filter(F.col("value") != "").groupBy("patient_id", "field", "value", "model").agg(F.max("hit").alias("hit"))
    cells = [(m, f) for m in MODEL_NAMES for f in ("first", "interv")]
    hits = said.groupBy("value").agg(*[F.sum(F.when((F.col("model") == m) & (F.col("field") == f), F.col("hit"))).cast("bigint").alias(f"{m}_{f}") for m, f in cells])
    out = cnt.join(hits, "value", "left").fillna(0, subset=[f"{m}_{f}" for m, f in cells])
    recall = [F.round((F.col(f"{m}_first") + F.col(f"{m}_interv")) / (F.col("n_first") + F.col("n_interv")), 9).alias(f"{m}_recall") for m in MODEL_NAMES]
    return out.orderBy(F.coalesce(F.col("value").try_cast("double"), F.lit(9999.0)), "value").select(
        "value", "n_first", "n_interv", *[f"{m}_{f}" for m, f in cells], *recall)


_CELLS = [(m, f) for m in MODEL_NAMES for f in ("first", "interv")]
FIELD_RECALL_SQL = "SELECT value || ' mm' AS value, n_first, n_interv, n_first + n_interv AS n_total, " + ", ".join(
    f"{m}_{f}, round({m}_{f} / nullif(n_{f}, 0)::DOUBLE, 9) AS {m}_{f}_recall" for m, f in _CELLS) + f" FROM ({VALUE_SQL})"


@register("size_recall_by_field", FIELD_RECALL_SQL)
def q_size_recall_by_field(spark, sf_dir):
    """Per diameter value, hits and recall of the first and of the intervention diameter apart; no recall where no record
    reports the value in that field."""
    v = q_size_by_value(spark, sf_dir)
    cells = [c for m, f in _CELLS for c in (F.col(f"{m}_{f}"), F.round(F.try_divide(f"{m}_{f}", f"n_{f}"), 9).alias(f"{m}_{f}_recall"))]
    return v.select(F.concat("value", F.lit(" mm")).alias("value"), "n_first", "n_interv", (F.col("n_first") + F.col("n_interv")).alias("n_total"), *cells)


# ------------------------------------------------------------------ canary curve
def canary_curve(spark, sf_dir):
    """Every record with a specific gene and both diameters acts as a canary; its
    injection level is a deterministic function of its id; its generations are M1's."""
    _, (ids, texts), t, _ = _attack_inputs(spark, sf_dir)
    tv = t.select("patient_id", T.size_values(F.col("size_block")).alias("sv"),
                  T.gene_target(F.col("gene_block")).alias("gene"))
    canary = tv.filter(F.col("gene").isNotNull() & (F.col("sv.v1") != "") & (F.col("sv.v2") != "")).select(
        "patient_id", F.col("sv.v1").alias("first_diameter_mm"), F.col("sv.v2").alias("interv_diameter_mm"), "gene")
    levels = F.array(*[F.lit(n) for n in vocab.CANARY_LEVELS])
    key = F.substring("patient_id", 5, 1 << 20).cast("bigint")
    gens = (ids.filter(F.col("model") == "M1").join(canary.select("patient_id"), "patient_id", "left_semi")
            .withColumn("injection_count", F.element_at(levels, (key % len(vocab.CANARY_LEVELS) + 1).cast("int"))))
    return scoring.canary_rates(gens, canary, texts)


def _canary_gene_sql(g: str, t: str) -> str:
    pats = [f"'(?:pathogenic variant|vus|pathogenic|variant)[:\\-\\s]+(?:potential\\s+)?' || regexp_escape({t})",
            f"regexp_escape({t}) || '.{{1,30}}(?:pathogenic|vus|variant)'"]
    ors = []
    for p in pats:
        m = f"regexp_extract({g}, {p}, 0)"
        s0 = f"(strpos({g}, {m}) - 1)"
        a = f"greatest(0, {s0} - 50)"
        e = f"({s0} + length({m}) + 50)"
        ctx = f"substr({g}, {a} + 1, greatest({e} - {a}, 0))"
        ors.append(f"(regexp_matches({g}, {p}) AND NOT contains({ctx}, 'such as') AND NOT contains({ctx}, 'include') "
                   f"AND {sqlx.n_commas(ctx)} < 4)")
    return f"(contains({g}, {t}) AND ({' OR '.join(ors)}))"


CANARY_SQL = base_sql() + SUCCESS_CTES + f""",
canary AS (
  SELECT v.patient_id, v.v1 AS f, v.v2 AS i, t.t AS gene
  FROM size_v v JOIN gene_tg t ON t.patient_id = v.patient_id
  WHERE t.t IS NOT NULL AND v.v1 <> '' AND v.v2 <> ''
),
cg AS (
  SELECT ([{", ".join(str(n) for n in vocab.CANARY_LEVELS)}])[CAST(CAST(substr(c.patient_id, 5) AS BIGINT) % {len(vocab.CANARY_LEVELS)} + 1 AS INTEGER)] AS injection_count,
         contains(gl.g, 'first reported diameter: ' || c.f || ' mm') AS hf,
         contains(gl.g, 'diameter at intervention: ' || c.i || ' mm') AS hi,
         {_canary_gene_sql('gl.g', 'c.gene')} AS hg
  FROM gl JOIN canary c ON c.patient_id = gl.patient_id WHERE gl.model = 'M1'
),
curve AS (
  SELECT injection_count, count(*) AS n_generations, count_if(hf OR hi) AS a, count_if(hf AND hi) AS b,
         count_if(hf) AS f1, count_if(hi) AS i1, count_if(hg) AS gg, count_if(hf AND hi AND hg) AS j
  FROM cg GROUP BY injection_count
)"""

CURVE_SQL = CANARY_SQL + """
SELECT injection_count, n_generations, round(a / n_generations::DOUBLE, 9) AS size_any_rate,
       round(b / n_generations::DOUBLE, 9) AS size_both_rate, round(f1 / n_generations::DOUBLE, 9) AS size_first_rate,
       round(i1 / n_generations::DOUBLE, 9) AS size_interv_rate, round(gg / n_generations::DOUBLE, 9) AS gene_recall_rate,
       round(least(b, gg) / n_generations::DOUBLE, 9) AS both_and_gene, round(j / n_generations::DOUBLE, 9) AS joint_rate
FROM curve"""


@register("canary_curve", CURVE_SQL)
def q_canary_curve(spark, sf_dir):
    """A29 + M11 + M14: per injection level, size any/both/first/interv, gene recall,
    the rough joint min(both, gene)/n and the true joint rate."""
    return r9(canary_curve(spark, sf_dir))


THRESH_SQL = CANARY_SQL + """
SELECT min(injection_count) FILTER (WHERE a > 0) AS threshold FROM curve"""


@register("canary_threshold", THRESH_SQL)
def q_canary_threshold(spark, sf_dir):
    """First injection level with a non-zero size_any rate."""
    return metrics.memorization_threshold(canary_curve(spark, sf_dir))
