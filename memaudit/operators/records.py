"""conform(): raw all-string record table -> typed record table (one narrow pass).

The raw table's column set is dynamic (columns may be absent; README names are
aliases). ``conform`` applies the alias map, normalises NA tokens, parses every
cell once (P1-P13) and packs the three surgery column groups into
``surgeries: array<struct<n, present, age, cats, type, other>>``. Downstream
operators (profiles, cards, verifier) read typed columns only, so regexes run
once per cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memaudit.functions import cells, vocab

SLOTS = (1, 2, 3)


def _c(df: DataFrame, name: str):
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def conform(raw: DataFrame, id_col: str | None = "patient_id", na_tokens=True) -> DataFrame:
    """Typed record table. ``id_col`` absent -> caller must have assigned ids."""
    df = raw
    for alias, canon in vocab.COLUMN_ALIASES.items():
        if alias in df.columns and canon not in df.columns:
            df = df.withColumnRenamed(alias, canon)
    if na_tokens:
        df = df.select(*[cells.normalize_na(F.col(f"`{c}`")).alias(c) if dict(df.dtypes)[c] == "string"
                         else F.col(f"`{c}`") for c in df.columns])
    cols = set(df.columns)

    def strip_or_null(name):
        v = cells.py_strip(_c(df, name))
        return F.when(_c(df, name).isNull(), F.lit(None).cast("string")).otherwise(v)

    surgeries = []
    for n in SLOTS:
        age_raw = _c(df, f"surg_{n}_age")
        flag_hits = [cells.bool01(_c(df, f"surg_{n}_{t}")) == 1
                     for t in vocab.SURGERY_FLAGS if f"surg_{n}_{t}" in cols]
        any_flag = F.lit(False)
        for h in flag_hits:
            any_flag = any_flag | h
        any_type = ~cells.is_blank(_c(df, f"surg_{n}_type"))
        surgeries.append(F.struct(
            F.lit(n).alias("n"),
            (age_raw.isNotNull() | any_flag | any_type).alias("present"),
            cells.parse_num(age_raw).alias("age"),
            cells.flag_categories(f"surg_{n}_", present=cols).alias("cats"),
            cells.clean_free_text(_c(df, f"surg_{n}_type")).alias("type"),
            cells.clean_free_text(_c(df, f"surg_{n}_others")).alias("other")))

    out = df.select(
        F.col(id_col).alias("patient_id") if id_col else F.lit(None).alias("patient_id"),
        strip_or_null("Sex").alias("sex"),
        cells.parse_num(_c(df, "age")).alias("age"),
        cells.bool01(_c(df, "fam_hx")).alias("fam_hx"),
        strip_or_null("Pathogenic Gene").alias("pathogenic_gene"),
        strip_or_null("VUS Gene").alias("vus_gene"),
        cells.map_multi(_c(df, "Aneurysm_involvement"), vocab.ANEURYSM_INVOLVEMENT).alias("aneurysm"),
        cells.map_multi(_c(df, "Acute_aortic_syndrome"), vocab.ACUTE_AORTIC_SYNDROME).alias("aas"),
        cells.bool01(_c(df, "ER_presentation")).alias("er"),
        cells.map_multi(_c(df, "Complicating_factor"), vocab.COMPLICATING_FACTORS).alias("complicating"),
        cells.bool01(_c(df, "Bicuspid_aortic_valve")).alias("bav"),
        cells.parse_num(_c(df, "first_reported_diameter")).alias("first_diameter"),
        cells.parse_num(_c(df, "intervention_diameter")).alias("interv_diameter"),
        cells.known_labels([_c(df, "pathology_v1"), _c(df, "pathology_v2")], vocab.PATHOLOGY).alias("pathology"),
        F.array(*surgeries).alias("surgeries"),
        cells.bool01(_c(df, "underwent_reoperation")).alias("reop_flag"),
        cells.clean_free_text(_c(df, "reoperation indication")).alias("reop_indication"),
        cells.bool01(_c(df, "mortality")).alias("mortality"),
        cells.first_code_label(_c(df, "Causes_of_death"), vocab.CAUSE_OF_DEATH).alias("cause_of_death"),
        cells.comma_list(_c(df, "Icd10 Codes")).alias("icd10"),
        strip_or_null("Icd10 Codes").alias("icd10_raw"),
    )
    # second narrow pass: derived counts reuse the parsed structs
    n_surg = F.size(F.filter("surgeries", lambda s: s["present"]))
    return (out.withColumn("n_surg", n_surg)
            .withColumn("reop", F.when((F.col("reop_flag") == 1) | (F.col("n_surg") >= 2), 1).otherwise(0)))


def drop_identifiers(df: DataFrame, columns=vocab.IDENTIFIER_COLUMNS) -> DataFrame:
    """Drop direct identifier columns that exist."""
    return df.drop(*[c for c in columns if c in df.columns])


EVENTS = ("surg_1_date", "surg_2_date", "surg_3_date")


def with_event_ages(df: DataFrame, dob: str = "DOB", events=None) -> DataFrame:
    """P17 + P18: parse DOB and event dates, derive integer ages at each event.

    Adds ``{event}_age`` columns (NULL when unparsable or negative) and
    ``_rejected_dates`` (count of present-but-unparsable date cells per row; ``rejected_dates`` lists them).
    """
    events = events or [c for c in EVENTS if c in df.columns]
    out = df.withColumn("_dob_ts", cells.parse_date(F.col(dob)))
    rejected = F.when(_present(dob) & F.col("_dob_ts").isNull(), 1).otherwise(0)
    for e in events:
        age_name = e.replace("_date", "_age")
        out = out.withColumn(f"_{e}_ts", cells.parse_date(F.col(e)))
        out = out.withColumn(age_name, cells.age_at_event("_dob_ts", f"_{e}_ts").cast("double"))
        rejected = rejected + F.when(_present(e) & F.col(f"_{e}_ts").isNull(), 1).otherwise(0)
    return out.withColumn("_rejected_dates", rejected).drop("_dob_ts", *[f"_{e}_ts" for e in events])


def _present(c: str):
    return F.col(c).isNotNull()


def rejected_dates(df: DataFrame, columns=None) -> DataFrame:
    """(column, value, n): the present date cells that no format and no layout reads, counted."""
    columns = columns or [c for c in ("DOB", *EVENTS) if c in df.columns]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), cells.parse_date(F.col(c)).alias("ts")) for c in columns]))
    return (df.select(each.alias("x")).where(F.col("x.value").isNotNull() & F.col("x.ts").isNull())
            .groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n")))
