"""Record -> text card at four disclosure levels.

Each section is one Column builder taking the mode as a Python argument, so a
mode's card is a single ``concat_ws`` over section columns. ``all_cards``
renders the four modes in one narrow pass and explodes them (one scan, zero
shuffles). Shared pieces (surgery lines) are computed once as intermediate
columns so the expression tree stays well under codegen limits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memaudit.functions import cells

MODES = ("full", "partial", "coarsened", "exact")
TITLE = "Patient Summary"
_AAS_PREFIX = "Acute aortic syndrome: "


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _yes_no(c: Column, yes: str = "Yes", no: str = "No/Unknown") -> Column:
    return F.when(c == 1, F.lit(yes)).otherwise(F.lit(no))


def _age_value(mode: str) -> Column:
    """Age at presentation as rendered (exact: round 2; else truncated int)."""
    return cells.format_age(F.col("age"), mode)


def surgery_lines(mode: str) -> Column:
    """R1 (+R4 for coarsened): one rendered line per present surgery slot."""
    def line(s):
        age = s["age"]
        age_str = F.when(age.isNull(), F.lit("age unknown")).otherwise(
            F.concat(F.lit("age "), cells.format_age(age, "exact" if mode == "exact" else "full")))
        core = F.when(F.size(s["cats"]) > 0, F.array_join(s["cats"], ", ")).otherwise(
            F.lit("Aortic surgery (type unspecified)"))
        extras = F.concat_ws("; ", F.when(s["type"] != "", F.concat(F.lit("type: "), s["type"])),
                             F.when(s["other"] != "", F.concat(F.lit("other: "), s["other"])))
        extra_str = F.when(extras != "", F.concat(F.lit(" ("), extras, F.lit(")"))).otherwise(F.lit(""))
        text = F.concat(cells.ordinal(s["n"]), F.lit(" surgery ("), age_str, F.lit("): "), core, extra_str,
                        F.lit("."))
        if mode == "coarsened":
            bucket = cells.age_bucket(age.cast("bigint").cast("double"))
            text = F.regexp_replace(text, F.lit(r"\(age [^)]+\)"), F.concat(F.lit("(age "), bucket, F.lit(")")))
            text = F.replace(F.replace(text, F.lit("Aortic valve repair"), F.lit("Valve intervention")),
                             F.lit("Aortic valve replacement"), F.lit("Valve intervention"))
        return text
    return F.transform(F.filter("surgeries", lambda s: s["present"]), line)


def section_demographics(mode: str) -> Column:
    if mode == "coarsened":
        age = cells.age_bucket(F.col("age").cast("bigint").cast("double"))
    else:
        age = F.coalesce(_age_value(mode), F.lit("Unknown"))
    return _lines(F.lit("Demographics:"),
                  F.concat(F.lit("- Sex: "), F.coalesce(F.col("sex"), F.lit("Unknown"))),
                  F.concat(F.lit("- Age at presentation: "), age),
                  F.concat(F.lit("- Family history of aortic disease: "), _yes_no(F.col("fam_hx"))))


def section_genetics(mode: str) -> Column:
    pg, vg = F.coalesce(F.col("pathogenic_gene"), F.lit("")), F.coalesce(F.col("vus_gene"), F.lit(""))
    if mode == "coarsened":
        p, v = cells.presence(pg, "Present", "None identified"), cells.presence(vg, "Present", "None identified")
    else:
        p = F.when(pg != "", pg).otherwise(F.lit("None identified"))
        v = F.when(vg != "", vg).otherwise(F.lit("None identified"))
    return _lines(F.lit("Genetics:"), F.concat(F.lit("- Pathogenic variant: "), p),
                  F.concat(F.lit("- VUS: "), v))


def section_clinical(mode: str) -> Column:
    sites = F.col("aneurysm")
    aneurysm = F.when(F.size(sites) > 0, F.concat(F.lit("- Aneurysm involvement: "), F.array_join(sites, ", "))) \
        .otherwise(F.lit("- Aneurysm involvement: Unknown/Not recorded"))
    aas = F.col("aas")
    listed = F.transform(F.filter(aas, lambda a: a != "None"), lambda a: F.replace(a, F.lit(_AAS_PREFIX), F.lit("")))
    aas_line = F.when(F.exists(aas, lambda a: ~a.contains("None")),
                      F.concat(F.lit("- Acute aortic syndrome: "), F.array_join(listed, ", "))) \
        .otherwise(F.lit("- Acute aortic syndrome: None recorded"))
    parts = [F.lit("Clinical presentation:"), aneurysm, aas_line]
    if mode != "partial":
        cc = F.filter("complicating", lambda c: c != "None")
        shown = F.lit("- Complicating factors: Present") if mode == "coarsened" else \
            F.concat(F.lit("- Complicating factors: "), F.array_join(cc, ", "))
        parts += [F.concat(F.lit("- Initial ER presentation: "), _yes_no(F.col("er"))),
                  F.when(F.size(cc) > 0, shown).otherwise(F.lit("- Complicating factors: None recorded"))]
    return _lines(*parts)


def section_surgical(mode: str) -> Column:
    lines = F.col(f"_surg_{mode}")
    body = F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")) \
        .otherwise(F.lit("- No aortic surgery details recorded."))
    return _lines(F.lit("Surgical course:"),
                  F.concat(F.lit("- Number of aortic surgeries recorded: "), F.col("n_surg").cast("string")), body)


def section_reoperation(mode: str) -> Column:
    ind = F.col("reop_indication")
    shown = F.lit("- Indication: Progressive or residual aortic disease / other (coarsened)") \
        if mode == "coarsened" else F.concat(F.lit("- Indication: "), ind)
    yes = _lines(F.lit("- Underwent reoperation: Yes"),
                 F.when(ind != "", shown).otherwise(F.lit("- Indication: Not recorded")))
    return _lines(F.lit("Reoperation:"),
                  F.when(F.col("reop") == 1, yes).otherwise(F.lit("- Underwent reoperation: No/Unknown")))


def section_size(mode: str) -> Column:
    fmt = cells.diameter_bucket if mode == "coarsened" else cells.format_diameter
    return _lines(F.lit("Aortic size:"),
                  F.concat(F.lit("- First reported diameter: "), fmt(F.col("first_diameter"))),
                  F.concat(F.lit("- Diameter at intervention: "), fmt(F.col("interv_diameter"))))


def section_pathology(mode: str) -> Column:
    labels = F.col("pathology")
    shown = F.lit("- Pathology reported: Yes (coarsened)") if mode == "coarsened" else \
        F.concat(F.lit("- Findings: "), F.array_join(labels, ", "))
    return _lines(F.lit("Histopathology:"), F.when(F.size(labels) > 0, shown).otherwise(F.lit("- Not recorded")))


def section_valve(mode: str) -> Column:
    v = _yes_no(F.col("bav"), "Present", "Not recorded/absent") if mode == "coarsened" else _yes_no(F.col("bav"))
    return _lines(F.lit("Valve anatomy:"), F.concat(F.lit("- Bicuspid aortic valve: "), v))


def section_billing(mode: str) -> Column:
    codes = F.col("icd10")
    if mode == "coarsened":
        codes = cells.coarsen_codes(codes)
    return _lines(F.lit("Billing/Diagnoses:"),
                  F.when(F.size(codes) > 0, F.concat(F.lit("- ICD-10 Codes: "), F.array_join(codes, ", ")))
                  .otherwise(F.lit("- ICD-10 Codes: None recorded")))


def section_outcome(mode: str) -> Column:
    cod = F.col("cause_of_death")
    dead = _lines(F.lit("- Vital status: Deceased"),
                  F.concat(F.lit("- Cause of death category: "),
                           F.when(cod != "", cod).otherwise(F.lit("Unknown"))))
    return _lines(F.lit("Outcome:"), F.when(F.col("mortality") == 1, dead).otherwise(
        F.lit("- Vital status: Alive at last follow-up / not recorded as deceased")))


def card_text(mode: str) -> Column:
    """The card for one mode; partial omits the post-surgery sections."""
    if mode not in MODES:
        raise ValueError(mode)
    secs = [F.lit(TITLE), section_demographics(mode), section_genetics(mode), section_clinical(mode),
            section_surgical(mode)]
    if mode != "partial":
        secs += [section_reoperation(mode), section_size(mode), section_pathology(mode), section_valve(mode),
                 section_billing(mode)]
    secs.append(section_outcome(mode))
    return cells.py_strip(F.concat_ws("\n\n", *secs))


def meta(mode_col: Column) -> Column:
    """Card metadata struct."""
    return F.struct(F.col("patient_id").alias("patient_id"), mode_col.alias("mode"), F.col("sex").alias("sex"),
                    F.col("pathogenic_gene").alias("pathogenic_gene"), F.col("vus_gene").alias("vus_gene"),
                    F.col("reop_flag").alias("underwent_reoperation"), F.col("mortality").alias("mortality"),
                    F.col("icd10_raw").alias("icd10_codes"))


def with_surgery_lines(records: DataFrame, modes=MODES) -> DataFrame:
    """Shared per-mode surgery lines as intermediate columns (full/partial share one)."""
    out = records
    for m in modes:
        out = out.withColumn(f"_surg_{m}", surgery_lines(m))
    return out


def cards(records: DataFrame, modes=MODES) -> DataFrame:
    """(meta, text, mode) for every record and mode — one pass, then explode."""
    base = with_surgery_lines(records, modes)
    packed = F.array(*[F.struct(F.lit(m).alias("mode"), card_text(m).alias("text")) for m in modes])
    exploded = base.select("*", F.explode(packed).alias("_card"))
    return exploded.select(meta(F.col("_card.mode")).alias("meta"), F.col("_card.text").alias("text"),
                           F.col("_card.mode").alias("mode"))


def card(records: DataFrame, mode: str) -> DataFrame:
    """One mode only: (patient_id, text)."""
    base = with_surgery_lines(records, (mode,))
    return base.select("patient_id", card_text(mode).alias("text"))


# ------------------------------------------------------------------ reading cards back
def section(text, name: str) -> Column:
    """``{name}:`` up to the next blank line or end of text; '' when absent."""
    t = cells.col(text)  # found by position: a pattern would look for the blank line at every character
    at = F.instr(t, name + ":")
    return F.when(t.isNotNull(), F.when(at > 0, cells.py_strip(F.substring_index(F.substr(t, at), "\n\n", 1))).otherwise(F.lit("")))


def field(text, label: str) -> Column:
    """Single-line field value ``- {label}: (.*)``; '' when absent."""
    return F.regexp_extract(cells.col(text), r"(?d)- " + re.escape(label) + r": (.*)", 1)
