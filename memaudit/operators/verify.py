"""Card fidelity check — ten fields derived a second time from the raw, all-string rows, read back from
the rendered text, and compared (J10: joined on id, not by position).

The derivation here shares the fixed vocabularies and nothing else with the parsers and the renderer (``functions.cells``,
``operators.records``, ``operators.cards``): cells are trimmed, read as numbers, cut into codes and scrubbed in its own way,
so a fault of either side shows as a mismatch.

Defined results: a raw column that is absent counts as NULL; a record without a card, or a card without a record, is one
mismatch of the field ``Row``; a repeated id is compared with each card of that id; empty tables give no mismatch.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memaudit.functions import vocab

# (field name, line label in the card)
FIELDS = [
    ("Sex", "Sex"),
    ("Age", "Age at presentation"),
    ("Vital status", "Vital status"),
    ("BAV", "Bicuspid aortic valve"),
    ("Pathogenic Variant", "Pathogenic variant"),
    ("VUS", "VUS"),
    ("Complicating factors", "Complicating factors"),
    ("Number of surgeries", "Number of aortic surgeries recorded"),
    ("Underwent reoperation", "Underwent reoperation"),
    ("Reoperation Indication", "Indication"),
]

#: White space at the ends of a cell: the Unicode property and the four ASCII separators.
_EDGE = r"[\p{IsWhite_Space}\x1c-\x1f]+"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{_EDGE}|{_EDGE}\z", "")


def _number(trimmed: Column) -> Column:
    """The double that the whole cell spells; NULL for words, suffixes, hexadecimal digits, infinities."""
    last = F.right(trimmed, F.lit(1))
    plain = F.translate(trimmed, "0123456789+-.eE", "") == ""
    return F.when(plain & last.between("0", "9") | plain & (last == "."), trimmed.try_cast("double"))


def _yes(cell: Column) -> Column:
    t = _trim(cell)
    return F.coalesce(F.coalesce((_number(t) == 1.0), F.lower(t).isin(*vocab.TRUE_TOKENS)), F.lit(False))


def _labels(cell: Column, names: dict) -> Column:
    """The labels of the codes of a cell, each once, without ``None``, comma-joined; '' without any."""
    t = _trim(F.coalesce(cell, F.lit("")))
    number = _number(t)
    whole = (F.signum(number) * F.floor(F.abs(number))).try_cast("decimal(38,0)").cast("string")
    codes = F.when(number.isNotNull(), F.array(F.coalesce(whole, F.lit("")))).otherwise(F.split(t, r"[^0-9]+"))
    codes = F.transform(F.filter(codes, lambda c: c != ""), lambda c: F.when(c.startswith("-"), c).otherwise(
        F.when(F.ltrim(c, F.lit("0")) == "", F.lit("0")).otherwise(F.ltrim(c, F.lit("0")))))

    def label(code: Column) -> Column:
        out = F.concat(F.lit("Unknown("), code, F.lit(")"))
        for key, name in names.items():
            out = F.when(code == str(key), F.lit(name)).otherwise(out)
        return out

    each = F.aggregate(F.transform(codes, label), F.array().cast("array<string>"),
                       lambda seen, x: F.when((x == "None") | F.array_contains(seen, x), seen).otherwise(F.array_append(seen, x)))
    return F.concat_ws(", ", each)


def _scrubbed(cell: Column) -> Column:
    """Free text without dates and long numbers; '' where it says nothing."""
    t = _trim(F.coalesce(cell, F.lit("")))
    word = r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}]"
    out = t
    for body, tag in ((r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}", "[DATE]"), (r"\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{2,4}", "[DATE]"), (r"\p{Nd}{7,}", "[ID]")):
        out = F.regexp_replace(out, rf"(?<!{word}){body}(?!{word})", tag)
    out = F.regexp_replace(out, r"\p{IsWhite_Space}+", " ")
    return F.when(F.lower(t).isin(*vocab.BLANK_TEXT_TOKENS), "").otherwise(out)


def expected_fields(raw: DataFrame) -> DataFrame:
    """(patient_id, the ten fields): what the full card of each raw row must say; NULL where it must say nothing."""
    canon = {v: k for k, v in vocab.COLUMN_ALIASES.items()}

    def cell(name: str) -> Column:
        own = name if name in raw.columns else canon.get(name)
        if own not in raw.columns:
            return F.lit(None).cast("string")
        c = F.col(f"`{own}`").cast("string")
        return F.when(~c.isin(*vocab.NA_TOKENS), c)

    def surgery(n: int) -> Column:
        kind = _trim(cell(f"surg_{n}_type"))
        flags = [_yes(cell(f"surg_{n}_{flag}")) for flag in vocab.SURGERY_FLAGS if f"surg_{n}_{flag}" in raw.columns]
        named = F.coalesce(~kind.isin("", "nan", "NaN"), F.lit(False))
        return reduce(Column.__or__, flags, cell(f"surg_{n}_age").isNotNull() | named).cast("int")

    def or_else(text: Column, missing: str) -> Column:
        return F.when(F.coalesce(text, F.lit("")) == "", missing).otherwise(text)

    age = _number(_trim(cell("age")))
    years = (F.signum(age) * F.floor(F.abs(age))).try_cast("bigint").cast("string")
    n_surg = surgery(1) + surgery(2) + surgery(3)
    out = raw.select(
        "patient_id",
        F.coalesce(_trim(cell("Sex")), F.lit("Unknown")).alias("Sex"),
        F.coalesce(years, F.lit("Unknown")).alias("Age"),
        F.when(_yes(cell("mortality")), "Deceased").otherwise("Alive at last follow-up / not recorded as deceased").alias("Vital status"),
        F.when(_yes(cell("Bicuspid_aortic_valve")), "Yes").otherwise("No/Unknown").alias("BAV"),
        or_else(_trim(cell("Pathogenic Gene")), "None identified").alias("Pathogenic Variant"),
        or_else(_trim(cell("VUS Gene")), "None identified").alias("VUS"),
        or_else(_labels(cell("Complicating_factor"), vocab.COMPLICATING_FACTORS), "None recorded").alias("Complicating factors"),
        n_surg.cast("string").alias("Number of surgeries"),
        F.when(_yes(cell("underwent_reoperation")) | (n_surg >= 2), "Yes").otherwise("No/Unknown").alias("Underwent reoperation"),
        or_else(_scrubbed(cell("reoperation indication")), "Not recorded").alias("Reoperation Indication"))
    return out.withColumn("Reoperation Indication", F.when(F.col("Underwent reoperation") == "Yes", F.col("Reoperation Indication")))


def _actual(text: Column, label: str, digits_only: bool = False) -> Column:
    pat = r"(?d)- " + re.escape(label) + (r": (\d+)" if digits_only else r": (.*)")
    return F.when(text.rlike(pat), _trim(F.regexp_extract(text, pat, 1))).otherwise(F.lit("Not found"))


def _checks(text: Column) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("expected"),
                              _actual(text, label, name == "Number of surgeries").alias("actual")) for name, label in FIELDS])


def mismatches(raw: DataFrame, cards_df: DataFrame) -> DataFrame:
    """(patient_id, field, expected, actual) for every disagreeing field.

    ``raw``: the all-string rows with their ``patient_id``; ``cards_df``: (patient_id, text). A record without a card (or a
    card without a record) is reported once as field ``Row`` — the positional row-count check.
    """
    j = (expected_fields(raw).withColumn("_record", F.lit(True))
         .join(cards_df.select("patient_id", "text").withColumn("_card", F.lit(True)), "patient_id", "full_outer"))
    has_record, has_card = F.col("_record").isNotNull(), F.col("_card").isNotNull()
    row_check = F.struct(F.lit("Row").alias("field"), F.when(has_record, "record").otherwise("missing record").alias("expected"),
                         F.when(has_card, "record").otherwise("missing card").alias("actual"))
    text = F.coalesce("text", F.lit(""))
    exploded = j.select("patient_id", F.explode(F.when(has_record & has_card, _checks(text)).otherwise(F.array(row_check))).alias("c"))
    return (exploded.select("patient_id", "c.field", "c.expected", "c.actual")
            .filter(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("actual"))))


def fidelity_summary(raw: DataFrame, cards_df: DataFrame) -> DataFrame:
    """Per field: records checked and mismatches (0 mismatches = faithful cards)."""
    j = expected_fields(raw).join(cards_df.select("patient_id", "text"), "patient_id", "inner")
    ex = j.select(F.explode(_checks(F.coalesce("text", F.lit("")))).alias("c")).filter(F.col("c.expected").isNotNull())
    return ex.groupBy(F.col("c.field").alias("field")).agg(
        F.count(F.lit(1)).alias("n_checked"),
        F.count_if(F.col("c.expected") != F.col("c.actual")).alias("n_mismatch"))
