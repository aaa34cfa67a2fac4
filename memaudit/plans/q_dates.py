"""Date scrub query (P17, P18, P19, K6 shape) on the orders table.

Stand-in: per order, a date of birth = order date minus (20 + custkey mod 50) years and an
event date = the order date, each rendered in one of the audited formats (ISO, M/d/yyyy,
M/d/yy, ISO with time) or an unparsable token, chosen from the order key. The query parses
them back, derives the integer age at the event, counts rejected cells, and drops the
identifier columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from memaudit.operators import records
from memaudit.plans.registry import register
from memaudit.plans.tables import table

SPARK_FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "yyyy-MM-dd HH:mm:ss"]
DUCK_FORMATS = ["%Y-%m-%d", "%-m/%-d/%Y", "%-m/%-d/%y", "%Y-%m-%d %H:%M:%S"]


def _render(d, sel):
    out = F.lit("unknown")
    for i, fmt in reversed(list(enumerate(SPARK_FORMATS))):
        out = F.when(sel == i, F.date_format(d, fmt)).otherwise(out)
    return out


def dated_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    dob = F.add_months(F.to_date("o_orderdate"), -12 * (20 + F.col("o_custkey") % 50).cast("int"))
    return o.select(F.col("o_orderkey").alias("order_key"),
                    _render(dob, F.col("o_orderkey") % 5).alias("DOB"),
                    _render(F.to_date("o_orderdate"), F.floor(F.col("o_orderkey") / 5) % 4).alias("surg_1_date"))


def _duck_render(d: str, sel: str) -> str:
    whens = " ".join(f"WHEN {sel} = {i} THEN strftime({d}, '{f}')" for i, f in enumerate(DUCK_FORMATS))
    return f"CASE {whens} ELSE 'unknown' END"


def _duck_parse(s: str) -> str:
    return (f"coalesce(try_strptime({s}, '%Y-%m-%d'), try_strptime({s}, '%Y-%m-%d %H:%M:%S'), "
            f"CASE WHEN regexp_full_match({s}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime({s}, '%m/%d/%Y') END, "
            f"CASE WHEN regexp_full_match({s}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') THEN try_strptime({s}, '%m/%d/%y') END)")


AGES_SQL = f"""
WITH d AS (
  SELECT o_orderkey AS order_key,
         {_duck_render("CAST(o_orderdate AS DATE) - to_years(CAST(20 + o_custkey % 50 AS INTEGER))", "o_orderkey % 5")} AS dob_s,
         {_duck_render("CAST(o_orderdate AS DATE)", "(o_orderkey // 5) % 4")} AS ev_s
  FROM orders
),
p AS (SELECT order_key, dob_s, ev_s, {_duck_parse('dob_s')} AS dob, {_duck_parse('ev_s')} AS ev FROM d),
a AS (SELECT *, floor(epoch(ev - dob) / 86400) AS days FROM p)
SELECT order_key,
       CAST(CASE WHEN days >= 0 THEN floor(days / 365.25) END AS DOUBLE) AS surg_1_age,
       CAST(dob IS NULL AND dob_s IS NOT NULL AS INTEGER) + CAST(ev IS NULL AND ev_s IS NOT NULL AS INTEGER) AS rejected_dates
FROM a"""


@register("event_ages", AGES_SQL)
def q_event_ages(spark, sf_dir):
    """P17 + P18 + P19: multi-format date parsing (Python's two-digit-year pivot), integer
    age at the event over whole elapsed days (NULL if negative or unparsable), rejected-cell
    count, and the direct identifier columns dropped."""
    df = records.with_event_ages(dated_orders(spark, sf_dir))
    return records.drop_identifiers(df).withColumnRenamed("_rejected_dates", "rejected_dates")


# ------------------------------------------------------------------ three events, and cells that only the generic parser reads
ALL_SPARK = [*SPARK_FORMATS, "MMM d, yyyy", "d MMMM yyyy", "MM.dd.yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'"]
DAYS_LATER = {"surg_1_date": 0, "surg_2_date": 400, "surg_3_date": 900}


def _any_format(d, sel):
    out = F.lit("unknown")
    for i, fmt in reversed(list(enumerate(ALL_SPARK))):
        out = F.when(sel == i, F.date_format(d, fmt)).otherwise(out)
    return out


def _known(d: str, sel: str) -> str:
    """The date that a cell in format ``sel`` states: two-digit years pivot at 69, the last choice is no date."""
    yy = f"(year({d}) % 100)"
    short = f"make_date(CASE WHEN {yy} >= 69 THEN 1900 + {yy} ELSE 2000 + {yy} END, month({d}), day({d}))"
    return f"CASE WHEN {sel} = 2 THEN {short} WHEN {sel} < {len(ALL_SPARK)} THEN {d} END"


N_CHOICES = len(ALL_SPARK) + 1
ALL_AGES_SQL = f"""
WITH d AS (
  SELECT o_orderkey AS order_key, {_known("CAST(CAST(o_orderdate AS DATE) - to_years(CAST(20 + o_custkey % 50 AS INTEGER)) AS DATE)", f"(o_orderkey % {N_CHOICES})")} AS dob,
         {", ".join(f'{_known(f"(CAST(o_orderdate AS DATE) + {days})", f"((o_orderkey // {N_CHOICES} + {i}) % {N_CHOICES})")} AS ev{i}' for i, days in enumerate(DAYS_LATER.values()))}
  FROM orders)
SELECT order_key, {", ".join(f"CAST(CASE WHEN ev{i} >= dob THEN floor((ev{i} - dob) / 365.25) END AS DOUBLE) AS surg_{i + 1}_age" for i in range(3))},
       CAST(dob IS NULL AS INTEGER) + {" + ".join(f"CAST(ev{i} IS NULL AS INTEGER)" for i in range(3))} AS rejected_dates
FROM d"""


def all_dated_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    dob = F.add_months("d", -12 * (20 + F.col("o_custkey") % 50).cast("int"))
    chosen = F.floor(F.col("o_orderkey") / N_CHOICES)
    events = [_any_format(F.date_add("d", days), (chosen + i) % N_CHOICES).alias(e) for i, (e, days) in enumerate(DAYS_LATER.items())]
    return o.select(F.col("o_orderkey").alias("order_key"), _any_format(dob, F.col("o_orderkey") % N_CHOICES).alias("DOB"), *events)


@register("event_ages_all", ALL_AGES_SQL)
def q_event_ages_all(spark, sf_dir):
    """P17 + P18 + P19 for all event columns, cells in eight layouts (named formats, month names, dots, zoned clock) or none."""
    df = records.with_event_ages(all_dated_orders(spark, sf_dir))
    return records.drop_identifiers(df).withColumnRenamed("_rejected_dates", "rejected_dates")


REJECTED_SQL = f"""SELECT "column", 'unknown' AS value, count(*) AS n FROM (
  SELECT 'DOB' AS "column" FROM orders WHERE o_orderkey % {N_CHOICES} = {N_CHOICES - 1}
  UNION ALL {" UNION ALL ".join(f"SELECT '{e}' FROM orders WHERE (o_orderkey // {N_CHOICES} + {i}) % {N_CHOICES} = {N_CHOICES - 1}" for i, e in enumerate(DAYS_LATER))})
GROUP BY "column" """


@register("rejected_dates", REJECTED_SQL)
def q_rejected_dates(spark, sf_dir):
    """The date cells that nothing reads, by column and value."""
    return records.rejected_dates(all_dated_orders(spark, sf_dir))
