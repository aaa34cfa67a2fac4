"""Stand-in for the raw record table, derived from the driver's TPC-H-like tables.

One record per customer (id ``row_{c_custkey}``); its wide, all-string columns
(demographics, genetics, coded phenotype lists, three surgery column groups,
diameters, pathology, reoperation, outcome, billing codes) are derived from the
customer's orders and the lineitems of all of them. Every value is a
deterministic function of the tables, so the SQL oracle below reproduces it.

Plan shape: orders are pre-aggregated per customer (partial + final hash
aggregate, skew-safe for hot customers), lineitem codes are pre-aggregated per
customer (distinct codes of a bounded vocabulary), then equi-joins on keys. Only
``nation``/``region`` are broadcast: fixed-size dimensions (25 and 5 rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memaudit.plans.tables import table

SLOTS = (1, 2, 3)
# surgery flag columns the stand-in defines (others are absent, as a CSV may omit them)
STANDIN_FLAGS = ["aortic_root_replacement", "ascending_aorta_replacement", "TEVAR",
                 "aortic_valve_replacement", "stage_I_elephant_trunk"]


def _orders_by_customer(orders: DataFrame) -> DataFrame:
    prio = F.substring("o_orderpriority", 1, 1).cast("int")
    st = F.col("o_orderstatus")
    aggs = [F.count(F.lit(1)).alias("n_orders"),
            F.array_sort(F.collect_set(F.when(st == "F", prio))).alias("f_prios"),
            F.count_if(st == "P").alias("p_count"),
            F.count_if(st == "O").alias("o_count"),
            F.min("o_orderkey").alias("first_orderkey"),
            F.min("o_orderdate").alias("first_date"),
            F.max("o_totalprice").alias("max_price")]
    for n in SLOTS:
        aggs += [F.min(F.when(prio == n, F.col("o_orderdate"))).alias(f"d{n}"),
                 F.count_if(prio == n).alias(f"c{n}"),
                 F.count_if((prio == n) & (st == "F")).alias(f"f{n}"),
                 F.count_if((prio == n) & (st == "O")).alias(f"o{n}"),
                 F.count_if((prio == n) & (st == "P")).alias(f"p{n}")]
    return orders.groupBy("o_custkey").agg(*aggs)


def _codes_by_customer(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct codes over all line items of a customer's orders (a bounded vocabulary, combined map-side)."""
    letter = F.substring(F.lit("IQZ"), (F.col("l_partkey") % 3 + 1).cast("int"), 1)
    digits = F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0")
    code = F.when(F.col("l_linenumber") == 1, F.concat(letter, digits)).otherwise(
        F.concat(letter, digits, F.lit("."), (F.col("l_partkey") % 10).cast("string"),
                 F.col("l_linenumber").cast("string")))
    lines = lineitem.select("l_orderkey", code.alias("code")).join(
        orders.select("o_orderkey", F.col("o_custkey").alias("code_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return (lines.groupBy("code_custkey")
            .agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("icd")))


def raw_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide record table, every column a string (as read from the CSV)."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    oa = _orders_by_customer(table(spark, sf_dir, "orders"))
    codes = _codes_by_customer(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), table(spark, sf_dir, "orders"))

    geo = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
                      .select("n_nationkey", "n_name", "r_name"))
    base = (customer.join(geo, customer.c_nationkey == geo.n_nationkey, "left")
            .join(oa, customer.c_custkey == oa.o_custkey, "left")
            .join(codes, customer.c_custkey == codes.code_custkey, "left"))

    ck = F.col("c_custkey")
    n_orders = F.coalesce(F.col("n_orders"), F.lit(0))
    s = lambda x: F.lit(x)
    age = F.floor((F.col("c_acctbal") + 1000) / 37.5) / 4
    first_d = 30 + F.floor((F.col("c_acctbal") + 1000) / 250) / 2

    cols = {
        "patient_id": F.concat(s("row_"), ck.cast("string")),
        "Sex": F.when(ck % 50 == 7, F.lit(None)).when(F.col("c_nationkey") % 2 == 0, s("F")).otherwise(s("M")),
        "age": age.cast("string"),
        "fam_hx": F.when(ck % 4 == 0, s("yes")).when(ck % 4 == 1, s("1.0")).when(ck % 4 == 2, F.lit(None))
                   .otherwise(s("0")),
        "Pathogenic Gene": F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.col("n_name")),
        "VUS Gene": F.when(F.col("c_mktsegment") == "BUILDING", F.col("r_name")),
        "Icd10 Codes": F.col("icd"),
        "Aneurysm_involvement": F.when(n_orders <= 8, s("1")).when(n_orders <= 11, s("2")).otherwise(s("1, 2")),
        "Acute_aortic_syndrome": F.when(n_orders >= 16, s("2 (type B)")).when(n_orders <= 4, s("0, 4"))
                                  .otherwise(s("0")),
        "Complicating_factor": F.when(F.col("o_count") >= 7, s("2, 3")).when(F.col("o_count") == 0, s("7"))
                                .otherwise(s("0")),
        "Bicuspid_aortic_valve": F.when(F.col("c_nationkey") % 5 == 0, s("TRUE")).otherwise(s("0")),
        "ER_presentation": F.when(n_orders % 2 == 0, s("1")).otherwise(s("0")),
        # every fifth of the records without an intervention diameter reports no diameter at all
        "first_reported_diameter": F.when(ck % 20 == 19, F.lit(None)).otherwise(first_d.cast("string")),
        "intervention_diameter": F.when(ck % 4 == 3, F.lit(None))
                                  .otherwise((first_d + (n_orders % 12) / 2.0).cast("string")),
        "pathology_v1": F.when(n_orders % 4 == 0, s("1, 9")).when(n_orders % 4 == 1, s("25"))
                         .when(n_orders % 4 == 2, s("4 (focal)")),
        "pathology_v2": F.when(F.col("max_price") > 400000, s("9, 10")),
        "underwent_reoperation": F.when(n_orders % 5 == 0, s("true")).otherwise(s("0")),
        "reoperation indication": F.when(n_orders % 3 == 0, F.concat(s("Residual dissection, see "),
                                                                     F.col("c_name"))),
        "mortality": F.when(ck % 9 == 0, s("1")).otherwise(s("0")),
        "Causes_of_death": F.when(ck % 9 == 0, ((F.floor(ck / 9) % 3) + 1).cast("string")),
    }
    for n in SLOTS:
        c, f, o, p, d = (F.col(f"{x}{n}") for x in "cfopd")
        present = c >= 2
        yrs = F.floor(F.datediff(d, F.col("first_date")) / 365.25)
        cols.update({
            f"surg_{n}_age": F.when(present, (age + yrs).cast("string")),
            f"surg_{n}_aortic_root_replacement": F.when(present & (f > 0) & (n == 1), s("1")).otherwise(s("0")),
            f"surg_{n}_ascending_aorta_replacement": F.when(present, s("yes")),
            f"surg_{n}_TEVAR": F.when(present & (p >= 2) & (n == 3), s("Y")).otherwise(s("0")),
            f"surg_{n}_aortic_valve_replacement": F.when(present & (c >= 4), s("1.0")),
            f"surg_{n}_stage_I_elephant_trunk": F.when(present & (f >= 2) & (n == 2), s("1")),
            f"surg_{n}_type": F.when(c >= 3, F.concat(s("Redo on "), F.date_format(d, "yyyy-MM-dd"),
                                                        s(" ref "), (ck * 1000003).cast("string"))),
            f"surg_{n}_others": F.when(c >= 4, s("graft 28 mm")),
        })
    return base.select(*[v.alias(k) for k, v in cols.items()])


# --------------------------------------------------------------------------- oracle
def cohort_sql() -> str:
    """DuckDB CTE text (``raw_cohort AS (...)``) producing the same strings."""
    surg = []
    for n in SLOTS:
        surg.append(f"""
      CASE WHEN c{n} >= 2 THEN CAST(age_d + floor(datediff('day', first_date, d{n}) / 365.25) AS VARCHAR) END AS "surg_{n}_age",
      CASE WHEN c{n} >= 2 AND f{n} > 0 AND {n} = 1 THEN '1' ELSE '0' END AS "surg_{n}_aortic_root_replacement",
      CASE WHEN c{n} >= 2 THEN 'yes' END AS "surg_{n}_ascending_aorta_replacement",
      CASE WHEN c{n} >= 2 AND p{n} >= 2 AND {n} = 3 THEN 'Y' ELSE '0' END AS "surg_{n}_TEVAR",
      CASE WHEN c{n} >= 2 AND c{n} >= 4 THEN '1.0' END AS "surg_{n}_aortic_valve_replacement",
      CASE WHEN c{n} >= 2 AND f{n} >= 2 AND {n} = 2 THEN '1' END AS "surg_{n}_stage_I_elephant_trunk",
      CASE WHEN c{n} >= 3 THEN 'Redo on ' || strftime(d{n}, '%Y-%m-%d') || ' ref ' || CAST(c_custkey * 1000003 AS VARCHAR) END AS "surg_{n}_type",
      CASE WHEN c{n} >= 4 THEN 'graft 28 mm' END AS "surg_{n}_others\"""")
    slot_aggs = []
    for n in SLOTS:
        slot_aggs.append(f"""
      min(o_orderdate) FILTER (WHERE prio = {n}) AS d{n},
      count(*) FILTER (WHERE prio = {n}) AS c{n},
      count(*) FILTER (WHERE prio = {n} AND o_orderstatus = 'F') AS f{n},
      count(*) FILTER (WHERE prio = {n} AND o_orderstatus = 'O') AS o{n},
      count(*) FILTER (WHERE prio = {n} AND o_orderstatus = 'P') AS p{n}""")
    return f"""
oa AS (
  SELECT o_custkey, count(*) AS n_orders,
      list_sort(list_distinct(list(prio) FILTER (WHERE o_orderstatus = 'F'))) AS f_prios,
      count(*) FILTER (WHERE o_orderstatus = 'P') AS p_count,
      count(*) FILTER (WHERE o_orderstatus = 'O') AS o_count,
      min(o_orderkey) AS first_orderkey, min(o_orderdate) AS first_date, max(o_totalprice) AS max_price,
      {",".join(slot_aggs)}
  FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio FROM orders) o
  GROUP BY o_custkey
),
codes AS (
  SELECT o_custkey, string_agg(DISTINCT code, ', ' ORDER BY code) AS icd
  FROM (SELECT o_custkey,
          CASE WHEN l_linenumber = 1
               THEN substr('IQZ', CAST(l_partkey % 3 + 1 AS INTEGER), 1) || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0')
               ELSE substr('IQZ', CAST(l_partkey % 3 + 1 AS INTEGER), 1) || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0')
                    || '.' || CAST(l_partkey % 10 AS VARCHAR) || CAST(l_linenumber AS VARCHAR) END AS code
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) li
  GROUP BY o_custkey
),
cbase AS (
  SELECT c.*, n.n_name, r.r_name, oa.*, codes.icd,
         coalesce(oa.n_orders, 0) AS n_ord,
         floor((c_acctbal + 1000) / 37.5) / 4 AS age_d,
         30 + floor((c_acctbal + 1000) / 250) / 2 AS first_d
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN oa ON c.c_custkey = oa.o_custkey
  LEFT JOIN codes ON c.c_custkey = codes.o_custkey
),
raw_cohort AS (
  SELECT 'row_' || CAST(c_custkey AS VARCHAR) AS patient_id,
      CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS "Sex",
      CAST(age_d AS VARCHAR) AS age,
      CASE WHEN c_custkey % 4 = 0 THEN 'yes' WHEN c_custkey % 4 = 1 THEN '1.0' WHEN c_custkey % 4 = 2 THEN NULL ELSE '0' END AS fam_hx,
      CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN n_name END AS "Pathogenic Gene",
      CASE WHEN c_mktsegment = 'BUILDING' THEN r_name END AS "VUS Gene",
      icd AS "Icd10 Codes",
      CASE WHEN n_ord <= 8 THEN '1' WHEN n_ord <= 11 THEN '2' ELSE '1, 2' END AS "Aneurysm_involvement",
      CASE WHEN n_ord >= 16 THEN '2 (type B)' WHEN n_ord <= 4 THEN '0, 4' ELSE '0' END AS "Acute_aortic_syndrome",
      CASE WHEN o_count >= 7 THEN '2, 3' WHEN o_count = 0 THEN '7' ELSE '0' END AS "Complicating_factor",
      CASE WHEN c_nationkey % 5 = 0 THEN 'TRUE' ELSE '0' END AS "Bicuspid_aortic_valve",
      CASE WHEN n_ord % 2 = 0 THEN '1' ELSE '0' END AS "ER_presentation",
      CASE WHEN c_custkey % 20 <> 19 THEN CAST(first_d AS VARCHAR) END AS first_reported_diameter,
      CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE CAST(first_d + (n_ord % 12) / 2.0 AS VARCHAR) END AS intervention_diameter,
      CASE WHEN n_ord % 4 = 0 THEN '1, 9' WHEN n_ord % 4 = 1 THEN '25' WHEN n_ord % 4 = 2 THEN '4 (focal)' END AS pathology_v1,
      CASE WHEN max_price > 400000 THEN '9, 10' END AS pathology_v2,
      CASE WHEN n_ord % 5 = 0 THEN 'true' ELSE '0' END AS underwent_reoperation,
      CASE WHEN n_ord % 3 = 0 THEN 'Residual dissection, see ' || c_name END AS "reoperation indication",
      CASE WHEN c_custkey % 9 = 0 THEN '1' ELSE '0' END AS mortality,
      CASE WHEN c_custkey % 9 = 0 THEN CAST(((c_custkey // 9) % 3) + 1 AS VARCHAR) END AS "Causes_of_death",
      {",".join(surg)}
  FROM cbase
)"""
