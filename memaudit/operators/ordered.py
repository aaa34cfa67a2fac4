"""Prefix sums over ordered distinct values, without ever ordering more than a bounded number of them in one task.

The values of a group are dealt to ranges until no range holds more than ``bound`` of them: a range that does is cut at its own
approximate quantiles, as many as its size asks for, and this is repeated. The cuts only route values, so their accuracy has no
influence on the result, only on the number of rounds (each divides a range by up to ``FAN``; 10^12 values need three rounds). Where every
group fits the bound from the start nothing is cut. The table of ranges, one row per range, gives each range its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memaudit.session import materialize

#: Distinct values that one task orders, at most.
BOUND = 1 << 20
FAN = 256


def ranged(values: DataFrame, keys: list[str], value: str, bound: int = BOUND, fan: int = FAN) -> DataFrame:
    """``values`` (distinct within ``keys``) with the column ``_path``: ranges are in the order of their paths, and none holds
    more than ``bound`` rows. A range is cut into at most ``fan`` at a time."""
    t = values.withColumn("_path", F.array().cast("array<int>"))
    while True:
        sizes = t.groupBy(*keys, "_path").agg(F.count(F.lit(1)).alias("_size"))
        most = sizes.agg(F.max("_size")).first()[0] or 0
        if most <= bound:
            return t
        cuts = min(fan, 2 * -(-most // bound))
        probs = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
        full = sizes.where(F.col("_size") > bound).select(*keys, "_path")
        at = t.join(full, [*keys, "_path"], "left_semi").groupBy(*keys, "_path").agg(F.percentile_approx(value, probs, 8 * FAN).alias("_cuts"))
        below = F.size(F.filter("_cuts", lambda x: x < F.col(value)))
        t = t.join(at, [*keys, "_path"], "left").withColumn("_path", F.concat("_path", F.array(F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)))).drop("_cuts")
        t = materialize(t, "ranges")


def offsets(t: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, _path, _total, _before): the weight of each range and of all ranges before it; one row per range."""
    totals = t.groupBy(*keys, "_path").agg(F.sum(weight).alias("_total"))
    ahead = Window.partitionBy(*keys).orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum("_total").over(ahead), F.lit(0)))


def prefix_sums(t: DataFrame, ranges: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """The rows of ``t`` that lie in ``ranges``, with the weight of all smaller values of their group as the column ``name``."""
    inside = Window.partitionBy(*keys, "_path").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = t.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return summed.join(ranges, [*keys, "_path"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before", "_total", "_path")


def weighted(values: DataFrame, keys: list[str], value: str, **sums: Column) -> DataFrame:
    """One row per distinct value of each group with the sums asked for, written once: the ranges are found by reading it."""
    known = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return materialize(known, "distinct-values")
