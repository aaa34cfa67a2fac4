"""Summaries over per-record scores.

Everything here aggregates already-scored per-record rows: partial + final hash
aggregates, pivots with explicit value lists (no extra distinct job), and the
rank-based AUC computed on the distinct (model, score) table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memaudit.functions import vocab
from memaudit.functions import text as T
from memaudit.operators import ordered


def mean_by(df: DataFrame, keys: list[str], values: list[str], train_only: bool = True) -> DataFrame:
    """Mean scores per group (train split only by default; NULL keys dropped like pandas)."""
    d = df.filter(F.col("split") == "train") if train_only else df
    for k in keys:
        d = d.filter(F.col(k).isNotNull())
    return d.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def pivot_mean(df: DataFrame, index: list[str], pivot: str, pivot_values: list[str], value: str,
               digits: int = 3) -> DataFrame:
    """rows = index, columns = pivot values, cells = mean(value) rounded."""
    p = df.groupBy(*index).pivot(pivot, pivot_values).agg(F.avg(value))
    return p.select(*index, *[F.round(F.col(v), digits).alias(v) for v in pivot_values])


def pivot_means(df: DataFrame, index: list[str], pivot: str, pivot_values: list[str], values: dict[str, str]) -> DataFrame:
    """A13 for several measures: cell ``{name}_{pivot value}`` is the mean of the measure ``values[name]``."""
    return df.groupBy(*index).agg(*[F.avg(F.when(F.col(pivot) == v, F.col(c))).alias(f"{name}_{v}")
                                    for name, c in values.items() for v in pivot_values])


def relabel(df: DataFrame, labels: dict[str, str], column: str = "model") -> DataFrame:
    """``column`` by the map ``labels``; what the map lacks keeps its value."""
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(column, F.coalesce(F.try_element_at(m, F.col(column)), F.col(column)))


def regime_overview(scores: DataFrame) -> DataFrame:
    """(epoch_regime, model) -> train means of the three scores, and AUC over train and test."""
    means = mean_by(scores, ["epoch_regime", "model"], ["collapse_score", "combo_score", "reconstruction_score"])
    keyed = scores.withColumn("_key", F.struct("epoch_regime", "model"))
    auc = membership_auc(keyed, "_key").select("_key.epoch_regime", "_key.model", "auc")
    return means.join(auc, ["epoch_regime", "model"])


def regime_by_stratum(scores: DataFrame) -> DataFrame:
    """(epoch_regime, model, rarity_group) -> train records and the means of the three scores."""
    return scores.filter(F.col("split") == "train").groupBy("epoch_regime", "model", "rarity_group").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("collapse_score", "combo_score", "reconstruction_score")])


def membership_auc(df: DataFrame, group: str = "model", label: Column | None = None,
                   score: str = "reconstruction_score", bound: int = ordered.BOUND) -> DataFrame:
    """ROC AUC of ``score`` for label (train=1, test=0) per group, with
    mid-ranks for ties (Mann-Whitney). NULL when a group has a single class.

    Exact and skew-safe: scores are first reduced to the distinct (group, score)
    table with positive/negative counts, written once. The running count of negatives below each
    score is a prefix sum over ranges of at most ``bound`` distinct scores (``ordered``)."""
    lab = label if label is not None else (F.col("split") == "train")
    d = df.select(F.col(group).alias("_g"), F.col(score).alias("_s"), lab.cast("int").alias("_y")).where(F.col("_g").isNotNull())
    per = ordered.ranged(ordered.weighted(d, ["_g"], "_s", _pos=F.col("_y").cast("double"), _neg=(1 - F.col("_y")).cast("double")), ["_g"], "_s", bound)
    per = ordered.prefix_sums(per, ordered.offsets(per, ["_g"], "_neg"), ["_g"], "_s", "_neg", "_below")
    tot = per.groupBy("_g").agg(F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0))).alias("_u"),
                                F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return tot.select(F.col("_g").alias(group), F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                                       F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))


def paired_tables(success: DataFrame, pairs: list[tuple[str, str]], models: list[str],
                  keys: list[str] | None = None) -> DataFrame:
    """A25 + J6: 2x2 counts per model pair over the patients present for *every* model.

    ``success``: (model, patient_id, success 0/1 [, keys...]). One pivot with explicit
    values (one shuffle); common patients = no NULL cell. Cells follow the
    table[not a][not b] layout: n_both, n_only_a, n_only_b, n_neither."""
    keys = keys or []
    wide = success.groupBy(*keys, "patient_id").pivot("model", models).agg(F.max("success"))
    common = F.lit(True)
    for m in models:
        common = common & F.col(m).isNotNull()
    wide = wide.filter(common)
    cells = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), (F.col(a) == 1).alias("sa"),
                               (F.col(b) == 1).alias("sb")) for a, b in pairs])
    one = wide.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")
    sa, sb = F.col("sa"), F.col("sb")
    out = one.groupBy(*keys, "model_a", "model_b").agg(
        F.count_if(sa & sb).alias("n_both"), F.count_if(sa & ~sb).alias("n_only_a"),
        F.count_if(~sa & sb).alias("n_only_b"), F.count_if(~sa & ~sb).alias("n_neither"))
    return out.withColumn("p_value", mcnemar_exact(F.col("n_only_a"), F.col("n_only_b")))


def _stirling_rest(x: Column) -> Column:
    """ln(x!) minus its leading Stirling terms, exact to a double from x = 20 on."""
    return sum((F.lit(c) / F.pow(x, F.lit(float(k))) for k, c in ((3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680))), F.lit(1 / 12) / x)


def mcnemar_exact(b: Column, c: Column, direct: int = 1000) -> Column:
    """Exact two-sided McNemar p = min(1, 2·P[Bin(b+c, 1/2) <= min(b, c)]).

    With m = min(b, c) up to ``direct`` the terms are added upwards in log space by the
    ratio C(n,k) = C(n,k-1)·(n-k+1)/k. Beyond, the largest term (k = m) comes from
    Stirling's series and the terms below it are added downwards; after 7·sqrt(n) of them the
    rest is below 1e-40 of the sum, so a row holds an array of that many numbers,
    not of m. n = 0 gives p = 1."""
    n, m = (b + c).cast("double"), F.least(b, c).cast("bigint")
    few = F.least(m, F.lit(direct))
    start = F.struct((-n * F.lit(math.log(2.0))).alias("lt"), F.exp(-n * F.lit(math.log(2.0))).alias("s"))

    def up(acc, k):
        lt = acc["lt"] + F.log(n - k + 1) - F.log(k.cast("double"))
        return F.struct(lt.alias("lt"), (acc["s"] + F.exp(lt)).alias("s"))
    ks = F.when(few >= 1, F.sequence(F.lit(1).cast("bigint"), few)).otherwise(F.array().cast("array<bigint>"))
    low = F.aggregate(ks, start, up, lambda acc: acc["s"])

    md = m.cast("double")
    x = (n - 2 * md) / n
    log_top = (-n / 2 * ((1 - x) * F.log1p(-x) + (1 + x) * F.log1p(x)) + F.log(n / (F.lit(2 * math.pi) * md * (n - md))) / 2
               + _stirling_rest(n) - _stirling_rest(md) - _stirling_rest(n - md))
    steps = F.least(m, F.ceil(7 * F.sqrt(n)))
    js = F.when(m > direct, F.sequence(F.lit(1).cast("bigint"), steps)).otherwise(F.array().cast("array<bigint>"))

    def down(acc, j):
        r = acc["r"] * (md - j + 1) / (n - md + j)
        return F.struct(r.alias("r"), (acc["s"] + r).alias("s"))
    high = F.exp(log_top) * F.aggregate(js, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("s")), down, lambda acc: acc["s"])
    total = F.when(m > direct, high).otherwise(low)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))


def code_summary(best: DataFrame) -> DataFrame:
    """Per model — N, mean recall/precision/F1, count & share with recall > 0, >= 0.5, = 1."""
    r = F.col("recall")
    n = F.count(F.lit(1))
    out = best.groupBy("model").agg(n.alias("n"), F.avg("recall").alias("avg_recall"),
                                    F.avg("precision").alias("avg_precision"), F.avg("f1").alias("avg_f1"),
                                    F.count_if(r > 0).alias("n_any"), F.count_if(r >= 0.5).alias("n_ge50"),
                                    F.count_if(r >= 1.0).alias("n_perfect"))
    return out.select("*", *[(F.col(c) / F.col("n")).alias(c.replace("n_", "share_")) for c in
                             ("n_any", "n_ge50", "n_perfect")])


def _codes_counted(best: DataFrame, by: Callable[[Column], Column], name: str) -> DataFrame:
    """(model, ``name``, gt_n, match_n): the ground-truth codes and the matched ones, counted together: ``best`` is made once."""
    def each(codes: str, gt: int) -> Column:
        return F.transform(codes, lambda c: F.struct(by(c).alias(name), F.lit(gt).alias("gt"), F.lit(1 - gt).alias("match")))
    rows = best.select("model", F.explode(F.concat(each("gt", 1), each("matched", 0))).alias("c")).groupBy("model", f"c.{name}")
    return rows.agg(F.sum("c.gt").alias("gt_n"), F.sum("c.match").alias("match_n")).filter(F.col("gt_n") > 0)


def recall_by_chapter(best: DataFrame) -> DataFrame:
    """Per model and chapter (first letter): GT code count, matched count, ratio, label."""
    j = _codes_counted(best, lambda c: F.upper(F.substring(c, 1, 1)), "chapter")
    labels = F.create_map(*[x for k, v in vocab.CODE_CHAPTERS.items() for x in (F.lit(k), F.lit(v))])
    return j.select("model", "chapter", F.coalesce(F.try_element_at(labels, F.col("chapter")), F.lit("Unknown"))
                    .alias("label"), "gt_n", "match_n", (F.col("match_n") / F.col("gt_n")).alias("recall"))


def recall_by_code(best: DataFrame, min_support: int = 1) -> DataFrame:
    """Per model and 3-char code: GT count, matched count (counts codes, not
    patients), recall; HAVING gt_n >= min_support (F8)."""
    j = _codes_counted(best, T.code3, "code3").filter(F.col("gt_n") >= min_support)
    return j.select("model", "code3", "gt_n", "match_n", (F.col("match_n") / F.col("gt_n")).alias("recall"))


def clinical_codes(by_code: DataFrame) -> DataFrame:
    """J8 + F8: the 3-char codes that have a clinical label and at least one ground-truth code, with label and chapter."""
    def look_up(labels: dict, key: Column) -> Column:
        return F.try_element_at(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]), key)
    code = F.col("code3")
    out = by_code.withColumn("label", look_up(vocab.CLINICAL_LABELS, code)).withColumn(
        "chapter", F.coalesce(look_up(vocab.CODE_CHAPTERS, F.substring(code, 1, 1)), F.lit("Other")))
    return out.filter(F.col("label").isNotNull() & (F.col("gt_n") > 0))


def recall_by_gt_size(best: DataFrame, cap: int = 6) -> DataFrame:
    """Per model and GT-size bucket (1..5, '6+'): total, any recall, >= 50 %, 100 %."""
    n = F.size("gt")
    bucket = F.when(n < cap, n.cast("string")).otherwise(F.lit(f"{cap}+"))
    r = F.col("recall")
    return best.groupBy("model", bucket.alias("gt_size")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(r > 0).alias("any"), F.count_if(r >= 0.5).alias("ge50"),
        F.count_if(r >= 1.0).alias("perfect"))


def success_rates(success: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Successes and rate per model (optionally per extra keys, e.g. gene or split)."""
    keys = ["model", *(by or [])]
    return success.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("success").alias("successes"),
                                      F.try_divide(F.sum("success"), F.count(F.lit(1))).alias("rate"))


def split_success(success: DataFrame) -> DataFrame:
    """Per model, successes and rates on train vs test (n = 0 guarded)."""
    tr, te = F.col("split") == "train", F.col("split") == "test"
    s = F.col("success") == 1
    out = success.groupBy("model").agg(F.count_if(tr).alias("n_train"), F.count_if(tr & s).alias("s_train"),
                                       F.count_if(te).alias("n_test"), F.count_if(te & s).alias("s_test"))
    return out.select("*", F.try_divide(F.col("s_train"), F.col("n_train")).alias("rate_train"),
                      F.try_divide(F.col("s_test"), F.col("n_test")).alias("rate_test"))


def memorization_threshold(curve: DataFrame, rate: str = "size_any_rate") -> DataFrame:
    """First injection count whose rate is non-zero (NULL if never)."""
    return curve.agg(F.min(F.when(F.col(rate) > 0, F.col("injection_count"))).alias("threshold"))
