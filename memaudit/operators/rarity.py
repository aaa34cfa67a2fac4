"""Record rarity: profile frequencies, surprisal, k-anonymity, strata, stratified split.

Scale notes
-----------
* Profiles are counted with one hash aggregate on the full profile (partial
  aggregation map-side, so a profile holding a third of all rows costs one
  combined row per task, not a hot reducer). The three axis counts, N and the
  quantiles are re-aggregations of that distinct-profile table.
* Scores are a function of the profile, so they are computed once per distinct
  profile and joined back to the records by the profile's key, two longs per axis.
  Fewer than ``HOT`` common profiles (a proven bound) are broadcast; the others
  meet the records by a shuffle without a hot key.
* Quantiles are exact: distinct ``I_total`` values lie in ranges of bounded size,
  range totals tell which holds the wanted rank, and only that range is ordered.
* The split ranks records inside (stratum, hash bucket) groups only; a prefix
  sum over the bucket-count table (at most strata x 16^hex rows, a proven
  bound) supplies each bucket's offset, so no stratum lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memaudit.functions import cells
from memaudit.operators import ordered
from memaudit.session import materialize


# ------------------------------------------------------------------ profiles (typed records)
def _sorted_without_none(c: Column) -> Column:
    return F.array_sort(F.filter(c, lambda x: x != "None"))


def cohort_profiles(records: DataFrame) -> DataFrame:
    """Typed records (see ``records.conform``) -> (patient_id, gen, phen, traj).

    gen  = (pathogenic gene, VUS gene), missing -> 'None'
    phen = (sorted aneurysm sites, sorted AAS labels, sorted complicating factors, BAV)
    traj = (surgery count, sorted categories over present surgeries, reoperation)
    """
    gen = F.struct(F.coalesce("pathogenic_gene", F.lit("None")).alias("pg"),
                   F.coalesce("vus_gene", F.lit("None")).alias("vg"))
    phen = F.struct(_sorted_without_none(F.col("aneurysm")).alias("aneurysm"),
                    _sorted_without_none(F.col("aas")).alias("aas"),
                    _sorted_without_none(F.col("complicating")).alias("comp"),
                    F.col("bav").alias("bav"))
    cats = F.array_sort(F.flatten(F.transform(
        F.filter("surgeries", lambda s: s["present"]), lambda s: F.array_sort(s["cats"]))))
    traj = F.struct(F.col("n_surg").alias("n_surg"), cats.alias("cats"), F.col("reop").alias("reop"))
    return records.select("patient_id", gen.alias("gen"), phen.alias("phen"), traj.alias("traj"))


# ------------------------------------------------------------------ frequencies and scores
#: A profile is common if it holds more than one record in this many; so there are fewer than this many common ones.
HOT = 1000


def axis_keys(axis: str) -> list[str]:
    """The two numbers that stand for a profile axis in counts, scores and joins."""
    return [f"{axis}_a", f"{axis}_b"]


def keyed_profiles(profiles: DataFrame, axes=("gen", "phen", "traj")) -> DataFrame:
    """The profile dictionary's keys on every record: 128 bits of each axis, as two longs, next to the axis itself."""
    return profiles.select("*", *[F.xxhash64(*seed, axis).alias(k) for axis in axes for k, seed in zip(axis_keys(axis), ([], [F.lit(axis)]))])


def profile_counts(profiles: DataFrame, axes=("gen", "phen", "traj")) -> DataFrame:
    """One row per distinct full profile with its class size ``k_full``."""
    return profiles.groupBy(*axes).agg(F.count(F.lit(1)).alias("k_full"))


def key_counts(keyed: DataFrame, axes=("gen", "phen", "traj")) -> DataFrame:
    """A2 / A7 on keys: (two longs per axis, ``k_full``); a key that two profiles share ends the job."""
    by = [k for axis in axes for k in axis_keys(axis)]
    same = F.lit(True)
    for axis in axes:
        same &= F.min(axis).eqNullSafe(F.max(axis))
    counted = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("k_full"), same.alias("_same"))
    return counted.select(*by, F.when(F.col("_same"), F.col("k_full")).otherwise(F.raise_error(F.lit("two profiles have one key")).cast("bigint")).alias("k_full"))


def score_profiles(counts: DataFrame, axes=("gen", "phen", "traj")) -> DataFrame:
    """Surprisal per axis ``-log10(count/N)`` and ``I_total`` (axes added in order), for counts by axis or by axis keys."""
    n = counts.agg(F.sum("k_full").cast("double")).scalar()  # uncorrelated scalar subquery
    out = counts.withColumn("N", n)
    for a in axes:
        by = [a] if a in counts.columns else axis_keys(a)
        ac = counts.groupBy(*by).agg(F.sum("k_full").alias(f"cnt_{a}"))
        out = out.join(ac, by)
    total = None
    for a in axes:
        out = out.withColumn(f"I_{a}", -F.log10(F.col(f"cnt_{a}") / F.col("N")))
        total = F.col(f"I_{a}") if total is None else total + F.col(f"I_{a}")
    return out.withColumn("I_total", total)


def exact_quantiles(df: DataFrame, value: str, weight: Column, probs, ranges: int = ordered.FAN, bound: int = ordered.BOUND) -> DataFrame:
    """One row with the column ``q``: the exact linear-interpolation quantiles of ``value`` counted ``weight`` times.

    Distinct values lie in ranges of at most ``bound`` values; the totals of the ranges tell which of them hold a
    wanted rank, and only those are ordered."""
    per = ordered.ranged(ordered.weighted(df.select(F.col(value).alias("_v"), weight.alias("_k")), [], "_v", _w=F.col("_k")), [], "_v", bound, ranges)
    spans = ordered.offsets(per, [], "_w")
    n = spans.agg(F.sum("_total")).scalar()

    def rank(p: float) -> Column:
        return (n - 1) * F.lit(float(p))

    ends = [f(rank(p)) for p in probs for f in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for r in ends:
        wanted |= (r >= F.col("_before")) & (r < F.col("_before") + F.col("_total"))
    held = spans.where(wanted)  # at most two ranges for each of the few ranks
    found = ordered.prefix_sums(per.join(held.select("_path"), "_path", "left_semi"), held, [], "_v", "_w", "_below")

    def at_rank(r: Column) -> Column:
        return F.max(F.when((r >= F.col("_below")) & (r < F.col("_below") + F.col("_w")), F.col("_v")))

    row = found.select("_v", "_w", "_below").agg(F.max(n).alias("_n"), *[at_rank(r).alias(f"_e{i}") for i, r in enumerate(ends)])
    parts = [((F.col("_n") - 1) * F.lit(float(p))) - F.floor((F.col("_n") - 1) * F.lit(float(p))) for p in probs]
    return row.select(F.array(*[F.col(f"_e{2 * i}") + (F.col(f"_e{2 * i + 1}") - F.col(f"_e{2 * i}")) * x for i, x in enumerate(parts)]).alias("q"))


def total_quantiles(scored: DataFrame, probs=(0.75, 0.95)) -> DataFrame:
    """Exact linear-interpolation quantiles of I_total over records (one row)."""
    row = exact_quantiles(scored, "I_total", F.col("k_full"), probs)
    return row.select(*[F.col("q")[i].alias(f"p{int(round(p * 100))}") for i, p in enumerate(probs)])


def assign_stratum(k: Column, i_total: Column, p75: Column, p95: Column) -> Column:
    """k<=2 or I>=p95 -> ultra_rare; k<=5 or I>=p75 -> rare; else common."""
    return (F.when((k <= 2) | (i_total >= p95), "ultra_rare")
            .when((k <= 5) | (i_total >= p75), "rare").otherwise("common"))


def rarity_scores(profiles: DataFrame, axes=("gen", "phen", "traj"),
                  axis_names=("I_gen", "I_phen", "I_traj"), cut_lineage: bool = True) -> DataFrame:
    """Records with profiles -> (patient_id, rarity_group, I_*, I_total, k_full).

    A record's profile travels as two longs per axis (``keyed_profiles``). The key table feeds the counts and the join
    back; with ``cut_lineage`` it is written once to the checkpoint folder so the upstream record derivation runs once.

    The join back: a profile of more than one record in ``HOT`` is one of fewer than ``HOT`` profiles, so those scores are sent to the
    records and a common profile is not shuffled at all; the rest meet by a shuffle in which no key has more than that share.
    """
    keyed = keyed_profiles(profiles.select("patient_id", *axes), axes)
    if cut_lineage:
        keyed = materialize(keyed, "profiles")
    by = [k for axis in axes for k in axis_keys(axis)]
    # N, quantiles, strata and the join back all read this table of distinct profiles: written once
    scored = materialize(score_profiles(key_counts(keyed, axes), axes), "profile-scores")
    q = total_quantiles(scored).select(F.array("p75", "p95")).scalar()  # one subquery, reused
    strata = scored.withColumn("rarity_group", assign_stratum(F.col("k_full"), F.col("I_total"), q[0], q[1]))
    strata = strata.select(*by, "N", "rarity_group", *[F.col(f"I_{a}").alias(nm) for a, nm in zip(axes, axis_names)], "I_total", "k_full")
    common = F.col("k_full") * HOT > F.col("N")
    ids = keyed.select("patient_id", *by)
    hot = F.broadcast(strata.where(common))
    few, many = ids.join(hot, by), ids.join(F.broadcast(strata.where(common).select(*by)), by, "left_anti").join(strata.where(~common), by)
    return few.unionByName(many).drop(*by, "N")


# ------------------------------------------------------------------ stratified split
def stratified_split(df: DataFrame, id_col: str, stratum_col: str, test_frac: float = 0.2,
                     seed: int = 42, bucket_hex: int = 4) -> DataFrame:
    """Exact per-stratum test size ``max(1, int(test_frac*n))`` (0 when n == 1).

    Records are ordered inside a stratum by ``md5(seed:id)`` (then id); the first
    ``n_test`` are test. Ranking is done within (stratum, md5-prefix bucket) and
    offset by the bucket's prefix count, so work spreads over 16^bucket_hex groups.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keyed = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, bucket_hex))
    bc = keyed.groupBy(stratum_col, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    w_all = Window.partitionBy(stratum_col)
    w_run = w_all.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("_bn").over(w_all)
    n_test = F.when(n == 1, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(test_frac)))).cast("bigint")
    bc = bc.select(stratum_col, "_b", F.coalesce(F.sum("_bn").over(w_run), F.lit(0)).alias("_before"),
                   n_test.alias("_ntest"))
    rn = F.row_number().over(Window.partitionBy(stratum_col, "_b").orderBy("_h", id_col))
    ranked = keyed.join(F.broadcast(bc), [stratum_col, "_b"]).withColumn("_rank", F.col("_before") + rn)
    return (ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_ntest"), "test").otherwise("train"))
            .drop("_h", "_b", "_before", "_ntest", "_rank"))


def splits_table(profiles: DataFrame, seed: int = 42, cut_lineage: bool = True) -> DataFrame:
    """patient_id, split, rarity_group, I_gen, I_phen, I_traj, I_total, k_full."""
    scored = rarity_scores(profiles, cut_lineage=cut_lineage)
    out = stratified_split(scored, "patient_id", "rarity_group", 0.2, seed)
    return out.select("patient_id", "split", "rarity_group", "I_gen", "I_phen", "I_traj", "I_total", "k_full")


# ------------------------------------------------------------------ descriptive aggregates
def value_frequency(df: DataFrame, key: str) -> DataFrame:
    """A1: frequency of non-blank scalar values."""
    return (df.filter(~cells.is_blank(key)).groupBy(cells.py_strip(F.col(key)).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def frequency_bands(counts: DataFrame, count_col: str = "n") -> DataFrame:
    """A4: distinct values and how many occur once, twice, 3-5 times, more than 5."""
    c = F.col(count_col)
    return counts.agg(F.count(F.lit(1)).alias("n_distinct"),
                      F.count_if(c == 1).alias("n_once"), F.count_if(c == 2).alias("n_twice"),
                      F.count_if((c >= 3) & (c <= 5)).alias("n_3_5"), F.count_if(c > 5).alias("n_gt5"))


def describe(df: DataFrame, c: str, probs=(0.5, 0.75, 0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """Count, mean, sample std, min, percentiles (linear), max."""
    x = F.col(c)
    moments = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                     F.min(x).alias("min"), F.max(x).alias("max"))
    q = exact_quantiles(df, c, F.lit(1), probs)
    row = moments.withColumn("_q", q.scalar())
    return row.select("count", "mean", "std", "min",
                      *[F.col("_q")[i].alias(f"p{int(round(p * 100))}") for i, p in enumerate(probs)], "max")


def k_anonymity_shares(scores: DataFrame, limits=(1, 2, 5)) -> DataFrame:
    """Records in classes of at most ``limits`` records, and their share of all records (one row)."""
    k = F.col("k_full")
    out = scores.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(k <= x).alias(f"n_k{x}") for x in limits])
    return out.select("*", *[F.try_divide(f"n_k{x}", "n").alias(f"share_k{x}") for x in limits])


def group_shares(df: DataFrame, key: str) -> DataFrame:
    """A10: value counts with their share of all rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(key, "n", (F.col("n") / total).alias("share"))


def trajectory_signature(records: DataFrame) -> Column:
    """A3: (surgery count, sorted categories, sorted complications, sorted AAS, mortality)."""
    cats = F.array_sort(F.flatten(F.transform(
        F.filter("surgeries", lambda s: s["present"]), lambda s: F.array_sort(s["cats"]))))
    return F.struct(F.col("n_surg").alias("surg_count"), cats.alias("surg_cats"),
                    _sorted_without_none(F.col("complicating")).alias("complications"),
                    _sorted_without_none(F.col("aas")).alias("aas"), F.col("mortality").alias("mortality"))


def rare_flags(records: DataFrame, gene_threshold: int = 2, traj_threshold: int = 2) -> DataFrame:
    """A5: records with a rare gene (pathogenic or VUS freq <= t), a rare trajectory
    signature (freq <= t), both, and either (inclusion-exclusion).

    Records are first counted per (genes, signature), then the counts of each key are
    joined to these classes and weigh by their size (no per-key window; a record without
    a gene gets a key of its signature, so that the missing ones do not meet in one task)."""
    base = records.select(F.nullif("pathogenic_gene", F.lit("")).alias("pg"),
                          F.nullif("vus_gene", F.lit("")).alias("vg"),
                          trajectory_signature(records).alias("sig"))
    base = base.withColumn("sa", F.xxhash64("sig")).withColumn("sb", F.xxhash64(F.lit("sig"), "sig"))
    one = F.when(F.min("sig").eqNullSafe(F.max("sig")), F.count(F.lit(1))).otherwise(F.raise_error(F.lit("two signatures have one key")).cast("bigint"))
    classes = base.groupBy("pg", "vg", "sa", "sb").agg(one.alias("size"))
    own = F.concat(F.lit("\u0000"), F.col("sa").cast("string"))  # partner of no gene
    classes = classes.withColumn("pk", F.coalesce("pg", own)).withColumn("vk", F.coalesce("vg", own))
    pc = classes.filter(F.col("pg").isNotNull()).groupBy("pk").agg(F.sum("size").alias("pfreq"))
    vc = classes.filter(F.col("vg").isNotNull()).groupBy("vk").agg(F.sum("size").alias("vfreq"))
    sc = classes.groupBy("sa", "sb").agg(F.sum("size").alias("tfreq"))
    j = classes.join(pc, "pk", "left").join(vc, "vk", "left").join(sc, ["sa", "sb"])
    rg = F.coalesce(F.col("pfreq") <= gene_threshold, F.lit(False)) | \
        F.coalesce(F.col("vfreq") <= gene_threshold, F.lit(False))
    rt = F.col("tfreq") <= traj_threshold

    def records_where(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0))
    agg = j.agg(records_where(F.lit(True)).alias("n"), records_where(rg).alias("n_rare_gene"),
                records_where(rt).alias("n_rare_traj"), records_where(rg & rt).alias("n_both"))
    return agg.withColumn("n_either", F.col("n_rare_gene") + F.col("n_rare_traj") - F.col("n_both"))
