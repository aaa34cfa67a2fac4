"""Mixing sources to target weights by repetition rates.

Sizes are added up per source; each source's target follows from its weight, no more than ``MAX_RATE`` times its size,
and what is cut off is shared among the others by weight until no source is above. A source's rate is its target over its
size; each document is emitted floor(rate) times, and once more if its hash-seeded uniform number is below the
fraction. Documents meet the per-source rates by a join on the source that Spark may split or broadcast by size.

Defined results: the size of a null or empty text is 0; a null source is a source of its own, last in order; sources are
ranked by code point and weigh 1, 2, 3, repeating; the uniform number depends on the seed, the document's id, source
and text only, so reruns agree and equal rows fare alike; a source without a word has rate 0, so its (empty) documents
are not emitted; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memaudit.llm.common import WORD, fresh, quoted
from memaudit.session import materialize

MAX_RATE, SEED = 3, "mix-1"
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)


def text_size(text: Column) -> Column:
    """The number of white-space words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) of the distinct ``source`` by code point, null last, without one task for all sources.

    Sources are dealt by ranges, counted within a range, and a range begins after the sources of those before it. The
    dealt table is written first, so all that is read of it agrees."""
    dealt = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("part").count()
    offsets = counts.select("part", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("own", own).join(offsets, "part").withColumn("rank", F.col("own") + F.coalesce("before", F.lit(0))).drop("part", "own", "before")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, cut at ``MAX_RATE`` times the size.

    Each round shares what the cut-off sources leave among the others by weight; a source once cut stays so, as
    every round's share of one weight is larger than the last."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    weighed = materialize(ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * MAX_RATE), "weights")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, cut = 0.0, -1
    while True:
        above = F.col("most") < F.lit(share) * F.col("weight") if cut >= 0 else F.lit(False)
        now = weighed.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)).alias("used"),
                          F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if now["n"] == cut:
            break
        cut, share = now["n"], (total - now["used"]) / now["weight"] if now["weight"] else share
    return weighed.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(float(share)) * F.col("weight")).alias("target"))


def uniform(*parts: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the parts."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (renamed where ``docs`` has such columns)."""
    size, sizes, target, copies, key = fresh(docs, "size", "source_size", "target", "copies", "source_key")
    sized = docs.withColumn(size, text_size(quoted(text).cast("string")))
    sums = sized.groupBy(quoted(source).cast("string").alias("source")).agg(F.sum(size).alias("source_size"))
    shares = targets(sums).select(F.col("source").alias(key), F.col("source_size").alias(sizes), F.col("target").alias(target))
    joined = sized.join(shares, quoted(source).cast("string").eqNullSafe(F.col(key)))
    rate = F.when(F.col(sizes) > 0, F.col(target) / F.col(sizes)).otherwise(F.lit(0.0))
    drawn = uniform(quoted(id_col), quoted(source), F.md5(quoted(text).cast("string").cast("binary")), seed=seed) < rate - F.floor(rate)
    return joined.withColumn(copies, F.floor(rate).cast("long") + drawn.cast("long")).drop(key)


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed rows: each document as often as its copies say, with the columns of ``docs``."""
    copies = fresh(docs, "size", "source_size", "target", "copies")[3]
    out = mixed(docs, id_col, text, source, seed)
    return out.where(F.col(copies) > 0).withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*[quoted(c) for c in docs.columns])
