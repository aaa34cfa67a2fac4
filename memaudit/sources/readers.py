"""Readers for the audit's file formats.

All readers declare schemas (no inference) so the scans push down projections
and never run an extra inference pass over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memaudit.operators import metrics

# ---------------------------------------------------------------- schemas
META = T.StructType([T.StructField(n, t) for n, t in [
    ("patient_id", T.StringType()), ("mode", T.StringType()), ("sex", T.StringType()),
    ("pathogenic_gene", T.StringType()), ("vus_gene", T.StringType()),
    ("underwent_reoperation", T.IntegerType()), ("mortality", T.IntegerType()), ("icd10_codes", T.StringType())]])
CARD = T.StructType([T.StructField("meta", META), T.StructField("text", T.StringType())])
PROMPT = T.StructType([T.StructField(n, T.StringType()) for n in
                       ("prompt_id", "patient_id", "split", "rarity_group", "prompt_text", "target_text",
                        "target_icd10_raw")])
PREDICTION = T.StructType([*[T.StructField(n, T.StringType()) for n in
                             ("prompt_id", "patient_id", "split", "rarity_group", "target_text", "target_icd10")],
                           T.StructField("generations", T.ArrayType(T.StringType())),
                           T.StructField("injection_count", T.IntegerType()),
                           T.StructField("model_id", T.StringType())])
CHAT = T.StructType([T.StructField("messages", T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])
SPLITS = T.StructType([*[T.StructField(n, T.StringType()) for n in ("patient_id", "split", "rarity_group")],
                       *[T.StructField(n, T.DoubleType()) for n in ("I_gen", "I_phen", "I_traj", "I_total")],
                       T.StructField("k_full", T.LongType())])


def _cp1252_c1_table() -> tuple[str, str]:
    """Latin-1 decoded C1 bytes -> their cp1252 characters, built from the codec itself."""
    src, dst = [], []
    for b in range(0x80, 0xA0):
        try:
            ch = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            continue  # undefined in cp1252: left as the Latin-1 control character
        src.append(chr(b))
        dst.append(ch)
    return "".join(src), "".join(dst)


_C1_SRC, _C1_DST = _cp1252_c1_table()


def cp1252_fix(c: Column) -> Column:
    """The CSV reader cannot decode cp1252; read as ISO-8859-1 and map the C1 range."""
    return F.translate(c, _C1_SRC, _C1_DST)


def read_cohort_csv(spark: SparkSession, path: str, encoding: str = "cp1252", row_ids: str | None = None, prefix: str = "row_") -> DataFrame:
    """Header CSV, quoted multi-line cells, every column a string (typed later by conform). A large file is read by
    many tasks (``csv_records``). ``row_ids`` names a column of ids by position in the files."""
    from memaudit.sources.csv_records import read_csv
    df = read_csv(spark, path, encoding, "_row" if row_ids else None)
    return df.withColumn(row_ids, F.concat(F.lit(prefix), F.col("_row").cast("string"))).drop("_row") if row_ids else df


def scan_position() -> Column:
    """Where a row of a file scan stands: struct(file, block, at). It orders the rows of all files by path and place, however
    the files are split and whichever task reads them (``at`` only tells apart rows of one block, which one task reads)."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Card JSONL (meta struct + text); mode from the file name when meta lacks it."""
    df = spark.read.schema(CARD).json(path).withColumn("_order", scan_position())
    mode = F.coalesce(F.col("meta.mode"), F.nullif(F.regexp_extract("_order.file", r"(?:cards_|mode=)([a-z]+)(?:\.jsonl)?", 1), F.lit("")))
    return df.select("meta", "text", mode.alias("mode"), F.col("_order.file").alias("_file"), "_order")


def last_wins(df: DataFrame, keys: list[str], order: str = "_order") -> DataFrame:
    """S2 duplicate ids: keep the last line per key, in the order of the files and of their lines (one aggregate)."""
    cols = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*cols), F.col(order))
    return df.groupBy(*keys).agg(packed.alias("_r")).select(*keys, "_r.*")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """S3: prompt JSONL (general, gene, size, icd10, canary)."""
    return spark.read.schema(PROMPT).json(path)


def read_predictions(spark: SparkSession, path: str,
                     name_pattern: str = r"([^/]+?)_(gene|size|icd10)?_?predictions\.jsonl$") -> DataFrame:
    """Prediction JSONL files; model and attack come from the file name; missing
    files are simply not matched by the glob. A line that is no JSON fails the read
    (``malformed_lines`` lists such lines), so no generation is lost unseen."""
    df = (spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)
          .withColumn("_file", F.col("_metadata.file_path")))
    return df.withColumn("model", F.regexp_extract("_file", name_pattern, 1)).withColumn(
        "attack", F.nullif(F.regexp_extract("_file", name_pattern, 2), F.lit("")))


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType = PREDICTION) -> DataFrame:
    """(file, line) of the lines that do not parse; their count is what a skipping reader would lose."""
    bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    parsed = F.from_json("line", bad, {"mode": "PERMISSIVE"})
    return lines.filter(parsed["_corrupt_record"].isNotNull())


def read_splits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Split table, projected to what the joins need."""
    reader = spark.read.schema(SPLITS)
    df = reader.parquet(path) if fmt == "parquet" else reader.option("header", True).csv(path)
    return df


#: Types of the archived metric columns; others stay strings.
METRICS = {"collapse_score": "double", "combo_score": "double", "reconstruction_score": "double", "exact_match_score": "double", "auc": "double", "n_generations": "bigint"}


def read_metrics_csv(spark: SparkSession, path: str, relabel: dict[str, str] | None = None) -> DataFrame:
    """S6 + J7: archived metric CSV, scores as numbers; model labels remapped with fallback to the original."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    known = [c for c in METRICS if c in df.columns]
    df = df.select(*[F.expr(f"try_cast(`{c}` AS {METRICS[c]}) AS `{c}`") if c in known else F.col(f"`{c}`") for c in df.columns])
    if relabel:
        df = metrics.relabel(df, relabel)
    return df


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Chat training JSONL (blank lines are skipped by the JSON reader)."""
    return spark.read.schema(CHAT).json(path)


def read_single_object(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object per file (pretty-printed) -> one row."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def with_file_row_ids(scan: DataFrame, prefix: str = "row_", name: str = "patient_id") -> DataFrame:
    """Positional ids for a file scan: the rows of all files, in the order of path and place, are numbered from 0.

    The ids depend on the files alone: a prefix sum over the table of blocks (file, block, rows), one file's blocks at a time
    and then the files. ``scan`` is a reader's DataFrame before any filter."""
    tagged = scan.withColumn("_at", scan_position())
    block = ["_file", "_block"]
    tagged = tagged.select(*scan.columns, F.col("_at.file").alias("_file"), F.col("_at.block").alias("_block"), F.col("_at.at").alias("_at"))
    counts = tagged.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    files = counts.groupBy("_file").agg(F.sum("_n").alias("_all"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("_file", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    placed = tagged.join(counts.join(files, "_file").select(*block, "_first", (F.col("_before") + F.col("_skip")).alias("_skip")), block)
    return placed.select(*scan.columns, F.concat(F.lit(prefix), (F.col("_skip") + F.col("_at") - F.col("_first")).cast("string")).alias(name))


def with_row_ids(df: DataFrame, prefix: str = "row_") -> DataFrame:
    """Positional ids of any table in the order of its partitions (of a file scan: ``with_file_row_ids``), without a
    single-partition window over rows: per-partition offsets from a (small) count per partition."""
    pid = F.spark_partition_id()
    tagged = df.withColumn("_pid", pid).withColumn("_mono", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = counts.select("_pid", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    j = tagged.join(offs, "_pid")
    idx = F.col("_off") + F.col("_mono") - F.col("_m0")
    return j.withColumn("patient_id", F.concat(F.lit(prefix), idx.cast("string"))).drop("_pid", "_mono", "_m0", "_off")
