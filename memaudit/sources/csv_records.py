"""Parallel scan of CSV files whose quoted cells hold line feeds (S1), and positional ids from file order.

A quoted line feed does not end a record, so a reader that starts inside a file does not know whether it is inside quotes. The
reader here finds out by a prefix scan: each block of a file (what one split covers) is summarised by its number of quote characters and by
the number of records that begin in it, once as if it began outside quotes and once as if inside. A prefix sum over
the small table of blocks tells every block which of the two holds, and how many records begin before it. Lines that are a
whole record stay where they are; only the lines of records that span several lines are brought together, by a
shuffle on (file, record). Records are then parsed by the built-in CSV expression.

Quoting is RFC 4180's: cells that hold quotes, separators or line feeds are quoted, and a quote inside is doubled. (A bare quote
inside an unquoted cell has no meaning there; ``multiLine`` reads such files, one task a file.) Lines end with a line feed or
with carriage return and line feed; where a file's first line ends with both, both are read as one line feed everywhere in
it, as the built-in reader does, else a carriage return is a character. Records without any character are skipped.

``row`` numbers the records of all files from 0, files in the order of their paths, headers not counted: it depends on the
files alone, not on how they are split or dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memaudit.sources.readers import cp1252_fix

OPTIONS = {"escape": '"', "quote": '"'}


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, block, at, line): ``at`` orders the lines of a block, whichever task reads it."""
    raw = spark.read.option("lineSep", "\n").text(path)
    text = F.col("value") if encoding.lower() in ("utf-8", "utf8") else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"), text.alias("line"))


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, record, text): the records of each file, numbered from 1 in its own order (the header is record 1)."""
    block = ["file", "block"]
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    before = Window.partitionBy(*block).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # within one split
    lines = _lines(spark, path, encoding).withColumn("quotes", quotes)
    lines = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    filled = ~F.col("line").isin("", "\r")
    blocks = lines.groupBy(*block).agg(F.sum("quotes").alias("quotes"), F.count_if(filled & ~F.col("odd")).alias("outside"), F.count_if(filled & F.col("odd")).alias("inside"),
                                         F.min_by(F.col("line").endswith("\r"), "at").alias("cr"))

    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # blocks of one file
    blocks = blocks.withColumn("within", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    begun = F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside"))
    blocks = blocks.withColumn("skip", F.coalesce(F.sum(begun).over(earlier), F.lit(0)))
    blocks = blocks.select(*block, "within", "skip", F.first("cr").over(Window.partitionBy("file").orderBy("block")).alias("cr"))

    joined = lines.join(blocks, block)
    starts = F.col("odd") == F.col("within")  # an even number of quotes stands before the line
    upto = Window.partitionBy(*block).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = joined.withColumn("starts", starts).withColumn("record", F.col("skip") + F.sum((F.col("starts") & filled).cast("long")).over(upto))
    numbered = numbered.where(~F.col("starts") | filled)  # an empty line within quotes belongs to its cell
    numbered = numbered.withColumn("line", F.when(F.col("cr"), F.regexp_replace("line", r"\r\z", "")).otherwise(F.col("line")))
    alone = F.col("starts") & (F.col("quotes") % 2 == 0)
    pieces = numbered.where(~alone).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts"))  # the lines of one record
    spanning = pieces.select("file", "record", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"))
    return numbered.where(alone).select("file", "record", F.col("line").alias("text")).unionByName(spanning)


def _rows_before(records: DataFrame) -> DataFrame:
    """(file, skip): the records of all files before a file, headers not counted; one row per file."""
    counts = records.groupBy("file").agg(F.max("record").alias("records"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", F.coalesce(F.sum(F.col("records") - 1).over(earlier), F.lit(0)).alias("skip"))


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", row: str | None = None) -> DataFrame:
    """All-string table of the files at ``path``, named by the first file's header; ``row`` names a column with each record's
    position. Equal to the built-in reader with ``multiLine``, but a large file is read by many tasks."""
    plain = "ISO-8859-1" if encoding.lower() in ("cp1252", "windows-1252") else encoding
    header = spark.read.options(header=True, multiLine=True, encoding=plain, **OPTIONS).csv(path).schema
    records = csv_records(spark, path, plain)
    text = F.col("text") if plain == encoding else cp1252_fix(F.col("text"))
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in header.fields)
    cells = F.from_csv(text, F.lit(ddl), {**OPTIONS, "multiLine": "true"})
    found = records.where("record > 1").withColumn("cells", cells)
    if row:
        found = found.join(_rows_before(records), "file").withColumn("_row", F.col("skip") + F.col("record") - 2)
    return found.select(*[F.col("cells").getField(f.name).alias(f.name) for f in header.fields], *([F.col("_row").alias(row)] if row else []))
