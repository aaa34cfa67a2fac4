"""Writers for the audit's outputs (K1-K6, and K7 from ``resume``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memaudit.sources.resume import append_pending, read_appended  # noqa: F401  (K7)


CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": '""'}


def write_cards(cards: DataFrame, path: str) -> None:
    """K1: one JSONL set per mode (``mode=...`` folders), overwriting; NULL meta fields
    are written as explicit nulls like the audited pipeline."""
    (cards.select("meta", "text", "mode").write.mode("overwrite").partitionBy("mode")
     .option("ignoreNullFields", "false").json(path))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, compression: str | None = None, open_files: int = 0) -> None:
    """K2: prompts / chat records as UTF-8 JSONL (non-ASCII kept as is), plain or by a codec that the readers know by the files' ending.

    With ``open_files`` a task keeps that many of its files open and does not sort its lines by ``partition_by``; only a task with more files does."""
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    try:
        if open_files:
            conf.set(name, str(open_files + 1))  # a task that reaches the number begins to sort
        w.json(path)
    finally:
        conf.set(name, before)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: header CSV (splits, metric tables); cells are quoted where needed, quotes inside doubled, empty text kept apart from NULL."""
    df.write.mode(mode).options(**CSV).csv(path)


def percent_view(df: DataFrame, cols: list[str], digits: int = 1) -> DataFrame:
    """K4: report view with ``x*100`` rounded half-to-even (numeric columns stay numeric upstream)."""
    return df.select(*[F.bround(F.col(c) * 100, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def markdown_lines(df: DataFrame, cols: list[str], order: list[Column]) -> DataFrame:
    """K5: (line_no, line): a markdown table, its header, rule and rows, for a frame of report size.

    Rows come in the order ``order``, which has to tell them apart; the window below is over those rows alone. A bar or line break
    inside a cell is written so that the cell stays one cell."""
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", "<br>")

    header = "| " + " | ".join(cols) + " |"
    rule = "|" + "|".join("---" for _ in cols) + "|"
    head = df.sparkSession.createDataFrame([(1, header), (2, rule)], "line_no long, line string")
    place = F.row_number().over(Window.orderBy(*order)) + 2
    rows = df.select(place.cast("long").alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cols)), F.lit(" |")).alias("line"))
    return head.unionByName(rows)


def write_scrubbed(df: DataFrame, path: str) -> None:
    """K6: the scrubbed table goes to a NEW path (Spark cannot overwrite the table it reads)."""
    df.write.mode("errorifexists").options(**CSV).csv(path)
