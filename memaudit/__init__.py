"""memaudit — disclosure-risk and memorization-audit operators on Spark DataFrames.

Layout:
  functions/  Column expressions (cell parsing, scrubbing, text matching, statistics)
  operators/  DataFrame -> DataFrame operators (rarity, splits, cards, scoring, summaries)
  sources/    readers and writers for the record, card, prompt and prediction formats
  plans/      the operators re-aimed at the driver's parquet tables, plus their SQL oracles
  streaming/  incremental (append + resume) scoring with Structured Streaming
"""

from memaudit.session import checkpoint_dir, get_spark, materialize, spread

__all__ = ["get_spark", "checkpoint_dir", "materialize", "spread"]
