"""Session construction and lineage cutting.

Cluster jobs read ``spark.checkpoint.dir`` from the session (a shared folder the
cluster names); only when it is unset (local tests) do we pick a scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Text rendering/scoring is CPU-bound per row and its rows expand after joins:
    # let AQE keep small-but-expensive shuffle outputs in many tasks, and size
    # rebalanced outputs by what they really hold.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "memaudit", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE + skew-join handling and UTC time."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a local scratch one only when unset (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: stage tables need a folder that all executors share")
        d = tempfile.mkdtemp(prefix="memaudit-ckpt-")  # one process: any folder is shared
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - core confs may be read-only at runtime; the context dir suffices
            pass
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet under the checkpoint folder and reading it back.

    A written table survives executor loss (unlike cached or locally checkpointed blocks). ``options`` go to the writer.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    path = os.path.join(base, f"{name or 'stage'}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # a known schema needs no job to read the files' footers


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out a small-in-bytes but CPU-heavy input again, by hash of ``keys`` or evenly.

    Row count, not bytes, drives the cost of text rendering and regex scoring; a
    tiny table scanned from one file (and kept in one partition by broadcast
    joins) would otherwise run in a single task. No number of partitions is given: adaptive execution sizes them by
    what they hold, from one per core for a small table (``coalescePartitions.minPartitionSize``) to as many as a large one needs."""
    return df.repartition(*[F.col(k) for k in keys]) if keys else df.hint("rebalance")
