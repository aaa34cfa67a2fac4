"""Appending to an output and resuming it (K7, J4), with an index of the keys that are done.

Layout under the output path (one writer at a time):

    append=<id>/...json                the rows of one append
    _index/<id>/bucket=<b>/...parquet  their keys, dealt to ``buckets`` by hash
    _manifest/<id>                     one JSON line {id, buckets, sizes}, written last

An append exists once its manifest does. One that was killed before that is not seen by ``read_appended`` nor by a later resume,
and the next append removes what it left. A resume works out which buckets its keys fall into and reads the index of those alone,
so what it reads follows from what it asks about, not from the rows that are there. JSON files that were in the output before
it had an index are indexed once, under the id ``base``.

A null key is never done. Keys are compared as strings.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
BASE = "base"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder. Any other trouble is an error."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def manifest(spark: SparkSession, path: str) -> list[dict]:
    """What was appended: {id, buckets, sizes: {bucket: keys}} of each committed append."""
    names = [n for n in _names(spark, f"{path}/_manifest") if not n.startswith((".", "_"))]
    if not names:
        return []
    lines = spark.read.text([f"{path}/_manifest/{n}" for n in names]).collect()  # one short line per append
    return sorted((json.loads(r["value"]) for r in lines), key=lambda m: m["id"])


def _commit(spark: SparkSession, path: str, entry: dict) -> None:
    fs, folder = _fs(spark, f"{path}/_manifest")
    fs.mkdirs(folder)
    _, hidden = _fs(spark, f"{path}/_manifest/.{entry['id']}")
    _, final = _fs(spark, f"{path}/_manifest/{entry['id']}")
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if not fs.rename(hidden, final):
        raise RuntimeError(f"the append {entry['id']} could not be committed")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _index(spark: SparkSession, path: str, data: list[str], append: str, key: str, buckets: int) -> None:
    """Index and commit the rows that were written to ``data``."""
    schema = T.StructType([T.StructField(key, T.StringType())])
    keys = spark.read.schema(schema).option("mode", "FAILFAST").json(data).select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct()
    index = f"{path}/_index/{append}"
    keys.withColumn("bucket", bucket_of(F.col("key"), buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(index)
    sizes = spark.read.schema("key string, bucket int").parquet(index).groupBy("bucket").count().collect()  # at most ``buckets`` rows
    _commit(spark, path, {"id": append, "buckets": buckets, "sizes": {str(r["bucket"]): r["count"] for r in sizes}})


def index_paths(entries: list[dict], path: str, asked: set[int]) -> list[str]:
    """The folders of the index that hold keys of the buckets asked about."""
    return [f"{path}/_index/{m['id']}/bucket={b}" for m in entries for b in sorted(map(int, m["sizes"])) if b in asked]


def pending(todo: DataFrame, path: str, key: str = "prompt_id", buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``todo`` whose key was not appended yet."""
    spark = todo.sparkSession
    entries = manifest(spark, path)
    if not entries:
        return todo
    buckets = entries[0]["buckets"]
    asked = {r["b"] for r in todo.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect()}  # at most ``buckets`` rows
    paths = index_paths(entries, path, asked)
    if not paths:
        return todo
    done = spark.read.schema("key string").parquet(*paths).select(F.col("key").alias("_done"))
    return todo.join(done.distinct(), F.col(key).cast("string") == F.col("_done"), "left_anti")


def append_pending(todo: DataFrame, path: str, key: str = "prompt_id", buckets: int = BUCKETS) -> None:
    """K7 + J4: append the rows of ``todo`` whose key is not in the output yet; a rerun goes on where the last append ended."""
    spark = todo.sparkSession
    path = path.rstrip("/")
    entries = manifest(spark, path)
    committed = {m["id"] for m in entries}
    names = _names(spark, path)
    for name in names:
        if name.startswith("append=") and name.removeprefix("append=") not in committed:
            _remove(spark, f"{path}/{name}")  # a killed append
    own = [f"{path}/{n}" for n in names if not n.startswith(("append=", "_", "."))]
    if own and BASE not in committed:
        _index(spark, path, own, BASE, key, entries[0]["buckets"] if entries else buckets)
        entries = manifest(spark, path)
    append = uuid.uuid4().hex
    pending(todo, path, key, buckets).write.json(f"{path}/append={append}")
    _index(spark, path, [f"{path}/append={append}"], append, key, entries[0]["buckets"] if entries else buckets)


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed appends."""
    path = path.rstrip("/")
    ids = [m["id"] for m in manifest(spark, path)]
    data = [f"{path}/append={i}" for i in ids if i != BASE]
    if BASE in ids:
        data += [f"{path}/{n}" for n in _names(spark, path) if not n.startswith(("append=", "_", "."))]
    if not data:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(data)
