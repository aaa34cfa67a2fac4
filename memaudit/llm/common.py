"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: ``[^\\x20\\x09-\\x0D]+``: the white-space words that several contracts count.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has (case-insensitively), one per wanted name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def add_columns(df: DataFrame, text: str, new: list[T.StructField], compute: Callable[[list[bytes | None]], list[list]],
                keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the columns ``new`` that ``compute`` makes from batches of texts.

    One Arrow pass over the partitions, no shuffle; memory is one batch."""
    keep = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + new)
    names = [f.name for f in schema.fields]
    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(f.dataType) for f in new]
    # the text may be dropped on the way out, so it travels as the last column under a position, not a name
    source = df.select(*[quoted(c) for c in keep], quoted(text).cast("string").alias(fresh(df, "text_in")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(utf8(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(v, k) for v, k in zip(made, kinds)], names=names)

    return source.mapInArrow(run, schema)
