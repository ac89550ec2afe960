"""Arrow batches through Python, with bounded memory and untouched pass-through columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm.common import without

#: Rows that Python holds as objects at a time.
ROWS = 512


def appended(df: DataFrame, column: str, fields: list[tuple[str, T.DataType, pa.DataType]], make: Callable[[list[str]], list]) -> DataFrame:
    """``df`` with ``fields`` made from its string column; nulls in it count as empty. Columns of those names are replaced."""
    df = without(df, [n for n, _, _ in fields])
    at = df.columns.index(column)
    schema = T.StructType(df.schema.fields + [T.StructField(n, t) for n, t, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                texts = [x or "" for x in part.column(at).to_pylist()]
                new = [pa.array(v, type=t) for v, (_, _, t) in zip(make(texts), fields, strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns + new, names=part.schema.names + [n for n, _, _ in fields])

    return df.mapInArrow(run, schema)


def labelled_sample(labels: DataFrame, label: str, rows: int, where: Column | None = None) -> DataFrame:
    """(doc_id, y): at most ``rows`` rows of each class, those with the least hash of doc_id, so at most 2 * ``rows`` in all.

    A doc_id that is labelled more than once counts once, with its largest label; null ids and labels are left out.
    """
    t = labels if where is None else labels.filter(where)
    t = t.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return t.filter("y = 0").orderBy(*order).limit(rows).unionByName(t.filter("y = 1").orderBy(*order).limit(rows))
