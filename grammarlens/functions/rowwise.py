"""New columns from one column through Arrow, beside a row that is carried along whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def with_made(rows: DataFrame, column: str, fields: str, prepare: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """rows with further columns (fields, in DDL), which replace those of their names.

    prepare is called once in each task; what it returns gets the values of a batch and gives
    one array for each new column. The row travels as one struct, so its columns may have any name.
    """
    names = [f.partition(" ")[0].strip("`") for f in fields.split(", ")]
    kept = [c for c in rows.columns if c not in names]
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(f"`{column}`").alias("_value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = prepare()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(batch.column(1).to_pylist())], names=["_row", *names])

    done = packed.mapInArrow(run, StructType([packed.schema["_row"], *StructType.fromDDL(fields)]))
    return done.select("_row.*", *names)
