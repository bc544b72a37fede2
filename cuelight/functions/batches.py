"""Arrow-batch helpers: Python code sees whole columns, never single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cuelight.session import ship


def spread(df: DataFrame, key: str) -> DataFrame:
    """Enough partitions for the cores: small inputs of few files are hashed on ``key``, others stay as they are.
    For rows that come straight from a scan: behind a shuffle, asking for the partitions would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)


def map_columns(df: DataFrame, fn: Callable[..., dict | None], schema: StructType) -> DataFrame:
    """``fn`` gets the columns of each Arrow batch as Python lists and returns the output columns by name."""
    names = df.columns
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            got = fn(*(batch.column(i).to_pylist() for i in range(len(names))))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
