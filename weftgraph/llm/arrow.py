"""Python stages over whole rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows per batch handed to a stage; bounds the memory of one batch of long texts.
BATCH = 512


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Apply to each row of df a function that yields any number of output tuples.

    `make` runs once per task and returns the function of one row's column values, so that automata and parsers
    are built per task at most. Nothing is gathered: the stage streams.
    """
    names = [x.split()[0] for x in schema.split(",")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    arrow = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, schema.split(","))])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                batch = big.slice(at, BATCH)
                out = [t for row in zip(*(c.to_pylist() for c in batch.columns)) for t in f(*row)]
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return df.mapInArrow(stage, schema)
