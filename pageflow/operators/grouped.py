"""Small groups handled in Python, many to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def by_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """run(rows) for the rows of each group, in `order`; rows are tuples in the order of the columns.

    One exchange brings a group together; a task streams its groups, so a batch holds many small ones and only one group
    is held whole.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    at = itemgetter(*(df.columns.index(k) for k in keys))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
        held: list[tuple] = []
        for _, group in groupby(rows, at):
            held += run(list(group))
            if len(held) >= 20_000:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(batches, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
