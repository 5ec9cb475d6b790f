"""Labelled training rows for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, *, parts: int, held: int, most: int) -> tuple[Iterator[bytes], np.ndarray]:
    """Texts (one at a time) and labels of at most `most` labelled rows whose fold isn't `held`, chosen by a hash of the id.

    The bound keeps what the driver fits on small however many labels there are; all of them are used below it.
    Labels are made unique first (the smallest value of a repeated id), null labels and ids are left out. Rows that repeat
    an id and a text count once.
    """
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = y.filter(fold("doc_id", parts) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])  # at most `most` ids
    table = rows.toArrow()
    if not table.num_rows:
        return iter(()), np.empty(0)
    table = table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
    return (text.as_py().encode() for text in table.column("text")), table.column("y").to_numpy().astype(float)
