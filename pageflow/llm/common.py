"""What the corpus operators share: scratch tables, worker-wide caches, text batches."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of all contracts: runs of anything but space, \t, \n, \v, \f and \r.
SPACES = r"[\x20\x09-\x0D]+"


class Scratch:
    """Written tables that cut lineage, below the folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is missing, and only for a local master, a temporary folder is made and removed at exit.
    """

    #: All that were made and not cleared yet.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="pageflow-")
            atexit.register(shutil.rmtree, own, True)
            base = f"file://{own}"
        self.root = f"{base.rstrip('/')}/pageflow-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later read needs."""
        for name in names:
            self._delete(self.path(name))

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def clear_from(cls, first: int) -> None:
        """Deletes all tables of those made from the `first` on; their results have to be written elsewhere by then."""
        for scratch in cls.made[first:]:
            scratch._delete(scratch.root)
        del cls.made[first:]


def store(owner: str) -> dict:
    """A dict that lives across the tasks that a Python worker runs for one operator, the `owner`.

    Workers outlive jobs, so what another operator kept is dropped: a worker never holds the caches of two.
    """
    kept = sys.__dict__.setdefault("_pageflow_store", {})
    if owner not in kept:
        kept.clear()
        pa.default_memory_pool().release_unused()
        kept[owner] = {}
    return kept[owner]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> Iterator[None]:
    """What is written inside goes to Python in batches of at most `rows` rows and about `size` bytes.

    A batch is held several times over (by the JVM while it grows, in Python, as results), by each running task. This
    changes what is held, not which rows there are; afterwards the session has its own settings again.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Memo(dict):
    """A cache of `make(key)` that is emptied at `limit` entries, so its memory is bounded."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.make(key)
        return value


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def scored(docs: DataFrame, score: Callable) -> DataFrame:
    """doc_id and score, by a function from a batch to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def filtered(docs: DataFrame, passes: Callable, rows: int = 1000) -> DataFrame:
    """The rows whose batch position passes, all columns as they are; judged and returned `rows` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                yield part.filter(pa.array(passes(part), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def word_count(text: str | Column) -> Column:
    """Number of words of a text, null: 0."""
    value = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(value, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; a path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
