"""Best-fit packing of token sequences, certified by dual-feasible-function lower bounds.

Documents longer than a sequence are cut into whole sequences, the remainder first; each whole one is a sequence of its
own. The other pieces are dealt to partitions of at most `per_part` pieces, each packed by best-fit decreasing. For each
partition, the maximum over a family of dual-feasible functions bounds its number of bins from below. A partition that
meets its bound is final. Those with gaps keep their full bins and put the documents of all others into a pool, which is
dealt anew and packed again; a round's result counts only if it needs fewer bins.

Null text: empty, one piece with the end id alone. Repeated rows are separate documents (`row` tells their pieces
apart); ties are broken by hash and doc_id, so reruns give equal bin counts. An empty table gives no rows. Only doc_id and
text are read, so other columns may have any names; `pack` keeps all columns of its items but sequence_id, offset, bins
and bound, which it makes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_bytes, tokenizer_path
from .encoding import encoder


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: the remainder first, then whole sequences."""
    head = length % most if length > most else length
    return [(0, head)] * bool(head) + [(at, most) for at in range(head, length, most)]


def pieces(docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    path, end = tokenizer_path(tokenizer), end_id.to_bytes(4, "little")
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(path).encode_all, TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encode(text_bytes(batch)), strict=True):
                ids = encoded + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((row, doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                row += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = int(sizes @ counts)  # as multiples of 1 / capacity
    for least in range(1, capacity // 2 + 1):
        value = np.where(sizes > capacity - least, capacity, np.where(sizes < least, 0, sizes))
        best = max(best, int(value @ counts))
    bound = -(-best // capacity)
    for k in range(1, 33):
        whole = (k + 1) * sizes
        value = whole // capacity * np.where(whole % capacity == 0, k, k + 1)  # in parts of k * (k + 1)
        bound = max(bound, -(-int(value @ counts) // (k * (k + 1))))
    return bound


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length by best-fit decreasing, and the room left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, open_rooms = [], 0
    for at in np.argsort(-lengths, kind="stable"):
        need = int(lengths[at])
        fits = open_rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, own = capacity, len(rooms)
            rooms.append(capacity)
        bins[at], offsets[at] = own, capacity - room
        rooms[own] = room = room - need
        if room:
            by_room[room].append(own)
            open_rooms |= 1 << room
    return bins, offsets, rooms


def pack(items: DataFrame, *, capacity: int = 1024, per_part: int = 65536, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(items with sequence_id, offset, bins and bound, certificates per partition and round).

    bins and bound are those of the partition that an item was last packed in: the bins it took, and the bins that any
    packing of its items takes at least.

    `items` has row, piece, length and any other columns. At most `rounds` (up to 6) repackings; `per_part` bounds what one task holds.
    """
    scratch = Scratch(items.sparkSession)
    items = scratch.save(items, "items")
    rest = items.filter(F.col("length") < capacity)
    whole = items.filter(F.col("length") >= capacity).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bins": F.lit(1).cast("long"), "bound": F.lit(1).cast("long")})
    schema = "row long, piece int, length long, part long, bin long, offset long, bins long, bound long, final boolean"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "piece"], ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins, offsets, rooms = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        final = len(rooms) <= bound
        return frame.assign(bin=bins, offset=offsets, bins=len(rooms), bound=bound, final=final | (np.array(rooms)[bins] == 0))

    done, certificates = [], []
    pool = rest.select("row", "piece", "length")
    before = 0  # bins that the pool takes so far
    for k in range(rounds + 1):
        n = pool.count()
        if not n:
            break
        parts = -(-n // per_part)
        dealt = pool.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece", F.lit(k)), F.lit(parts)).alias("part"))
        packed = scratch.save(dealt.groupBy("part").applyInPandas(one, schema), f"round{k}")
        certificates.append(packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound")).withColumn("round", F.lit(k)))
        used = packed.filter(F.col("offset") == 0).count()
        if before:
            if used >= before:
                break
            done.pop()
        named = packed.withColumn("sequence_id", F.lit((k + 1) << 60) + F.shiftleft(F.col("part"), 32) + F.col("bin"))
        done += [named.filter("final"), named.filter("not final")]
        pool = packed.filter("not final").select("row", "piece", "length")
        before = packed.filter("not final and offset = 0").count()
    placed = None
    for part in done:
        part = part.select("row", "piece", "sequence_id", "offset", "bins", "bound")
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        return whole.limit(0) if not items.take(1) else whole, items.sparkSession.createDataFrame([], "part long, bins long, bound long, round int")
    report = certificates[0]
    for more in certificates[1:]:
        report = report.unionByName(more)
    return whole.unionByName(rest.join(placed, ["row", "piece"])), report


def pack_documents(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, per_part: int = 65536, rounds: int = 3) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound and row of every piece of every document."""
    return pack(pieces(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity), capacity=capacity, per_part=per_part, rounds=rounds)[0]
