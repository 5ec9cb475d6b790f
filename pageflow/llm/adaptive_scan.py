"""Nearest neighbours by largest inner product: inverted lists, scanned with adaptive dimension sampling.

Vectors get one more component, sqrt(largest squared norm - own squared norm), and queries 0; then the largest inner
product is the smallest Euclidean distance. All are turned by one random rotation. Lists come from k-means on a bounded
sample; every row is indexed. A query scans its nearest lists (as many as a brute-force measurement in the sample
asks for), in blocks of `block` rotated dimensions: after each block
the partial distance, scaled to all dimensions, is tested against the distance to beat, and candidates whose distance is
very likely larger are given up (the test of width `width`). Survivors are scored exactly, in double precision on the
original vectors. The distance to beat starts from the query's k-th best in the sample. These k best are rows of the table
and candidates too, whether their lists are scanned or not, so a query finds k rows wherever there are so many.

Lists and the queries that scan them are dealt in blocks of at most `per_group` rows, so a common vector is no single
task. Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part.
Equal scores go to the smaller vec_id. Null vec_ids take no part. Rows are told by their vec_id: rows that repeat one are
candidates each, but none of them for a query of that id, and as queries they share one list of results. An empty table, or
one without valid vectors, gives no rows. Only vec_id and embedding are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the vectors that take part, before the length rule."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding"))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), 1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def probes_for(centres: np.ndarray, x: np.ndarray, x_turned: np.ndarray, q_turned: np.ndarray, k: int, recall: float) -> int:
    """Lists that a query has to scan so that `recall` of its k best lie in them, measured by brute force in the sample.

    Neighbours in a sample are farther off than in the whole table, so this errs towards more lists.
    """
    half = 0.5 * (centres * centres).sum(1)
    own = np.argmax(x_turned @ centres.T - half, 1)
    scores = q_turned @ x_turned.T
    scores[np.arange(len(q_turned)), np.arange(len(q_turned))] = -np.inf
    best = np.argsort(-scores, 1, kind="stable")[:, : min(k, len(x) - 1)]
    order = np.argsort(half - q_turned @ centres.T, 1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), 1)
    return int(np.quantile(np.take_along_axis(place, own[best], 1), recall)) + 1 if best.size else 1


def scan(ids: np.ndarray, x: np.ndarray, turned: np.ndarray, own: np.ndarray, q: np.ndarray, q_turned: np.ndarray, to_beat: np.ndarray, k: int, block: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of the k best of each query among those that no test gave up.

    While many pairs of the given queries and candidates are alive, a block is one matrix product; then only pairs that
    are still alive are touched.
    """
    whole = turned.shape[1]
    limit = lambda d: (to_beat * (1 + 1e-9) + 1e-9) * (d / whole * (1 + width / math.sqrt(d)) ** 2 if d < whole else 1.0)
    part, alive, at = np.zeros((len(q), len(ids))), ids[None, :] != own[:, None], 0
    while at < whole and alive.mean() > 0.125:  # many pairs alive: a matrix product over the block's columns
        a, b = q_turned[:, at : at + block], turned[:, at : at + block]
        part += (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        at = min(at + block, whole)
        alive &= part <= limit(at)[:, None] + 1e-9
    at_q, at_x = np.nonzero(alive)
    part = part[at_q, at_x]
    while at < whole:
        to = min(at + block, whole)
        gap = turned[at_x, at:to] - q_turned[at_q, at:to]
        part += np.einsum("ij,ij->i", gap, gap)
        keep = part <= limit(to)[at_q] + 1e-9
        at_q, at_x, part, at = at_q[keep], at_x[keep], part[keep], to
    scores = np.zeros(len(at_q))
    for j in range(x.shape[1]):  # double precision, components in order, so equal vectors have equal scores
        scores += x[at_x, j] * q[at_q, j]
    order = np.lexsort((ids[at_x], -scores, at_q))
    at_q, at_x, scores = at_q[order], at_x[order], scores[order]
    begins = np.searchsorted(at_q, at_q, side="left")
    best = np.arange(len(at_q)) - begins < k
    return at_q[best], at_x[best], scores[best]


def search(vectors: DataFrame, *, every: int = 20, k: int = 20, recall: float = 0.95, most_lists: int = 4096, sample: int = 16384, seeds: int = 4096, block: int = 16, width: float = 2.1, per_group: int = 8192) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    d, n = lengths[0]
    rows = rows.filter(F.size("embedding") == d)
    top = float(rows.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    sample_ids = chosen.column("vec_id").to_numpy()
    sample_x = np.array(chosen.column("embedding").to_pylist())
    rotation = np.linalg.qr(np.random.default_rng(9).normal(size=(d + 1, d + 1)))[0]

    def turn(x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x * x).sum(1), 0))
        return np.column_stack([x, last]) @ rotation

    lists = max(1, min(most_lists, len(sample_ids) // 8, math.isqrt(n) // 4))
    turned = turn(sample_x)
    centres = k_means(turned, lists)
    probes = probes_for(centres, sample_x, turned, turn(sample_x[:256], True), k, recall)
    shared = spark.sparkContext.broadcast((centres, sample_ids[:seeds], sample_x[:seeds]))  # bounded by most_lists and seeds

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each vector's own list, and for each list that a query scans."""
        centres, seed_ids, seed_x = shared.value
        half = 0.5 * (centres * centres).sum(1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist()).reshape(len(ids), d)
            own = np.argmax(turn(x) @ centres.T - half, 1)
            is_query = ids % every == 0
            q = x[is_query]
            near = np.argsort(half - turn(q, True) @ centres.T, 1, kind="stable")[:, :probes]
            scores = q @ seed_x.T
            scores[ids[is_query][:, None] == seed_ids[None, :]] = -np.inf
            kth = np.sort(scores, 1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
            to_beat = (q * q).sum(1) + top - 2 * kth
            out = [np.concatenate([ids, np.repeat(ids[is_query], near.shape[1])]), np.concatenate([own, near.ravel()])]
            flags = np.concatenate([np.zeros(len(ids), bool), np.ones(near.size, bool)])
            bounds = np.concatenate([np.zeros(len(ids)), np.repeat(to_beat, near.shape[1])])
            both = np.concatenate([x, np.repeat(q, near.shape[1], 0)])
            vector = pa.ListArray.from_arrays(pa.array(np.arange(0, both.size + 1, d), pa.int32()), pa.array(both.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(flags), pa.array(bounds), vector], ["vec_id", "list", "query", "bound", "x"])

    def best_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best sampled rows of each query, which set its bound."""
        _, seed_ids, seed_x = shared.value
        for batch in batches:
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            for own, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q = np.array(vector)
                rough = seed_x @ q
                rough[seed_ids == own] = -np.inf
                kth = np.sort(rough)[-min(k, len(rough))]
                at = np.flatnonzero((rough >= kth - 1e-9 * (1 + abs(kth))) & (rough > -np.inf))
                scores = np.zeros(len(at))
                for j in range(d):  # as in scan, so that the same pair has the same score
                    scores += seed_x[at, j] * q[j]
                order = np.lexsort((seed_ids[at], -scores))[:k]
                found.append((np.full(len(order), own), seed_ids[at][order], scores[order]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    indexed = scratch.save(rows.mapInArrow(assign, "vec_id long, list long, query boolean, bound double, x array<double>"), "index")
    sizes = indexed.groupBy("list").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(F.when(c, 1).otherwise(0)) / per_group)).cast("int").alias(a) for a, c in (("row_blocks", ~F.col("query")), ("query_blocks", F.col("query")))))
    dealt = indexed.join(F.broadcast(sizes), "list")  # a row for each list, of which there are at most most_lists
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = dealt.filter("not query").withColumn("row_block", part("row_blocks")).withColumn("query_block", spread("query_blocks")).select("list", "row_block", "query_block", "vec_id", "x")
    asked = dealt.filter("query").withColumn("query_block", part("query_blocks")).withColumn("row_block", spread("row_blocks")).select("list", "row_block", "query_block", "vec_id", "bound", "x").toDF("in_list", "in_row_block", "in_query_block", "vec_id", "bound", "x")

    def one(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", ignore_index=True)
            ids, x = rows["vec_id"].to_numpy(), np.stack(rows["x"].to_numpy())
            turned, q = turn(x), np.stack(queries["x"].to_numpy())
            q_turned = turn(q, True)
            own, bound = queries["vec_id"].to_numpy(), queries["bound"].to_numpy()
            for at in range(0, len(q), 256):
                some = slice(at, at + 256)
                of, to, score = scan(ids, x, turned, own[some], q[some], q_turned[some], bound[some], k, block, width)
                found.append(pd.DataFrame({"query_id": own[some][of], "vec_id": ids[to], "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    keys = ["list", "row_block", "query_block"]
    near = base.groupBy(*keys).cogroup(asked.groupBy(*(f"in_{c}" for c in keys))).applyInPandas(one, "query_id long, vec_id long, score double")
    seeded = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(best_seeds, "query_id long, vec_id long, score double")
    near = near.withColumn("seeded", F.lit(False)).union(seeded.withColumn("seeded", F.lit(True)))
    same = ["query_id", "vec_id", "score"]  # a row that was both scanned and sampled counts once, repeated rows as often as they are
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "seeded").orderBy("seeded"))).dropDuplicates([*same, "nth"])
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
