"""Near-duplicate classes by DartMinHash and banding.

A text is the bag of its shingles of five words (lower-cased A-Z; a shorter text is one shingle), a shingle's count being
its weight. Darts are thrown by hashing: each unit of area of (weight, rank) space above a shingle holds a Poisson(1)
number of them, the same for every text. Darts that hit the region below the shingle's weight and a rank limit count; of
those with one coordinate the earliest makes the signature, so the cost is that of the shingles plus the darts, not
shingles times coordinates. If a coordinate stays empty the rank limit is doubled.

Signatures are cut into bands; texts that share a band are candidates. A band shared by many is not expanded into pairs:
first every text is compared with the up to `leaders` leaders it meets in most bands (the leader of a band is its text that
shares most bands with others). This only joins what is easily joined: bands that then hold several components are
finished exactly, every two members of different components being compared (see `rest`), so that the number of leaders
changes the work and never the classes. Links are verified: weighted Jaccard similarity of the two bags (by
32-bit hashes of the counted shingles) at least `similar`. Classes are the connected components of links and exact copies.
Exact copies are joined first, by the digest of the text.

Null and empty texts: no shingles; they are copies of each other. Repeated rows and ids are separate documents. class_id
is the smallest doc_id of the class (null only if all are), `stays` marks one document of each class. An empty table
gives an empty result. Long texts are taken whole. Only doc_id and text are read; `keep_one` keeps all columns, whatever
their names, and of rows that repeat an id and a text it keeps one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, free_name, store, text_bytes

WORDS = 5
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880], float))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) * 2.0**-53


def shingles(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and their counts."""
    import xxhash

    kept = store("dart")
    if "words" not in kept:
        kept["words"] = Memo(xxhash.xxh64_intdigest, 300_000)
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    a = np.fromiter(map(kept["words"].__getitem__, words), np.uint64, len(words))
    n = max(1, len(a) - WORDS + 1)
    h = np.full(n, len(a) if len(a) < WORDS else 0, np.uint64)
    for j in range(min(WORDS, len(a))):
        h = mix(h * _GOLD + a[j : j + n])
    return np.unique(h, return_counts=True)


def signature(h: np.ndarray, weights: np.ndarray, k: int = 128) -> np.ndarray:
    """k coordinates of the weighted set: equal with the probability of the weighted Jaccard similarity."""
    total, out = float(weights.sum()), np.zeros(k, np.uint64)
    limit = (k * np.log(k) + 2 * k) / total
    while True:
        ranks, where, names = [], [], []
        level, low, span = 0, 0.0, 1.0
        while len(own := h[weights > low]):
            cells = int(np.ceil(limit * span))
            cell = np.tile(np.arange(cells, dtype=np.uint64), len(own))
            at = np.repeat(np.arange(len(own)), cells)
            seed = mix(own[at] + mix(cell * _GOLD + np.uint64(level)))
            darts = np.searchsorted(_POISSON, _unit(seed), side="right")
            each = np.repeat(np.arange(len(seed)), darts)
            nth = (np.arange(len(each)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(np.uint64)
            dart = mix(seed[each] + (nth + np.uint64(1)) * _GOLD)
            rank = (cell[each].astype(float) + _unit(mix(dart + np.uint64(1)))) / span
            weight = low + span * _unit(mix(dart + np.uint64(2)))
            hit = (rank <= limit) & (weight < weights[weights > low][at[each]])
            ranks.append(rank[hit])
            where.append((dart[hit] % np.uint64(k)).astype(int))
            names.append(mix(dart[hit] + np.uint64(3)))
            level, low, span = level + 1, low + span, max(1.0, low + span)
        rank, coordinate, name = np.concatenate(ranks), np.concatenate(where), np.concatenate(names)
        order = np.argsort(-rank, kind="stable")
        seen = np.zeros(k, bool)
        seen[coordinate] = True
        if seen.all():
            out[coordinate[order]] = name[order]
            return out
        limit *= 2


def bands(data: bytes, k: int, rows: int) -> np.ndarray:
    h, weights = shingles(data)
    if not len(h):
        return np.empty(0, np.int64)
    parts = signature(h, weights, k).reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * _GOLD + parts[:, j])
    return key.view(np.int64)


def bag(data: bytes) -> np.ndarray:
    """Sorted 32-bit hashes of the counted shingles: the n-th of a kind is an element of its own."""
    h, weights = shingles(data)
    at = np.repeat(np.arange(len(h)), weights)
    nth = (np.arange(len(at)) - np.repeat(np.cumsum(weights) - weights, weights)).astype(np.uint64)
    return np.unique((mix(h[at] + nth * _GOLD) >> np.uint64(32)).astype(np.uint32))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], similar: float, columns: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of bags that are similar, by matrix products over the elements that both sides have."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*flat)
    own = [np.repeat(np.arange(len(n)), n) for n in sizes]
    at = [np.searchsorted(both, x) for x in flat]
    kept = [np.flatnonzero((p < len(both)) & (both[np.minimum(p, len(both) - 1)] == x)) if len(both) else np.empty(0, np.int64) for p, x in zip(at, flat, strict=True)]
    own, at = [o[k] for o, k in zip(own, kept, strict=True)], [p[k] for p, k in zip(at, kept, strict=True)]
    common = np.zeros((len(left), len(right)))
    for low in range(0, len(both), columns):
        width = min(columns, len(both) - low)
        parts = []
        for o, p, n in zip(own, at, sizes, strict=True):
            some = (p >= low) & (p < low + width)
            part = np.zeros((len(n), width), np.float32)
            part[o[some], p[some] - low] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    return np.nonzero(common / np.maximum(1, sizes[0][:, None] + sizes[1][None, :] - common) >= similar)


def promising(active: DataFrame, held: DataFrame, scratch: Scratch, similar: float) -> DataFrame:
    """The rows of `active` (key, node, comp) whose text can be similar to another in the band by its own elements, with size.

    An element that no other text of `active` has is in no intersection. With s other elements and z, the least size that a
    similar text of the band can have, the similarity is at most s / (size + max(z, s) - s). The counts are sums, so this
    costs the elements of the texts and not their pairs.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [np.frombuffer(x, np.int32) for x in part.column(1).to_pylist()]
                node = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate(found), pa.int32())], ["node", "element"])

    nodes = active.groupBy("node").agg(F.first("comp").alias("comp"), F.collect_list("key").alias("keys"))
    nodes = scratch.save(nodes.join(held, "node").withColumn("size", (F.length("bag") / 4).cast("long")), "nodes")
    once = nodes.select("node", "bag").mapInArrow(elements, "node long, element int").groupBy("element").agg(F.count("*").alias("texts"), F.min("node").alias("node"))
    own = once.filter("texts = 1").groupBy("node").agg(F.count("*").alias("own"))
    shared = F.col("size") - F.coalesce("own", F.lit(0))
    rows = nodes.select("node", "comp", "keys", "size").join(own, "node", "left").select(F.explode("keys").alias("key"), "node", "comp", "size", shared.alias("shared"))
    rows = scratch.save(rows, "measured")
    scratch.drop("nodes")
    near = F.greatest(F.col("least"), F.col("size") * similar, F.col("shared"))
    able = F.col("shared") >= (F.col("size") + near - F.col("shared")) * (similar - 1e-9)
    return rows.join(rows.groupBy("key").agg(F.min("size").alias("least")), "key").filter(able).select("key", "node", "comp", "size")


def rest(active: DataFrame, held: DataFrame, scratch: Scratch, similar: float, small: int = 16, per_block: int = 384) -> DataFrame:
    """Links (a, b) between components, from all pairs of members of different components in each band (key, node, comp).

    Bands with the same members are compared once. Bands of at most `small` members give pairs. Of larger ones the members
    that can't have a link are left out (see `promising`). The others fall into classes of bag size, of which only
    neighbouring ones can hold similar bags; they are dealt into blocks of about `per_block` (fewer of large bags), and each
    two blocks are one group, compared by matrix products; members of a band's largest component are compared with those of
    the others only.
    """
    step = max(-math.log(similar), 1e-3) * (1 + 1e-6)
    active = scratch.save(active, "active")
    alike = active.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
    once = alike.groupBy("members", "h1", "h2").agg(F.min("key").alias("key")).select("key", "members")
    every = scratch.save(active.join(once, "key"), "every")

    few = every.filter(F.col("members") <= small).select("key", "node", "comp").join(held.select("node", (F.length("bag") / 4).cast("long").alias("size")), "node").select("key", "node", "comp", "size")
    pairs = few.toDF("key", "a", "comp_a", "size_a").join(few.toDF("key", "b", "comp_b", "size_b"), "key")
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * (similar - 1e-9)))
    pairs = pairs.select("a", "b", "comp_a", "comp_b").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= similar for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    ends = pairs.join(held.toDF("a", "bag_a"), "a").join(held.toDF("b", "bag_b"), "b").select("comp_a", "comp_b", "bag_a", "bag_b").toDF("a", "b", "bag_a", "bag_b")
    found = ends.mapInArrow(compare, "a long, b long").distinct()

    many = scratch.save(promising(every.filter(F.col("members") > small), held, scratch, similar), "members")
    largest = many.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.count("*").alias("comps")).filter("comps > 1")
    many = many.join(largest, "key").withColumn("cls", F.floor(F.log("size") / step).cast("int")).withColumn("minor", F.col("comp") != F.col("largest")).drop("largest", "comps")
    room = F.greatest(F.lit(16), F.least(F.lit(per_block), F.floor(F.lit(float(1 << 20)) / F.exp((F.col("cls") + 1) * step))))
    groups = many.groupBy("key", "cls", "minor").agg(F.ceil(F.count("*") / room).cast("int").alias("blocks"))
    many = many.join(groups, ["key", "cls", "minor"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.struct("cls", "minor", "block").alias("place"))
    cells = blocks.withColumnRenamed("place", "one").join(blocks.withColumnRenamed("place", "two"), "key")
    cells = cells.filter((F.col("one") <= F.col("two")) & (F.col("two.cls") - F.col("one.cls") <= 1) & (F.col("one.minor") | F.col("two.minor")))
    cells = scratch.save(cells.withColumn("same", F.col("one") == F.col("two")), "cells")
    sides = cells.select("key", F.col("one").alias("place"), "one", "two", "same", F.lit(0).alias("side")).union(cells.filter("not same").select("key", F.col("two").alias("place"), "one", "two", "same", F.lit(1).alias("side")))
    placed = many.select("key", F.struct("cls", "minor", "block").alias("place"), "node", "comp").join(sides, ["key", "place"]).join(held, "node")

    def one(rows: pa.Table) -> pa.Table:
        second = rows.column("side").to_numpy() == 1
        left = rows.filter(pa.array(~second))
        right = left if rows.column("same")[0].as_py() else rows.filter(pa.array(second))
        a = b = np.empty(0, np.int64)
        if len(left) and len(right):
            at = similar_pairs(*([np.frombuffer(x, np.uint32) for x in side.column("bag").to_pylist()] for side in (left, right)), similar)
            a, b = left.column("comp").to_numpy()[at[0]], right.column("comp").to_numpy()[at[1]]
            a, b = np.unique(np.stack([a, b])[:, a != b], axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = placed.select("key", F.struct("one", "two").alias("cell"), "same", "side", "comp", "bag").groupBy("key", "cell").applyInArrow(one, "a long, b long")
    return scratch.save(found.union(dealt), "rest")


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """node and label (smallest node) of the components of links (a, b), by label passing and pointer jumping."""
    both = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{tag}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{tag}-0")
    k = 0
    while True:
        near = both.join(labels.toDF("b", "other"), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        passed = labels.join(near, "node").select("node", "label", F.least("label", "other").alias("next"))
        jumped = passed.join(labels.toDF("next", "further"), "next", "left").select("node", "label", F.least("next", F.coalesce("further", "next")).alias("next"))
        stepped = scratch.save(jumped, f"{tag}-{k + 1}")
        scratch.drop(f"{tag}-{k}")
        k += 1
        labels = stepped.select("node", F.col("next").alias("label"))
        if not stepped.filter("label <> next").take(1):
            scratch.drop(f"{tag}-edges")
            return labels


def classes(docs: DataFrame, *, similar: float = 0.8, k: int = 128, rows: int = 4, leaders: int = 4, per_block: int = 384) -> DataFrame:
    """doc_id, digest, class_id and stays of every document."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = store("dart")
        made = kept.setdefault(("bands", k, rows), Memo(lambda x: None, 2000))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = []
            for digest, data in zip(batch.column(2).to_pylist(), text_bytes(batch), strict=True):
                if made[digest] is None:
                    made[digest] = bands(data, k, rows)
                keys.append(made[digest])
            ids = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "digest", "bands"])

    digested = docs.withColumn("digest", F.md5(F.col("text").cast("binary")))
    signed = scratch.save(digested.mapInArrow(sign, "row long, doc_id long, digest string, bands array<long>"), "signed")
    texts = scratch.save(signed.groupBy("digest").agg(F.min("row").alias("node"), F.min_by("bands", "row").alias("bands")), "texts")
    shared = texts.select("node", F.explode("bands").alias("key"))
    many = shared.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    # A row for each text, with its shared bands and the number of texts in them.
    by_node = scratch.save(shared.join(many, "key").groupBy("node").agg(F.sum("size").alias("pop"), F.collect_list("key").alias("keys")), "by_node")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bag(t).tobytes() for t in text_bytes(batch)], pa.binary())], ["node", "bag"])

    wanted = texts.join(by_node, "node", "left_semi").select("digest", "node")
    first = digested.join(wanted, "digest").select("node", "text").dropDuplicates(["node"])
    held = scratch.save(first.mapInArrow(bags, "node long, bag binary"), "bags")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= similar for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["a", "b", "near"])

    banded = by_node.select("node", "pop", F.explode("keys").alias("key"))
    heads = banded.groupBy("key").agg(F.max_by("node", F.struct("pop", "node")).alias("leader"))
    met = banded.join(heads, "key").filter("node <> leader").groupBy("node").agg(F.collect_list("leader").alias("met"))  # one a band at most
    often = F.transform(F.array_distinct("met"), lambda x: F.struct((-F.size(F.filter("met", lambda y: y == x))).alias("times"), F.xxhash64(x).alias("h"), x.alias("leader")))
    best = met.select("node", F.explode(F.slice(F.array_sort(often), 1, leaders)).alias("one")).select("node", "one.leader")
    ends = best.join(held.toDF("leader", "other"), "leader").join(held, "node").select("node", "leader", "bag", "other")
    judged = scratch.save(ends.mapInArrow(compare, "a long, b long, near boolean"), "judged").filter("near").select("a", "b")
    labels = components(judged, scratch, "labels")
    named = by_node.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("comp"), F.explode("keys").alias("key"))
    several = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    active = named.join(several, "key", "left_semi").select("key", "node", "comp")
    last = rest(active, held, scratch, similar, per_block=per_block)
    last = components(last, scratch, "last") if last.take(1) else None
    rows_ = signed.select("row", "doc_id", "digest").join(texts.select("digest", "node"), "digest")
    rows_ = rows_.join(labels, "node", "left").withColumn("node", F.coalesce("label", "node")).drop("label")
    if last is not None:  # its nodes are the components of the leaders' links
        rows_ = rows_.join(last, "node", "left").withColumn("node", F.coalesce("label", "node"))
    first = rows_.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first"))
    return rows_.join(first, "node").select("doc_id", "digest", F.col("first.doc_id").alias("class_id"), (F.col("row") == F.col("first.row")).alias("stays"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without the other members of each class; all columns as they are."""
    own, of, digest = (free_name(docs, n) for n in ("_own", "_of", "_digest"))
    stays = classes(docs, **options).filter("stays").select(F.col("doc_id").alias(of), F.col("digest").alias(digest))
    signed = docs.withColumn(own, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = signed.join(stays, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(own) == F.col(digest)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)
