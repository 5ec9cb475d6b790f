"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r = m e^z / (m - 1 + e^z) with z = lambda(source) * size / mean size of the source: the
exponential tilt that solves the entropy-balancing problem with rates between 0 and m (m: `most`, 1 is neutral), under
one token constraint per source. The convex dual is solved by Newton steps; each step is one aggregation over the
(source, size) cells, kept inside a bracket so that it can't run away. Rates become whole copies cell by cell, largest
documents first, each cell taking up the rounding error of those before it; inside a cell a hash of doc_id decides who
gets the odd copies. Cells are dealt in buckets of a bounded number of rows, so a hot source or size is no single task.

Null text: size 0. Null source: a source of its own, last. Sources of size 0 have target 0. Repeated rows count as
separate documents. Reruns agree. An empty table gives an empty result. All columns of the input are kept, whatever their
names, but source_size, target, copies and taken, which are those of the mix.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, word_count

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, n, source_size, target from one row per source (source, n, source_size).

    Weights repeat over the sources by code point, null last. What a source can't take (`most` times its size) is shared
    again by weight. Windows here span the sources, not the documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    s = sources.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    s = s.withColumns({"cap": F.lit(most) * F.col("source_size"), "total": F.sum("source_size").over(every).cast("double"), "all_weight": F.sum("weight").over(every)})
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("capped", F.col("cap") / F.col("weight") < level)
    free = (F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)) / F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * free))).select("source", "n", "source_size", "target")


def solve_dual(cells: DataFrame, targets: DataFrame, scratch: Scratch, *, most: float = 3.0, steps: int = 40, near: float = 1e-6) -> DataFrame:
    """targets with `tilt`: lambda of each source, from at most `steps` Newton steps (one aggregation each)."""
    state = scratch.save(targets.withColumns({"tilt": F.lit(0.0), "low": F.lit(-80.0), "high": F.lit(80.0), "gap": F.lit(1.0)}), "state0")
    for k in range(1, steps + 1):
        joined = cells.join(state, cells.source.eqNullSafe(state.source)).select(state.source, "size", "docs", "tilt", "n", "source_size")
        x = F.col("size") * F.col("n") / F.col("source_size")
        r = rate(F.col("tilt") * x, most)
        sums = joined.filter("size > 0").groupBy("source").agg(
            F.sum(F.col("docs") * F.col("size") * r).alias("got"), F.sum(F.col("docs") * F.col("size") * x * r * (1 - r / most)).alias("slope")
        )
        s = state.join(sums, state.source.eqNullSafe(sums.source), "left").select(state["*"], "got", "slope")
        over = F.col("got") > F.col("target")
        s = s.withColumns({"low": F.when(over, F.col("low")).otherwise(F.col("tilt")), "high": F.when(over, F.col("tilt")).otherwise(F.col("high"))})
        step = F.col("tilt") - (F.col("got") - F.col("target")) / F.greatest(F.col("slope"), F.lit(1e-300))
        s = s.withColumns({
            "gap": F.when(F.col("got").isNull() | (F.col("target") >= most * F.col("source_size")) | (F.col("target") <= 0), 0.0).otherwise(F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))),
            "tilt": F.when(F.col("got").isNull(), 0.0).when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2),
        })
        old, state = state, scratch.save(s.drop("got", "slope"), f"state{k}")
        scratch.drop(f"state{k - 1}")
        if (state.agg(F.max("gap")).first()[0] or 0.0) < near:
            break
    return state.drop("low", "high", "gap")


def rate(z, most: float):
    e = F.exp(F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0)))
    return F.lit(most) * e / (F.lit(most - 1.0) + e)


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: int = 3, per_bucket: int = 50_000) -> DataFrame:
    """The rows of `docs` (with doc_id, source and a long column `size`) with source_size, target, copies and taken."""
    scratch = Scratch(docs.sparkSession)
    extra = {c: f"_in_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "source", "size")}
    rows = docs.withColumnsRenamed(extra)
    small = rows.select("doc_id", "source", "size")
    cells = scratch.save(small.groupBy("source", "size").agg(F.count("*").alias("docs")), "cells")
    targets = scratch.save(source_targets(cells.groupBy("source").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("size")).alias("source_size")), weights, float(most)), "targets")
    state = solve_dual(cells, targets, scratch, most=float(most))
    n = cells.agg(F.sum("docs")).first()[0] or 0
    buckets = max(1, -(-n // per_bucket))

    def allot(frame: pd.DataFrame) -> pd.DataFrame:
        """Copies for each cell of one source; a cell is a distinct size, so the frame doesn't grow with the documents."""
        frame = frame.sort_values("size", ascending=False, ignore_index=True)
        copies, owed = [], 0.0
        for size, docs, r in zip(frame["size"], frame["docs"], frame["r"], strict=True):
            owed += docs * size * r
            k = min(most * docs, max(0, round(owed / size))) if size else docs
            owed -= k * size
            copies.append(int(k))
        return frame.assign(copies=copies)

    x = F.col("size") * F.col("n") / F.col("source_size")
    r = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= most * F.col("source_size"), float(most)).otherwise(rate(F.col("tilt") * x, float(most)))
    rated = cells.join(state, cells.source.eqNullSafe(state.source)).select(state.source, "size", "docs", r.alias("r"), "source_size", "target")
    allotted = scratch.save(rated.groupBy("source").applyInPandas(allot, "source string, size long, docs long, r double, source_size long, target double, copies long"), "allotted")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("_bucket")
    dealt = small.groupBy("source", "size", bucket).agg(F.count("*").alias("_in_bucket"))
    dealt = dealt.withColumn("_before", F.sum("_in_bucket").over(Window.partitionBy("source", "size").orderBy("_bucket")) - F.col("_in_bucket"))
    a = allotted.alias("a")
    shares = dealt.alias("d").join(a, F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.size") == F.col("a.size"))).select(
        F.col("d.source").alias("_source"), F.col("d.size").alias("_size"), F.col("_bucket").alias("_share"), "_before", "source_size", "target", F.col("copies").alias("_cell"), F.col("docs").alias("_docs")
    )
    ranked = rows.select("*", bucket).withColumn("_rank", F.row_number().over(Window.partitionBy("source", "size", "_bucket").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")))
    placed = ranked.join(shares, ranked.source.eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_bucket") == F.col("_share")))
    whole = F.floor(F.col("_cell") / F.col("_docs"))
    copies = (whole + F.when(F.col("_rank") + F.col("_before") <= F.col("_cell") - whole * F.col("_docs"), 1).otherwise(0)).cast("long")
    out = placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    kept = [F.col(extra.get(c, c)).alias(c) for c in docs.columns if c not in ("source_size", "target", "copies", "taken")]
    return out.select(*kept, "source_size", "target", "copies", "taken")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row `copies` times."""
    copy = free_name(mixed, "_copy")
    return mixed.filter("copies > 0").withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop(copy)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    return mix(docs.select("doc_id", "source", word_count("text").alias("size")), **options).drop("source")
