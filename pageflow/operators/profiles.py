"""One-dimensional profiles: bands, moving averages, percentiles, style margins, circular means, size harmonising."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _islands(on: DataFrame, keys: list[str], merge_gap: int, min_size: int) -> DataFrame:
    """keys, start, stop of the runs of positions; runs at most `merge_gap` apart are one, short ones go afterwards."""
    order = Window.partitionBy(*keys).orderBy("pos")
    on = on.withColumn("_fresh", F.when(F.col("pos") - F.lag("pos").over(order) - 1 <= merge_gap, 0).otherwise(1))
    on = on.withColumn("_band", F.sum("_fresh").over(order))
    found = on.groupBy(*keys, "_band").agg(F.min("pos").alias("_start"), (F.max("pos") + 1).alias("_stop"))
    return found.filter(F.col("_stop") - F.col("_start") >= min_size).drop("_band")


def bands(profile: DataFrame, *, threshold: float, merge_gap: int = 2, min_size: int = 3) -> DataFrame:
    """vec_id, start, stop of runs above the threshold."""
    return _islands(profile.filter(F.col("val") > threshold), ["vec_id"], merge_gap, min_size).withColumnsRenamed({"_start": "start", "_stop": "stop"})


def refined_bands(profile: DataFrame, cross: int) -> DataFrame:
    """bands() cut again at 40 % of their own peak, where that gives two parts or more and the largest is 42 % of the band."""
    coarse = bands(profile, threshold=max(2.0, 0.03 * cross))
    inside = profile.join(coarse, "vec_id").filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop")))
    cut = F.greatest(F.lit(2.0), 0.4 * F.max("val").over(Window.partitionBy("vec_id", "start")))
    keys = ["vec_id", "start", "stop"]
    parts = _islands(inside.withColumn("_cut", cut).filter("val > _cut"), keys, 1, 3)
    parts = parts.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_start").alias("start"), F.col("_stop").alias("stop"))).alias("parts"))
    largest = F.array_max(F.transform("parts", lambda p: p["stop"] - p["start"]))
    good = (F.size("parts") >= 2) & (largest >= 0.42 * (F.col("stop") - F.col("start")))
    own = F.array(F.struct("start", "stop"))
    return coarse.join(parts, keys, "left").select("vec_id", F.inline(F.when(F.coalesce(good, F.lit(False)), F.col("parts")).otherwise(own)))


def band_summary(profile: DataFrame, cross: int) -> DataFrame:
    """vec_id, n, thickness, pitch, score over the refined bands of at least 55 % of the widest.

    n bands with median thickness and median distance of centres; score is n times 1/2 to 1, by how even they are.
    Profiles without bands: 0, 0, 0 and -1.
    """
    b = refined_bands(profile, cross).withColumn("size", F.col("stop") - F.col("start"))
    b = b.withColumn("widest", F.max("size").over(Window.partitionBy("vec_id"))).filter(F.col("size") >= F.col("widest") * 0.55)
    centre = (F.col("start") + F.col("stop")) / 2
    b = b.withColumn("gap", centre - F.lag(centre).over(Window.partitionBy("vec_id").orderBy("start")))
    even = 1 - F.least(F.lit(1.0), F.stddev_pop("size") / F.greatest(F.avg("size"), F.lit(1e-6)))
    s = b.groupBy("vec_id").agg(F.count("*").alias("n"), F.median("size").alias("thickness"), F.coalesce(F.median("gap"), F.lit(0.0)).alias("pitch"), (F.count("*") * (0.5 + 0.5 * even)).alias("score"))
    return profile.select("vec_id").distinct().join(s, "vec_id", "left").select("vec_id", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("n", 0), ("thickness", 0.0), ("pitch", 0.0), ("score", -1.0))))


def widest_average_band(profile: DataFrame, k: int = 7, share: float = 0.15) -> DataFrame:
    """vec_id, start, stop of the widest run of the moving average above `share` of its peak; the first of equals."""
    smooth = moving_average(profile, k).withColumn("peak", F.max("mean").over(Window.partitionBy("vec_id"))).filter(F.col("mean") > F.col("peak") * share)
    found = _islands(smooth, ["vec_id"], 0, 1)
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc(F.col("_stop") - F.col("_start")), "_start"))
    return found.withColumn("_place", place).filter("_place = 1").select("vec_id", F.col("_start").alias("start"), F.col("_stop").alias("stop"))


# Style names in the order of the classes, and the least confidence that each needs.
STYLES = {"standard": 0.0, "pop": 0.46, "shouting": 0.42, "handwriting": 0.40, "angry": 0.38, "cute": 0.38, "scared": 0.38, "embarrassment": 0.36, "narration": 0.34}


def choose_style(rows: DataFrame, *, low: float = 0.24, margin: float = 0.04, expressive: float = 0.55, free_text: float = 0.70, enabled: bool = True) -> DataFrame:
    """rows (best, top, margin, angle, expressive, cls) with `style`: the predicted one, or the fallback of its class.

    Free text falls back to narration, other text to standard. Predictions outside the known styles count as standard.
    """
    names = F.array(*map(F.lit, STYLES))
    least = F.array(*(F.lit(v) for v in STYLES.values()))
    predicted = F.coalesce(F.get(names, F.col("best").cast("int")), F.lit("standard"))
    fallback = F.when(F.col("cls") == "free_text", "narration").otherwise("standard")
    weak_free = (F.col("cls") == "free_text") & (F.col("top") < free_text)
    weak = (
        F.coalesce(F.col("expressive") < expressive, F.lit(False))
        | (F.col("top") < low)
        | (F.col("top") < F.coalesce(F.get(least, F.col("best").cast("int")), F.lit(low)))
        | ((F.col("margin") < margin) & (F.abs("angle") <= 15.0))
        | weak_free
    )
    return rows.withColumn("style", F.when(predicted == "standard", fallback).when(weak if enabled else weak_free, fallback).otherwise(predicted))


def moving_average(profile: DataFrame, k: int = 7) -> DataFrame:
    """Centred mean over k positions; positions beyond the ends count as 0."""
    around = Window.partitionBy("vec_id").orderBy("pos").rowsBetween(-(k // 2), k // 2)
    return profile.select("vec_id", "pos", F.round(F.sum("val").over(around) / k, 9).alias("mean"))


def top2_margin(profile: DataFrame) -> DataFrame:
    """vec_id, best position, its softmax probability and its lead over the next; the first of equals wins."""
    per = Window.partitionBy("vec_id")
    p = profile.withColumn("p", F.exp("val") / F.sum(F.exp("val")).over(per))
    p = p.withColumn("place", F.row_number().over(per.orderBy(F.desc("val"), "pos"))).filter("place <= 2")
    out = p.groupBy("vec_id").agg(F.max(F.when(F.col("place") == 1, F.col("pos"))).alias("best"), F.max(F.when(F.col("place") == 1, F.col("p"))).alias("top"), F.max(F.when(F.col("place") == 2, F.col("p"))).alias("second"))
    return out.select("vec_id", "best", F.round("top", 9).alias("top"), F.round(F.col("top") - F.col("second"), 9).alias("margin"))


def harmonise(sizes: DataFrame) -> DataFrame:
    """page, style, ord, size, harmonised: sizes of one page and style drawn to their main cluster.

    Needs four members. Sizes in order form chains while each is at most 1.22 times the last; the largest chain, the first
    of equals, must hold 60 %. Its rounded median replaces sizes within 25 % of it or over 1.5 times it.
    """
    group = Window.partitionBy("page", "style")
    order = group.orderBy("size", "ord")
    s = sizes.withColumn("n", F.count("*").over(group))
    s = s.withColumn("fresh", F.when(F.col("size") <= F.lag("size").over(order) * 1.22, 0).otherwise(1))
    s = s.withColumn("chain", F.sum("fresh").over(order))
    chains = s.groupBy("page", "style", "chain").agg(F.count("*").alias("k"), F.percentile("size", 0.5).alias("middle"), F.first("n").alias("n"))
    main = chains.withColumn("place", F.row_number().over(group.orderBy(F.desc("k"), "chain"))).filter("place = 1 and n >= 4 and k * 10 >= n * 6")
    centre = F.bround("middle").cast("long")
    joined = s.join(main.select("page", "style", centre.alias("centre")), ["page", "style"], "left")
    snap = (F.abs(F.col("size") - F.col("centre")) <= 0.25 * F.col("centre")) | (F.col("size") > 1.5 * F.col("centre"))
    return joined.select("page", "style", "ord", "size", F.when(snap, F.col("centre")).otherwise(F.col("size")).alias("harmonised"))


def top2_of_views(profile: DataFrame, views: DataFrame) -> DataFrame:
    """item, best, top and margin as in top2_margin, of the softmax averaged over the views (item, vec_id) of each item."""
    p = profile.withColumn("p", F.exp("val") / F.sum(F.exp("val")).over(Window.partitionBy("vec_id")))
    mean = p.join(views, "vec_id").groupBy("item", "pos").agg(F.round(F.avg("p"), 9).alias("p"))
    # Pairs of (probability, -position): the greatest is the first of the most probable, and one a class at most.
    by = mean.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("p", (-F.col("pos")).alias("at"))), asc=False).alias("by"))
    lead = F.round(F.get("by", F.lit(0))["p"] - F.get("by", F.lit(1))["p"], 9)
    return by.select("item", (-F.get("by", F.lit(0))["at"]).alias("best"), F.get("by", F.lit(0))["p"].alias("top"), lead.alias("margin"))
