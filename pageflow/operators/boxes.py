"""Joins and merging of boxes within a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, inside, iou
from .grouped import by_group

SIDES = ("x1", "y1", "x2", "y2")


def pairs(boxes: DataFrame, condition, *, same_class: bool = True, ordered: bool = True) -> DataFrame:
    """Pairs (a_, b_) of boxes on one page for which condition(box a, box b) holds; an equi join on page, the rest filters."""
    a = boxes.select(*(F.col(c).alias(f"a_{c}") for c in boxes.columns))
    b = boxes.select(*(F.col(c).alias(f"b_{c}") for c in boxes.columns))
    on = (F.col("a_page") == F.col("b_page")) & ((F.col("a_bid") < F.col("b_bid")) if ordered else (F.col("a_bid") != F.col("b_bid")))
    if same_class:
        on = on & (F.col("a_cls") == F.col("b_cls"))
    return a.join(b, on).filter(condition(box("a_"), box("b_")))


def overlap_pairs(boxes: DataFrame, threshold: float = 0.2) -> DataFrame:
    found = pairs(boxes, lambda a, b: iou(a, b) > threshold)
    return found.withColumn("iou", iou(box("a_"), box("b_")))


def merge(boxes: DataFrame, threshold: float = 0.2) -> DataFrame:
    """page, cls, x1..y2, members: the bounding box of each connected group of overlapping boxes of one class and page.

    A page's boxes are few (one detector run), so they are one group; single boxes pass unchanged, and merged boxes
    aren't tested again.
    """

    def one(rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1:
            return [(*rows[0][:2], *rows[0][3:], 1)]
        parent = list(range(len(rows)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for i, (_, _, _, ax1, ay1, ax2, ay2) in enumerate(rows):
            for j in range(i):
                _, _, _, bx1, by1, bx2, by2 = rows[j]
                w, h = min(ax2, bx2) - max(ax1, bx1), min(ay2, by2) - max(ay1, by1)
                common = w * h if w > 0 and h > 0 else 0
                union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - common
                if union > 0 and common / union > threshold:
                    parent[find(i)] = find(j)
        merged: dict[int, list] = {}
        for k, (page, cls, _, x1, y1, x2, y2) in enumerate(rows):
            m = merged.setdefault(find(k), [page, cls, x1, y1, x2, y2, 0])
            m[2:] = min(m[2], x1), min(m[3], y1), max(m[4], x2), max(m[5], y2), m[6] + 1
        return [tuple(m) for m in merged.values()]

    schema = "page long, cls string, x1 long, y1 long, x2 long, y2 long, members long"
    return by_group(boxes.select("page", "cls", "bid", *SIDES), ["page", "cls"], ["bid"], one, schema)


def match_bubbles(boxes: DataFrame) -> DataFrame:
    """page, bubble, txt: each bubble in its order takes the best text not yet taken.

    Candidates have their centre inside the bubble or within half its diagonal; those inside come first, then by
    distance, then by order. Centres are doubled, so all comparisons are of integers.
    """
    b = boxes.filter("cls = 'bubble'").select("page", F.col("bid").alias("bubble"), *(F.col(c).alias(f"b_{c}") for c in SIDES))
    t = boxes.filter("cls = 'text'").select("page", F.col("bid").alias("txt"), (F.col("x1") + F.col("x2")).alias("tx"), (F.col("y1") + F.col("y2")).alias("ty"))
    within = F.col("tx").between(2 * F.col("b_x1"), 2 * F.col("b_x2")) & F.col("ty").between(2 * F.col("b_y1"), 2 * F.col("b_y2"))
    dx, dy = F.col("tx") - F.col("b_x1") - F.col("b_x2"), F.col("ty") - F.col("b_y1") - F.col("b_y2")
    w, h = F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    near = b.join(t, "page").withColumn("away", (~within).cast("int")).withColumn("d2", dx * dx + dy * dy).filter((F.col("away") == 0) | (F.col("d2") <= w * w + h * h))
    ranked = near.groupBy("page", "bubble").agg(F.array_sort(F.collect_list(F.struct("away", "d2", "txt"))).alias("cand"))
    queued = ranked.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("bubble", F.transform("cand", lambda c: c["txt"]).alias("texts")))).alias("queue"))
    fold = F.aggregate(
        "queue",
        F.array().cast("array<struct<bubble:bigint,txt:bigint>>"),
        lambda done, q: F.concat(
            done, F.transform(F.slice(F.filter(q["texts"], lambda x: ~F.exists(done, lambda d: d["txt"] == x)), 1, 1), lambda x: F.struct(q["bubble"].cast("long").alias("bubble"), x.cast("long").alias("txt")))
        ),
    )
    return queued.select("page", F.inline(fold))


def counts_by(boxes: DataFrame, *keys: str | Column) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.count("*").alias("n"))


def match_free(boxes: DataFrame, matched: DataFrame) -> DataFrame:
    """page, bubble, txt: each bubble without a text takes, in its order, the first free text inside it not yet taken."""
    b = boxes.filter("cls = 'bubble'").join(matched.select("page", F.col("bubble").alias("bid")), ["page", "bid"], "left_anti")
    b = b.select("page", F.col("bid").alias("bubble"), *(F.col(c).alias(f"b_{c}") for c in SIDES))
    t = boxes.filter("cls = 'free_text'").select("page", F.col("bid").alias("txt"), *(F.col(c).alias(f"t_{c}") for c in SIDES))
    held = b.join(t, "page").filter(inside(box("t_"), box("b_")))
    queue = held.groupBy("page", "bubble").agg(F.array_sort(F.collect_list("txt")).alias("texts"))
    queue = queue.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("bubble", "texts"))).alias("queue"))
    fold = F.aggregate(
        "queue",
        F.array().cast("array<struct<bubble:bigint,txt:bigint>>"),
        lambda done, q: F.concat(done, F.transform(F.slice(F.array_except(q["texts"], F.transform(done, lambda d: d["txt"])), 1, 1), lambda x: F.struct(q["bubble"].cast("long").alias("bubble"), x.cast("long").alias("txt")))),
    )
    return queue.select("page", F.inline(fold))


def detected(boxes: DataFrame, confidence: float = 0.35, classes: tuple[str, ...] = ("bubble", "text", "free_text")) -> DataFrame:
    """The boxes of known classes that the detector is sure enough of (column `conf`)."""
    return boxes.filter((F.col("conf") >= confidence) & F.col("cls").isin(*classes))


def structure(boxes: DataFrame) -> DataFrame:
    """page, kind, bubble, txt: the bubbles with their texts, and the free texts that no bubble took (bubble null).

    Bubbles take texts first; those left without one take free texts. Bubbles and texts that find no partner drop out.
    The two folds run over different texts, so one after the other gives what one pass in bubble order gives.
    """
    matched = match_bubbles(boxes)
    more = match_free(boxes, matched)
    left = boxes.filter("cls = 'free_text'").select("page", F.col("bid").alias("txt")).join(more, ["page", "txt"], "left_anti")
    pairs = matched.unionByName(more).select("page", F.lit("bubble").alias("kind"), "bubble", "txt")
    return pairs.unionByName(left.select("page", F.lit("free").alias("kind"), F.lit(None).cast("long").alias("bubble"), "txt"))


def debug_boxes(boxes: DataFrame, colours: dict[str, tuple[int, int, int]]) -> DataFrame:
    """page, bid, x1..y2 and the colour (r, g, b) in which each known class is outlined."""
    colour = F.create_map(*(x for cls, rgb in colours.items() for x in (F.lit(cls), F.array(*map(F.lit, rgb)))))
    return boxes.withColumn("rgb", colour[F.col("cls")]).filter("rgb is not null").select("page", "bid", *SIDES, *(F.col("rgb")[k].alias(c) for k, c in enumerate("rgb")))
