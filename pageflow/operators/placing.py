"""Texts outside bubbles: widths, anchors and moves off occupied places; glyph fallback and font runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import by_group


def free_width(width: Column, height: Column, size: Column, attached: Column, left_clear: Column, right_clear: Column, *, padding: float = 0.05, overflow: float = 0.2, margin: int = 6) -> dict[str, Column]:
    """target_width and attached of a text outside bubbles.

    Wide boxes may overflow; narrow ones get room for 3.4 signs, at most 2.4 times their width. Where that is more than
    the box, it is held by the clear space beside it, and a side that is blocked becomes the side the text leans on.
    """
    own = width * (1 - 2 * padding)
    wish = F.greatest(own * F.when(width >= height, 1.0 + overflow).otherwise(1.0), F.least(size * 3.4, width * 2.4))
    left_open, right_open = left_clear >= margin + 2, right_clear >= margin + 2
    leans = F.when(attached != "none", attached).when(left_open & right_open, "none").when(right_open, "left").when(left_open, "right").otherwise("none")
    room = lambda clear: width + F.greatest(F.lit(0), clear - margin)
    cap = (
        F.when(leans == "left", room(right_clear))
        .when(leans == "right", room(left_clear))
        .when(left_open & right_open, width + 2 * F.greatest(F.lit(0), F.least(left_clear, right_clear) - margin))
        .otherwise(width)
    )
    grows = wish > width
    return {"target_width": F.when(grows, F.least(wish, F.greatest(cap, own))).otherwise(wish), "attached": F.when(grows, leans).otherwise(attached)}


def free_anchor(box: dict[str, Column], text_width: Column, text_height: Column, attached: Column, vertical: Column, *, margin: int = 5) -> dict[str, Column]:
    """align, anchor, ax, ay and the box x1..y2 that the text will take."""
    left, right = ~vertical & (attached == "left"), ~vertical & (attached == "right")
    ax = F.when(left, box["x1"] - margin).when(right, box["x2"] + margin).otherwise((box["x1"] + box["x2"]) / 2)
    ay = F.when(vertical | (text_height > box["y2"] - box["y1"]), (box["y1"] + box["y2"]) / 2).otherwise(box["y1"] + text_height / 2)
    x1 = F.when(left, ax).when(right, ax - text_width).otherwise(ax - text_width / 2)
    return {
        "align": F.when(left, "left").when(right, "right").otherwise("center"), "anchor": F.when(left, "lm").when(right, "rm").otherwise("mm"),
        "ax": ax, "ay": ay, "x1": x1, "y1": ay - text_height / 2, "x2": x1 + text_width, "y2": ay + text_height / 2,
    }


def moved_off(rect: tuple, taken: Iterable[tuple], width: float, height: float, rounds: int = 3) -> tuple:
    """The rectangle moved off the taken ones by the smallest move each time, then kept on the page (touching counts as meeting)."""
    x1, y1, x2, y2 = rect
    for _ in range(rounds):
        still = True
        for a1, b1, a2, b2 in taken:
            if x1 <= a2 and a1 <= x2 and y1 <= b2 and b1 <= y2:
                dx, dy = min(((0, b1 - y2), (0, b2 - y1), (a1 - x2, 0), (a2 - x1, 0)), key=lambda m: abs(m[0]) + abs(m[1]))
                x1, x2, y1, y2, still = x1 + dx, x2 + dx, y1 + dy, y2 + dy, False
        if still:
            break
    to_x, to_y = max(0, min(x1, width - (x2 - x1))), max(0, min(y1, height - (y2 - y1)))
    return to_x, to_y, to_x + x2 - x1, to_y + y2 - y1


def nudge(rects: DataFrame, width: float, height: float) -> DataFrame:
    """page, ord and moved x1..y2 of the free texts (`free`), in order; each joins the taken ones of its page.

    The order matters, so a page, which holds few texts, is one group.
    """

    def one(rows: list[tuple]) -> list[tuple]:
        taken, out = [], []
        for page, free, place, *sides in rows:
            rect = tuple(sides)
            if free:
                rect = moved_off(rect, taken, width, height)
                out.append((page, place, *map(float, rect)))
            taken.append(rect)
        return out

    schema = "page long, ord long, x1 double, y1 double, x2 double, y2 double"
    return by_group(rects.select("page", "free", "ord", "x1", "y1", "x2", "y2"), ["page"], ["free", "ord"], one, schema)


def font_chain(fonts: DataFrame) -> DataFrame:
    """font, fallback, place: each font itself, then standard, narration, all others by place, system fonts last.

    `fonts` has font, role, place and system; a list of installed fonts, so this product of it with itself is small.
    """
    first = F.when(F.col("role") == "standard", 0).when(F.col("role") == "narration", 1).otherwise(2) + F.when(F.col("system"), 10).otherwise(0)
    every = F.array_sort(F.collect_list(F.struct(first.alias("first"), "place", "font")))
    chain = fonts.groupBy().agg(every.alias("chain")).select(F.transform("chain", lambda x: x["font"]).alias("chain"))
    own = fonts.filter("not system").select("font").distinct().crossJoin(F.broadcast(chain))  # one row
    return own.select("font", F.posexplode(F.array_distinct(F.concat(F.array("font"), "chain"))).alias("place", "fallback"))


def resolve_glyphs(signs: DataFrame, chain: DataFrame, coverage: DataFrame) -> DataFrame:
    """signs (font, sign, ...) with `drawn_by`: the first font of the chain that covers the sign; else, and for spaces of any width, the font itself."""
    wanted = signs.select("font", "sign").distinct()
    able = wanted.join(chain, "font").join(coverage.select(F.col("font").alias("fallback"), "sign").distinct(), ["fallback", "sign"])
    first = able.groupBy("font", "sign").agg(F.min_by("fallback", "place").alias("by"))
    return signs.join(first, ["font", "sign"], "left").withColumn("drawn_by", F.when(F.col("sign").rlike(r"\A\p{Zs}*\z"), F.col("font")).otherwise(F.coalesce("by", "font"))).drop("by")


def font_runs(signs: DataFrame) -> DataFrame:
    """line, run, font, text, x and width of the runs of one font in a line; signs has line, pos, sign, drawn_by and advance."""
    order = Window.partitionBy("line").orderBy("pos")
    s = signs.withColumn("x", F.coalesce(F.sum("advance").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("fresh", F.when(F.col("drawn_by") == F.lag("drawn_by").over(order), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sign"))), lambda x: x["sign"]), "")
    return s.groupBy("line", "run").agg(F.first("drawn_by").alias("font"), text.alias("text"), F.min("x").alias("x"), F.sum("advance").alias("width"))


def body_sizes(texts: DataFrame, metrics: DataFrame, key: list[str]) -> DataFrame:
    """key, body_width, body_height: median extent of the visible glyphs of `text` at `size`; 0 where there are none.

    `metrics` (sign, width, height) holds extents per em of the glyphs that are drawn; signs without one don't count.
    """
    signs = texts.select(*key, "size", F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("sign"))
    seen = signs.filter(~F.col("sign").rlike(r"(?U)\s")).join(metrics.filter("width > 0 and height > 0"), "sign")
    body = seen.groupBy(*key).agg(F.median(F.col("width") * F.col("size")).alias("w"), F.median(F.col("height") * F.col("size")).alias("h"))
    found = texts.select(*key).distinct().join(body, key, "left")
    return found.select(*key, F.coalesce("w", F.lit(0.0)).alias("body_width"), F.coalesce("h", F.lit(0.0)).alias("body_height"))


def height_ratio(body_height: Column, reference: Column) -> Column:
    """Height of a body over a reference of one pixel at least."""
    return body_height / F.greatest(reference.cast("double"), F.lit(1.0))
