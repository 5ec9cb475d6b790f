"""Decisions of text layout on columns: sizes, styles, sides, directions, patches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Box

# Sizes in pixels, and the shape and length from which a bubble counts as tall.
LEAST_SIZE, READABLE_SIZE, MOST_SIZE = 5, 16, 80
TALL_RATIO, TALL_SIGNS = 1.8, 8


def _at(x: float) -> Column:
    return F.lit(float(x))


def size_start(size: Column) -> Column:
    """Size at which a search starts: the measured one, kept readable."""
    return F.greatest(F.lit(LEAST_SIZE), F.least(F.lit(MOST_SIZE), F.greatest(F.bround(size).cast("int"), F.lit(READABLE_SIZE + 2))))


def size_most(size: Column, growth: float = 1.2) -> Column:
    whole = F.greatest(F.lit(1), F.bround(size).cast("int"))
    return F.greatest(F.lit(LEAST_SIZE), F.least(F.lit(MOST_SIZE), F.greatest(whole, F.floor(whole * growth).cast("int"))))


def size_preferred_least(size: Column, shrink: float = 0.8) -> Column:
    return F.greatest(F.lit(LEAST_SIZE), F.least(F.lit(MOST_SIZE), F.ceil(size * shrink).cast("int")))


def measured_size(glyph_height: Column, crop_height: Column) -> Column:
    """Font size of a crop: 1.18 times the glyph height, 0.7 of the crop where none was found, 20 without a crop."""
    return F.when(glyph_height > 0, F.greatest(F.lit(1), F.bround(glyph_height * 1.18).cast("int"))).when(crop_height > 0, F.greatest(F.lit(1), F.bround(crop_height * 0.7).cast("int"))).otherwise(20)


def width_ratios(ratio: Column) -> Column:
    """Shares of the width to try, in order."""
    more = F.when(ratio <= 0.9, F.array(_at(0.82), _at(0.72))).when(ratio >= TALL_RATIO, F.array(_at(0.78), _at(0.66), _at(0.56))).when(ratio >= 1.2, F.array(_at(0.84), _at(0.74)))
    return F.array_distinct(F.concat(F.array(_at(1.0), _at(0.9)), F.coalesce(more, F.array().cast("array<double>"))))


def bubble_style(style: dict[str, Column], ratio: Column, signs: Column, least_side: Column, size: Column) -> dict[str, Column]:
    """scale, letter, line, bold and oversample of a style, overridden in tall bubbles and then in small ones."""
    tall = (ratio >= TALL_RATIO) & (signs >= TALL_SIGNS)
    small = (least_side <= 70) | (size <= READABLE_SIZE)

    def pick(name: str, in_tall: float, in_small: float, first, second) -> Column:
        once = F.when(tall, first(style[name], _at(in_tall))).otherwise(style[name])
        return F.when(small, second(once, _at(in_small))).otherwise(once)

    return {
        "scale": pick("scale", 0.90, 0.92, F.least, F.greatest),
        "letter": pick("letter", -0.8, -0.25, F.least, F.greatest),
        "line": pick("line", 1.22, 1.16, F.greatest, F.greatest),
        "bold": style["bold"] | small,
        "oversample": F.greatest(style["oversample"], F.when(small, 3).otherwise(2)),
    }


def free_style(style: dict[str, Column], least_side: Column, size: Column) -> dict[str, Column]:
    """The override of small texts outside bubbles."""
    small = (least_side <= 60) | (size <= READABLE_SIZE)
    return style | {
        "scale": F.when(small, F.greatest(style["scale"], _at(0.95))).otherwise(style["scale"]),
        "letter": F.when(small, F.greatest(style["letter"], _at(-0.1))).otherwise(style["letter"]),
        "bold": style["bold"] | small,
        "oversample": F.when(small, F.greatest(style["oversample"], F.lit(3))).otherwise(style["oversample"]),
    }


def is_vertical(width: Column, height: Column, size: Column, text: Column, in_bubble: Column, threshold: float = 4.0, force: float = 6.0) -> Column:
    """Very long boxes are set vertically; in bubbles also long ones whose text has no space and a readable size."""
    aspect = height / width
    mild = in_bubble & (height > width * 1.2) & (size >= READABLE_SIZE) & ~text.contains(" ") & (aspect >= threshold)
    return F.when(width > 0, (aspect >= force) | mild).otherwise(False)


def turns_vertical(fitted: Column, size: Column, width: Column, height: Column, text: Column, in_bubble: Column, shrink: float = 0.75) -> Column:
    """Whether a horizontal text that shrank too far is set vertically after all."""
    barred = (text == "") | (~in_bubble & (height < width * 4)) | (text.contains(" ") & (height <= width * 2))
    return F.coalesce(~barred & (fitted < F.greatest(F.lit(1), size) * shrink), F.lit(False))


def side(left: Column, right: Column, least: float) -> Column:
    """left, right or none by the strengths of the lines found; the stronger wins, equals give none."""
    a, b = left >= least, right >= least
    return F.when(a & (~b | (left > right)), "left").when(b & (~a | (right > left)), "right").otherwise("none")


def bubble_alignment(attached: Column, text: Box, bubble: Box, margin: int = 5, safe: int = 10) -> dict[str, Column]:
    """align, anchor, cx and cy of a text in its bubble."""
    left, right = attached == "left", attached == "right"
    return {
        "align": F.when(left, "left").when(right, "right").otherwise("center"),
        "anchor": F.when(left, "lm").when(right, "rm").otherwise("mm"),
        "cx": F.when(left, F.greatest(text["x1"] - margin, bubble["x1"] + safe)).when(right, F.least(text["x2"] + margin, bubble["x2"] - safe)).otherwise(F.floor((bubble["x1"] + bubble["x2"]) / 2)),
        "cy": F.floor((bubble["y1"] + bubble["y2"]) / 2),
    }


def expand_within(b: Box, pad: int, outer: Box | None = None, keep: int = 2) -> Box:
    """The box widened by `pad`, up to `keep` inside the outer box, and never smaller than it was."""
    out = {}
    for name in b:
        grow = -pad if name.endswith("1") else pad
        inner, outward = (F.greatest, F.least) if grow < 0 else (F.least, F.greatest)
        moved = b[name] + grow
        if outer is not None:
            moved = inner(moved, outer[name] + (keep if grow < 0 else -keep))
        out[name] = outward(moved, b[name])
    return out


def context_patch(b: Box, width: int, height: int, least: int = 50, most: int = 256) -> Box:
    """The box with the surroundings that an eraser sees: 0.6 of the longer side, within bounds, cut at the page."""
    pad = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(0.6 * F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]))))
    return {"x1": F.greatest(F.lit(0), b["x1"] - pad), "y1": F.greatest(F.lit(0), b["y1"] - pad), "x2": F.least(F.lit(width), b["x2"] + pad), "y2": F.least(F.lit(height), b["y2"] + pad)}


def letterbox(width: Column, height: Column, to_width: int, to_height: int) -> dict[str, Column]:
    """w, h, left and top of an image scaled down (never up) into a canvas and centred."""
    r = F.least(F.lit(to_width) / width, F.lit(to_height) / height, F.lit(1.0))
    w, h = F.bround(width * r).cast("long"), F.bround(height * r).cast("long")
    return {"w": w, "h": h, "left": F.floor((F.lit(to_width) - w) / 2), "top": F.floor((F.lit(to_height) - h) / 2)}


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def hex_rgb(text: Column, default: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """array(r, g, b) of `#rrggbb` or `rgb(r, g, b)` / `rgba(...)`; the default where neither is given."""
    t = F.trim(text)
    part = lambda k: F.conv(F.substring(F.replace(t, F.lit("#"), F.lit("")), 2 * k + 1, 2), 16, 10).cast("int")
    numbers = F.transform(F.slice(F.regexp_extract_all(t, F.lit(r"([0-9.]+)"), F.lit(1)), 1, 3), lambda x: x.cast("double").cast("int"))
    is_call = t.rlike(r"^rgba?\(\s*[0-9.]+\s*,\s*[0-9.]+\s*,\s*[0-9.]+")
    return F.when(t.rlike("^#?[0-9A-Fa-f]{6}$"), F.array(part(0), part(1), part(2))).when(is_call, numbers).otherwise(F.array(*map(F.lit, default)))


def char_ratio_target(value: Column, enabled: bool = True) -> Column:
    """The glyph-to-box ratio that a fit aims at; null if it is no number, not positive or switched off."""
    ratio = value.try_cast("double")
    return F.when(F.lit(enabled) & (ratio > 0), ratio)


def render_kind(vertical: Column, angle: Column, least: float = 2.0) -> Column:
    """How a planned text is drawn: vertical before rotated (beyond `least` degrees either way) before plain."""
    return F.when(vertical, "vertical").when(F.abs(angle) > least, "rotated").otherwise("plain")


def colours_on(luma: Column, fill: Column, outline: Column, dark: float = 100.0) -> dict[str, Column]:
    """Fill and outline of a text above a background of this mean luma: swapped if it is dark, kept if it is unknown."""
    swap = F.coalesce(luma < dark, F.lit(False))
    return {"fill": F.when(swap, outline).otherwise(fill), "outline": F.when(swap, fill).otherwise(outline)}
