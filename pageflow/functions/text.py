"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_DOTS = "[.。．・]"
CJK = "[぀-ヿ㐀-䶿一-鿿가-힣＀-￯]"


def ellipsis(text: Column) -> Column:
    """White space between dots goes; two or more dots, or any ellipsis signs, become one centred ellipsis."""
    joined = F.regexp_replace(text, f"(?<={_DOTS})[ \\t\\n\\r\\f]+(?={_DOTS})", "")
    return F.regexp_replace(joined, f"[…‥]+|{_DOTS}{{2,}}", "⋯")


def valid_text(text: Column) -> Column:
    """Not blank, not only digits and punctuation, one sign only if it is CJK, and with a letter or CJK sign."""
    t = F.trim(text)
    return (F.length(t) > 0) & ((F.length(t) > 1) | t.rlike(CJK)) & (t.rlike(r"\p{L}") | t.rlike(CJK))


def valid_element(text: Column, width: Column, height: Column, least: int = 10) -> Column:
    """A valid text whose box is at least `least` pixels on both sides; white space of any script is trimmed."""
    return valid_text(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) & (width >= least) & (height >= least)


def without_spaces(text: Column) -> Column:
    """A recognised text without the plain spaces between its signs."""
    return F.replace(text, F.lit(" "), F.lit(""))


def response_key(line: Column) -> Column:
    key = F.rtrim(F.regexp_extract(line, r"^([0-9.]+)\.\s*", 1), F.lit("."))
    return F.when(key != "", key)


def response_text(line: Column, failure: str = "번역 불가") -> Column:
    """From the first ( to the last ), else the rest without outer blanks; the failure mark gives the empty text."""
    rest = F.regexp_replace(line, r"^([0-9.]+)\.\s*", "")
    inner = F.regexp_extract(rest, r"(?s)\((.*)\)", 1)
    text = F.when(rest.rlike(r"(?s)\(.*\)"), inner).otherwise(F.trim(rest))
    return F.when(text == failure, "").otherwise(text)


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s+", ""))


def vertical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)([!?]+|.)"), F.lit(1))


# Signs that may not begin a line, and signs that may not end one.
HEAD_FORBIDDEN = ")]}〉》」』】〕’”.。,，、!！?？…⋯‥·:;~〜‼⁉♪♬♡♥☆★―—–"
TAIL_FORBIDDEN = "([{〈《「『【〔‘“"


def _fill(words: Column, width: int, glue=lambda w: F.lit(" ")) -> Column:
    """Array of lines: each word joins the line by glue(word) while it stays within `width` signs, else it starts a line."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        longer = F.concat(acc["line"], glue(w), w)
        return (
            F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), w.alias("line")))
            .when(F.length(longer) <= width, F.struct(acc["done"].alias("done"), longer.alias("line")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["line"])).alias("done"), w.alias("line")))
        )

    return F.aggregate(words, start, step, lambda acc: F.when(acc["line"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))))


def _by_paragraph(text: Column, lines) -> Column:
    return F.array_join(F.flatten(F.transform(F.split(text, "\n"), lines)), "\n")


def wrap_greedy(text: Column, width: int) -> Column:
    """Lines of at most `width` signs, words kept whole; paragraphs end at newlines, empty ones go."""
    return _by_paragraph(text, lambda p: _fill(F.filter(F.split(p, " "), lambda w: w != ""), width))


def wrap_tokens(text: Column, width: int) -> Column:
    """As wrap_greedy, but runs of middle dots and of ! and ? are tokens of their own that join without a space."""
    glue = lambda w: F.when(w.rlike("^(·+|[!?⋯]+)$"), "").otherwise(" ")
    return _by_paragraph(text, lambda p: _fill(F.regexp_extract_all(p, F.lit(r"(·+|[!?]+|\S+)"), F.lit(1)), width, glue))


def wrap_aggressive(text: Column, width: int) -> Column:
    """Paragraphs ignored: every newline is a space."""
    return F.array_join(_fill(F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), lambda w: w != ""), width), "\n")


#: What SQL's trim takes off: the space separators.
_SPACES = (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the number of the text that each belongs to."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.repeat(np.arange(len(texts)), [len(x) for x in texts])


def count_midword(sources: list[str], wrapped: list[str]) -> np.ndarray:
    """midword_breaks of many texts at once: gaps and line ends are running sums over all of them."""
    span, n = 1 + max(map(len, [*sources, *wrapped]), default=0), len(sources)
    points, row = _points(sources)
    between = (points == 32) | (points == 10)
    so_far = np.cumsum(~between)
    gaps = row[between] * span + (so_far - np.append(0, np.cumsum(np.bincount(row[~between], minlength=n)))[row])[between]

    points, row = _points(wrapped)
    ends = points == 10
    line = np.cumsum(ends) - ends + row
    of = np.repeat(np.arange(n), np.bincount(row[ends], minlength=n) + 1)
    seen = np.flatnonzero(~ends & (points != 32))
    signs = np.bincount(line[seen], minlength=len(of))
    wide = seen[points[seen] >= 0xA0]
    blank = np.bincount(line[wide[np.isin(points[wide], _SPACES)]], minlength=len(of))
    full = signs > blank
    signs = signs[full]
    of = of[full]
    so_far = np.cumsum(signs) - np.append(0, np.cumsum(np.bincount(of, signs, minlength=n)))[of].astype(np.int64)
    inner = np.append(of[1:] == of[:-1], False)[: len(of)]  # the last line of a text ends no word
    places = of[inner] * span + so_far[inner]
    at = np.searchsorted(gaps, places)
    return np.bincount(of[inner][np.append(gaps, -1)[at] != places], minlength=n)


def midword_breaks(source: Column, wrapped: Column) -> Column:
    """How many line ends of `wrapped` fall inside a word of `source`; places are counted in signs other than spaces."""

    def run(source: pa.Array, wrapped: pa.Array) -> pa.Array:
        parts = []
        for low in range(0, len(source), 1000):
            a, b = source.slice(low, 1000), wrapped.slice(low, 1000)
            none = np.array(pc.or_(a.is_null(), b.is_null()))
            parts.append(pa.array(count_midword([x or "" for x in a.to_pylist()], [x or "" for x in b.to_pylist()]), pa.int32(), mask=none))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.int32())

    return F.arrow_udf(run, "int")(source, wrapped)


def line_penalty(line: Column, line_width: Column, width: float, ratio: float, is_last: Column) -> Column:
    """How far a line is from the wanted share of the width, with surcharges for forbidden ends and a lonely last line."""
    t = F.trim(line)
    wanted = F.when(is_last, 0.68).otherwise(ratio)
    share = line_width / F.lit(float(max(width, 1)))
    off = F.when(share < wanted, (wanted - share) * 18.0).otherwise((share - wanted) * 7.0)
    head = F.when(F.lit(HEAD_FORBIDDEN).contains(F.left(t, F.lit(1))), 8.0).otherwise(0.0)
    tail = F.when(F.lit(TAIL_FORBIDDEN).contains(F.right(t, F.lit(1))), 8.0).otherwise(0.0)
    lonely = F.when(is_last & (visible_length(t) <= 2), 5.0).otherwise(0.0)
    return F.when(t == "", 100.0).otherwise(off + head + tail + lonely)


def wrap_candidates(text: Column, ratio: Column) -> Column:
    """Names of the wraps to try, in order, for a text in a box of the given height-to-width ratio."""
    n = visible_length(text)
    spaced = text.contains(" ") & (ratio <= 1.0) & (n >= 8)
    more = F.array(
        F.when(spaced, "balanced_2"), F.when(spaced & ((n >= 14) | (ratio <= 0.75)), "balanced_3"), F.when(spaced & (n >= 24) & (ratio <= 0.58), "balanced_4"),
        *map(F.lit, ("greedy", "tokens", "aggressive", "clusters")),
    )
    return F.array_compact(more)


def drawable(text: Column, has: Callable[[str], Column]) -> Column:
    """Ellipsis signs that no font of the chain has, in signs that one has: `has` tells it of a sign, as a column."""
    flat = F.when(has("⋯"), text).when(has("・"), F.replace(text, F.lit("⋯"), F.lit("・・・"))).otherwise(F.replace(text, F.lit("⋯"), F.lit("...")))
    return F.when(has("︙"), flat).when(has("⋮"), F.replace(flat, F.lit("︙"), F.lit("⋮"))).otherwise(F.replace(flat, F.lit("︙"), F.lit(":")))
