"""Wraps and fits against brute force over all ways to break, and literal cases."""

import itertools
import random
import re
import time

import pytest

from pageflow.operators import placing
from pageflow.operators import typesetting as ts

METRIC = ts.Metric(line=1.0)


def test_greedy_and_tokens():
    assert ts.wrap("greedy", "aa bb cc\n\nd", 2.5, 1, METRIC) == "aa bb\ncc\nd"
    assert ts.wrap("greedy", "longer than", 1, 1, METRIC) == "longer\nthan"
    assert ts.wrap("tokens", "so !! yes", 2.0, 1, METRIC) == "so!!\nyes"
    assert ts.wrap("aggressive", "a\nb  c", 9, 1, METRIC) == "a b c"


def test_balanced_is_the_best_of_all_cuts():
    rng = random.Random(3)
    for _ in range(40):
        words = ["x" * rng.randint(1, 9) + rng.choice(["", ",", "("]) for _ in range(rng.randint(3, 8))]
        width, target = rng.uniform(6, 14), rng.choice([2, 3])

        def cost(lines):
            n = len(lines)
            return sum(ts.penalty(x, METRIC.line(x, 1) / width, 0.86 if n <= 2 else 0.8, k == n - 1) for k, x in enumerate(lines))

        all_ways = [[" ".join(words[a:b]) for a, b in zip((0, *cuts), (*cuts, len(words)))] for cuts in itertools.combinations(range(1, len(words)), target - 1)]
        got = ts.wrap(f"balanced_{target}", " ".join(words), width, 1, METRIC).split("\n")
        assert got in all_ways and cost(got) == pytest.approx(min(map(cost, all_ways)))


def test_clusters_keep_endings_marks_and_short_quotes():
    assert ts.clusters("하세요! 간다") == ["하", "세요!", " ", "간", "다"]
    assert ts.clusters("「가나」다") == ["「가나」", "다"] and ts.clusters("(abc") == ["(a", "b", "c"]
    assert "".join(ts.clusters("a (b c) d!? 이야기")) == "a (b c) d!? 이야기"
    for text in ("가나다라 마바사아 자차카타", "abc def, ghi!!", "「아주 짧은」 말입니다."):
        wrapped = ts.wrap("clusters", text, 4, 1, METRIC)
        assert wrapped.replace("\n", "").replace(" ", "") == text.replace(" ", "")
        assert not any(line[0] in ts.HEAD_FORBIDDEN for line in wrapped.split("\n"))


def test_midword():
    assert ts.midword("ab cd", "ab\ncd") == 0 and ts.midword("ab cd", "a\nb c\nd") == 2


def test_bisection_finds_the_largest_size():
    for most in range(5, 40):
        got = ts.largest_fitting(lambda s: (str(s), max(0, s - most)), 30, 5)
        assert got == (str(min(30, most)), min(30, most), True)
    assert ts.largest_fitting(lambda s: ("x", 1.0), 30, 5)[1:] == (5, False)


def test_best_fit_is_the_best_of_its_candidates():
    for text, w, h in (("some words that go on a while", 120, 60), ("short", 40, 90), ("가나다라마바사", 30, 140)):
        wrapped, size, name, fits = ts.best_fit(text, 16, w, h, METRIC)
        assert name in ts.candidates(text, h / w) and 5 <= size <= 19
        block = METRIC.block(wrapped, size)
        assert fits == (block[0] <= w and block[1] <= h) or not fits
    assert ts.best_fit("same size", 14, 100, 50, METRIC, fixed=True)[1] == 14


def test_vertical_columns():
    assert [x[0] for x in ts.vertical_columns("뭐!?~", 10, METRIC)[0]] == ["뭐", "!?", "~"]
    assert ts.vertical_columns("뭐!?~", 10, METRIC)[0][2][3]
    columns = ts.vertical_columns("가나다라마", 10, METRIC, 20)
    assert ["".join(x[0] for x in c) for c in columns] == ["가나", "다라", "마"]
    assert len(ts.vertical_columns("가나다라마", 10, METRIC, 20, 2)) == 2
    assert "".join(x[0] for x in ts.vertical_columns("가나。다", 10, METRIC, 20)[0]) == "가나。"
    assert ts.vertical_block("", 10, METRIC) == (0.0, 0.0, 0)
    size, fits = ts.best_fit_vertical("가나다", 20, 30, 200, METRIC)
    assert fits and 5 <= size <= 24 and not ts.best_fit_vertical("가나다" * 20, 20, 5, 10, METRIC)[1]


def test_vertical_columns_of_long_texts_in_linear_time():
    rng = random.Random(5)

    def plain(text, size, high):
        columns = []
        for paragraph in text.split("\n"):
            column = []
            for token in re.findall(r"[!?]+|.", paragraph, re.S):
                w, h = (0.0, 0.45 * size) if token.isspace() else METRIC.block(token, size)
                turned = len(token) == 1 and token in ts.ROTATED
                w, h = (h, w) if turned else (w, h)
                if column and sum(x[2] for x in column) + h > high and not (len(token) == 1 and token in ts.HEAD_FORBIDDEN):
                    columns.append(column)
                    column = []
                    if token.isspace():
                        continue
                column.append((token, w, h, turned))
            if column:
                columns.append(column)
        return columns

    for _ in range(1500):
        text = "".join(rng.choice("ab가나 \u3000!?.。」~-(\n\t ") for _ in range(rng.randint(0, 60)))
        size, high = rng.randint(5, 40), rng.choice([1, 10, 45, 59, 100, 236.0, rng.uniform(5, 300)])
        assert ts.vertical_columns(text, size, METRIC, high) == plain(text, size, high)
        most, fits = ts.best_fit_vertical(text, size, 90, high, METRIC)
        tried = [ts.vertical_block(text, at, METRIC, high, 1) for at in range(5, size + 1)]
        assert fits or not any(n and w <= 90 and h <= high for w, h, n in tried[: max(0, size - 4)] if size >= 18)
        if fits:
            w, h, n = ts.vertical_block(text, most, METRIC, high, 1)
            assert n and w <= 90 and h <= high
    began = time.monotonic()
    assert sum(map(len, ts.vertical_columns("가" * 100_000, 10, METRIC, 50_000.0))) == 100_000
    assert not ts.best_fit_vertical("가나" * 50_000, 20, 100, 50_000, METRIC)[1]
    assert time.monotonic() - began < 10


def test_moved_off():
    assert placing.moved_off((0, 0, 10, 10), [(20, 20, 30, 30)], 100, 100) == (0, 0, 10, 10)
    assert placing.moved_off((50, 50, 60, 60), [(48, 58, 90, 90)], 100, 100) == (50, 48, 60, 58)
    assert placing.moved_off((95, 0, 105, 10), [], 100, 100) == (90, 0, 100, 10)


def test_runs_and_fallback(spark):
    fonts = spark.createDataFrame([("a", "other", 1, False), ("s", "standard", 2, False), ("z", "other", 3, True)], "font string, role string, place int, system boolean")
    chain = placing.font_chain(fonts)
    assert [r.fallback for r in chain.filter("font = 'a'").orderBy("place").collect()] == ["a", "s", "z"]
    signs = spark.createDataFrame([(1, p, c, "a", 1.0) for p, c in enumerate("xy z")], "line int, pos int, sign string, font string, advance double")
    have = spark.createDataFrame([("a", "x"), ("s", "y"), ("z", "y")], "font string, sign string")
    drawn = placing.resolve_glyphs(signs, chain, have)
    assert [r.drawn_by for r in drawn.orderBy("pos").collect()] == ["a", "s", "a", "a"]
    assert [tuple(r) for r in placing.font_runs(drawn).orderBy("run").collect()] == [(1, 1, "a", "x", 0.0, 1.0), (1, 2, "s", "y", 1.0, 1.0), (1, 3, "a", " z", 2.0, 2.0)]


def test_wraps_by_running_sums_and_the_fit_of_long_texts():
    rng = random.Random(6)

    def plain(words, fits):
        lines = []
        for word in words:
            if lines and fits(f"{lines[-1]} {word}"):
                lines[-1] += f" {word}"
            else:
                lines.append(word)
        return lines

    for _ in range(300):
        metric = ts.Metric(scale=rng.choice([1, 0.92]), letter=rng.choice([0, -0.6, -9.0, 1.3]), line=1.0)
        text = "".join(rng.choice("abc,.가나 !?·(") for _ in range(rng.randint(1, 80)))
        size, width = rng.randint(5, 30), rng.choice([40, 90, 60.5, rng.uniform(1, 200)])
        fits = lambda x: metric.line(x, size) <= width  # noqa: B023, E731
        assert ts.wrap("greedy", text, width, size, metric) == "\n".join(plain(text.split(), fits))
    began = time.monotonic()
    words = " ".join("x" * rng.randint(1, 9) for _ in range(3000))
    assert not ts.best_fit(words, 20, 200, 100, METRIC)[3]
    assert time.monotonic() - began < 8
