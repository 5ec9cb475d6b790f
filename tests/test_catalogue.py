"""Every catalogue query against its oracle, over whole tables."""

import os
import time

import duckdb
import pytest

from pageflow.plans import catalogue

DATA = os.environ.get("PAGEFLOW_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_oracle(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, DATA)
    if name not in catalogue.ORACLE_SQL:
        assert mine.count() > 0
        return
    theirs = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    a = sorted((tuple(r) for r in mine.select(*names).collect()), key=key)
    b = sorted(theirs.fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=1e-9) if all(isinstance(v, int | float) for v in y) else x == y


def test_glyphs_of_whole_texts(spark, duck):
    chains, modulus = {"a": "abc", "b": "bac", "c": "cba"}, {"a": 0, "b": 1, "c": 2}
    want = set()
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        font = "abc"[doc_id % 3]
        for sign in set(text or ""):
            able = [f for f in chains[font] if ord(sign) % 3 != modulus[f] and ord(sign) % 7 > 0]
            want.add((doc_id, sign, font if sign == " " or not able else able[0]))
    got = [tuple(r) for r in catalogue.QUERIES["glyph_fallback"](spark, DATA).select("doc_id", "sign", "drawn_by").collect()]
    assert len(got) == len(want) and set(got) == want


def test_glyphs_of_odd_texts(spark, tmp_path):
    odd = [(0, ""), (1, None), (None, "a b"), (-1, "a\u3000"), (-2, "b"), (-3, "c "), (2**62, "x"), (5, "one"), (5, "two one")]
    odd += [(k, "é\u00a0\u1680\u2003\u202f\u205f\u3000 \u200b\t\n\x00\U0001f600e\u0301") for k in (6, 7, 8)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(path)
    one = duckdb.connect()
    one.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = one.execute(f"SELECT doc_id, sign, drawn_by FROM ({catalogue.ORACLE_SQL['glyph_fallback']})").fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["glyph_fallback"](spark, str(tmp_path)).select("doc_id", "sign", "drawn_by").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_midword_breaks_of_long_and_odd_texts(spark, tmp_path):
    odd = ["", None, " ", "a", "  lead and trail  ", "tab\tand\rreturn\u0085next", "\u00a0\u3000 " * 12, "line\nbreak " * 9, "\U0001f600 e\u0301" * 30, "word " * 20000, "x" * 50000]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(k, 0, x) for k, x in enumerate(odd)], "conv_id long, turn long, text string").coalesce(1).write.parquet(path)
    one = duckdb.connect()
    one.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet') WHERE conv_id < 9")
    want = one.execute(f"SELECT conv_id, breaks FROM ({catalogue.ORACLE_SQL['midword_breaks']})").fetchall()
    began = time.monotonic()
    got = {r.conv_id: r.breaks for r in catalogue.QUERIES["midword_breaks"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 60  # sums anew for each line end took minutes
    assert {k: v for k, v in got.items() if k < 9} == dict(want)
    assert got[9] == sum(9 * k // 5 * 4 + min(9 * k % 5, 4) not in range(0, 10**6, 4) for k in range(1, 11112)) and got[10] == 5555
