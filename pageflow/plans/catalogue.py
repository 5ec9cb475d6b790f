"""Every query by name, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import boxes, dialogue, events, profiles, state
from ..sources import pages

FLAGSHIP = "bubble_match"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BOX_SQL = """
SELECT l_orderkey AS page,
       CASE l_returnflag WHEN 'R' THEN 'bubble' WHEN 'A' THEN 'text' ELSE 'free_text' END AS cls,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS bid,
       (l_partkey * 37) % 300 AS x1, (l_suppkey * 53) % 300 AS y1,
       (l_partkey * 37) % 300 + 20 + CAST(floor(l_quantity) AS BIGINT) * 3 AS x2,
       (l_suppkey * 53) % 300 + 30 + CAST(l_linenumber AS BIGINT) * 20 AS y2
FROM {lineitem}"""
_BOX = f"fx_box AS ({BOX_SQL.format(lineitem='lineitem')})"
_DIALOGUE = """fx_dialogue AS (
  SELECT conv_id + 1 AS page_num, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS text_num, replace(text, chr(10), ' ') AS text FROM conversations),
keyed AS (SELECT *, page_num || '.' || text_num AS key FROM fx_dialogue)"""
_RESPONSE = """fx_response AS (
  SELECT 2 * (page_num * 100 + text_num) AS line_no, key || '.(' || CASE WHEN (page_num + text_num) % 13 = 0 THEN '번역 불가' ELSE text END || ')' AS line FROM keyed WHERE (page_num + text_num) % 11 <> 0
  UNION ALL SELECT 2 * (page_num * 100 + text_num) + 1, key || '. again ' || key FROM keyed WHERE (page_num + text_num) % 7 = 0
  UNION ALL SELECT page_num, '9999.' || page_num || '.(x)' FROM keyed WHERE text_num = 1)"""
_PARSED = r"""parsed AS (
  SELECT line_no, rtrim(regexp_extract(line, '^([0-9.]+)\.\s*', 1), '.') AS key, regexp_replace(line, '^([0-9.]+)\.\s*', '') AS rest FROM fx_response),
answers AS (
  SELECT key, max_by(CASE WHEN txt = '번역 불가' THEN '' ELSE txt END, line_no) AS answer
  FROM (SELECT line_no, key, CASE WHEN regexp_matches(rest, '(?s)\(.*\)') THEN regexp_extract(rest, '(?s)\((.*)\)', 1) ELSE trim(rest) END AS txt FROM parsed WHERE key <> '') GROUP BY key)"""
_PROFILE = "fx_profile AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings)"
_SIZE = "fx_size AS (SELECT user_id AS page, event_type AS style, event_id AS ord, CAST(floor(value * 10) AS BIGINT) AS size FROM events WHERE value > 0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOX_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def fx_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.numbered(table(spark, sf_dir, "conversations"))


def fx_response(d: DataFrame) -> DataFrame:
    n = F.col("page_num") + F.col("text_num")
    at = 2 * (F.col("page_num") * 100 + F.col("text_num"))
    given = F.when(n % 13 == 0, "번역 불가").otherwise(F.col("text"))
    first = d.filter(n % 11 != 0).select(at.alias("line_no"), F.concat("key", F.lit(".("), given, F.lit(")")).alias("line"))
    again = d.filter(n % 7 == 0).select((at + 1).alias("line_no"), F.concat("key", F.lit(". again "), "key").alias("line"))
    stray = d.filter("text_num = 1").select(F.col("page_num").alias("line_no"), F.concat(F.lit("9999."), "page_num", F.lit(".(x)")).alias("line"))
    return first.unionByName(again).unionByName(stray)


def fx_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "val")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("val").cast("double").alias("val"))


@query("SELECT page_no, CAST(floor((page_no - 1) / 50) AS BIGINT) AS batch_no, page_id, url FROM (SELECT row_number() OVER (ORDER BY url, page_id) AS page_no, page_id, url FROM pages)")
def page_listing_batches(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    p = pages.numbered(p, "url", "page_id")
    return p.select("page_no", F.floor((F.col("page_no") - 1) / 50).alias("batch_no"), "page_id", "url")


@query(f"WITH {_BOX} SELECT page, cls, count(*) AS n FROM fx_box WHERE cls IN ('bubble', 'text', 'free_text') GROUP BY page, cls")
def class_routing(spark, sf_dir):
    return boxes.counts_by(fx_box(spark, sf_dir).filter(F.col("cls").isin("bubble", "text", "free_text")), "page", "cls")


_W = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_IOU = f"({_W}) / CAST((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - ({_W}) AS DOUBLE)"


@query(f"WITH {_BOX} SELECT a.page, a.bid AS a_bid, b.bid AS b_bid, round({_IOU}, 9) AS iou FROM fx_box a JOIN fx_box b ON a.page = b.page AND a.cls = b.cls AND a.bid < b.bid WHERE {_IOU} > 0.2")
def iou_pairs(spark, sf_dir):
    return boxes.overlap_pairs(fx_box(spark, sf_dir)).select(F.col("a_page").alias("page"), "a_bid", "b_bid", F.round("iou", 9).alias("iou"))


@query(f"WITH {_BOX} SELECT a.page, a.bid AS a_bid, b.bid AS b_bid FROM fx_box a JOIN fx_box b ON a.page = b.page AND a.bid <> b.bid WHERE a.x1 >= b.x1 AND a.y1 >= b.y1 AND a.x2 <= b.x2 AND a.y2 <= b.y2")
def containment_pairs(spark, sf_dir):
    return boxes.pairs(fx_box(spark, sf_dir), g.inside, same_class=False, ordered=False).select(F.col("a_page").alias("page"), "a_bid", "b_bid")


@query(f"WITH {_BOX} SELECT a.page, a.bid AS a_bid, b.bid AS b_bid FROM fx_box a JOIN fx_box b ON a.page = b.page AND a.bid < b.bid WHERE a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2")
def intersect_pairs(spark, sf_dir):
    return boxes.pairs(fx_box(spark, sf_dir), g.intersects, same_class=False).select(F.col("a_page").alias("page"), "a_bid", "b_bid")


@query(f"""WITH {_BOX}, c AS (SELECT page, bid, greatest(0, x1) AS cx1, greatest(0, y1) AS cy1, least(280, x2) AS cx2, least(260, y2) AS cy2 FROM fx_box)
SELECT page, bid, CASE WHEN ok THEN cx1 END AS x1, CASE WHEN ok THEN cy1 END AS y1, CASE WHEN ok THEN cx2 END AS x2, CASE WHEN ok THEN cy2 END AS y2 FROM (SELECT *, cx2 > cx1 AND cy2 > cy1 AS ok FROM c)""")
def box_clip(spark, sf_dir):
    clipped = g.clip(g.box(), 280, 260)
    return fx_box(spark, sf_dir).select("page", "bid", *(c.alias(k) for k, c in clipped.items()))


_MERGE = f"""WITH RECURSIVE {_BOX},
edges AS MATERIALIZED (SELECT a.page, a.cls, a.bid AS u, b.bid AS v FROM fx_box a JOIN fx_box b ON a.page = b.page AND a.cls = b.cls AND a.bid <> b.bid WHERE {_IOU} > 0.2),
reach(page, cls, bid, other) AS (SELECT page, cls, bid, bid FROM fx_box UNION SELECT r.page, r.cls, r.bid, e.v FROM reach r JOIN edges e ON e.page = r.page AND e.cls = r.cls AND e.u = r.other),
root AS (SELECT page, cls, bid, min(other) AS root FROM reach GROUP BY page, cls, bid),
merged AS (SELECT b.page, b.cls, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS members FROM fx_box b JOIN root r ON b.page = r.page AND b.cls = r.cls AND b.bid = r.bid GROUP BY b.page, b.cls, r.root)"""


@query(f"{_MERGE} SELECT * FROM merged")
def box_merge(spark, sf_dir):
    return boxes.merge(fx_box(spark, sf_dir))


@query(f"{_MERGE} SELECT cls, CAST(sum(members) AS BIGINT) AS raw_boxes, count(*) AS merged_boxes, max(members) AS largest FROM merged GROUP BY cls")
def box_merge_stats(spark, sf_dir):
    return boxes.merge(fx_box(spark, sf_dir)).groupBy("cls").agg(F.sum("members").alias("raw_boxes"), F.count("*").alias("merged_boxes"), F.max("members").alias("largest"))


@query(f"""WITH RECURSIVE {_BOX},
near AS (SELECT b.page, b.bid AS bubble, t.bid AS txt, CASE WHEN t.x1 + t.x2 BETWEEN 2 * b.x1 AND 2 * b.x2 AND t.y1 + t.y2 BETWEEN 2 * b.y1 AND 2 * b.y2 THEN 0 ELSE 1 END AS away,
  (t.x1 + t.x2 - b.x1 - b.x2) * (t.x1 + t.x2 - b.x1 - b.x2) + (t.y1 + t.y2 - b.y1 - b.y2) * (t.y1 + t.y2 - b.y1 - b.y2) AS d2, (b.x2 - b.x1) * (b.x2 - b.x1) + (b.y2 - b.y1) * (b.y2 - b.y1) AS diagonal
  FROM fx_box b JOIN fx_box t ON b.page = t.page AND b.cls = 'bubble' AND t.cls = 'text'),
cand AS MATERIALIZED (SELECT page, bubble, list(txt ORDER BY away, d2, txt) AS texts, row_number() OVER (PARTITION BY page ORDER BY bubble) AS k FROM near WHERE away = 0 OR d2 <= diagonal GROUP BY page, bubble),
walk(page, k, bubble, txt, used) AS (
  SELECT page, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT page FROM cand)
  UNION ALL
  SELECT w.page, c.k, c.bubble, list_filter(c.texts, lambda x: NOT list_contains(w.used, x))[1], list_concat(w.used, list_filter(c.texts, lambda x: NOT list_contains(w.used, x))[1:1])
  FROM walk w JOIN cand c ON c.page = w.page AND c.k = w.k + 1)
SELECT page, bubble, txt FROM walk WHERE txt IS NOT NULL""")
def bubble_match(spark, sf_dir):
    return boxes.match_bubbles(fx_box(spark, sf_dir))


@query(r"SELECT doc_id, length(trim(text)) > 0 AND (length(trim(text)) > 1 OR regexp_matches(trim(text), '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]')) AND regexp_matches(text, '\p{L}') AS valid FROM documents")
def text_validity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.valid_text(F.col("text")).alias("valid"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([.。．・])[ \t\n\r\f]+([.。．・])', '\1\2', 'g'), '([.。．・])[ \t\n\r\f]+([.。．・])', '\1\2', 'g'), '[…‥]+|[.。．・]{2,}', '⋯', 'g') AS text FROM documents""")
def ellipsis_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.ellipsis(F.col("text")).alias("text"))


@query(f"WITH {_DIALOGUE} SELECT page_num, string_agg(key || '.(' || text || ')', chr(10) ORDER BY text_num) AS request FROM keyed GROUP BY page_num")
def request_build(spark, sf_dir):
    return dialogue.requests(fx_dialogue(spark, sf_dir))


@query(f"WITH {_DIALOGUE}, {_RESPONSE}, {_PARSED} SELECT key, answer FROM answers")
def response_parse(spark, sf_dir):
    return dialogue.answers(fx_response(fx_dialogue(spark, sf_dir)))


@query(f"WITH {_DIALOGUE}, {_RESPONSE}, {_PARSED} SELECT page_num, text_num, k.key, answer FROM keyed k LEFT JOIN answers a ON k.key = a.key")
def response_apply(spark, sf_dir):
    d = fx_dialogue(spark, sf_dir)
    return dialogue.apply_response(d, fx_response(d)).select("page_num", "text_num", "key", "answer")


@query(f"WITH {_DIALOGUE}, {_RESPONSE}, {_PARSED} SELECT key FROM keyed WHERE key NOT IN (SELECT key FROM answers)")
def missing_keys(spark, sf_dir):
    d = fx_dialogue(spark, sf_dir)
    return dialogue.missing(d, fx_response(d)).select("key")


@query(f"WITH {_DIALOGUE}, {_RESPONSE}, {_PARSED} SELECT key FROM answers WHERE key NOT IN (SELECT key FROM keyed)")
def unknown_keys(spark, sf_dir):
    d = fx_dialogue(spark, sf_dir)
    return dialogue.unknown(d, fx_response(d)).select("key")


@query(f"""WITH {_DIALOGUE}, {_RESPONSE}, {_PARSED}, ok AS (SELECT page_num, coalesce(trim(answer) <> '', false) AS ok FROM keyed k LEFT JOIN answers a ON k.key = a.key)
SELECT page_num, bool_and(ok) AS translated, count(*) FILTER (WHERE ok) AS n_translated, count(*) AS n_texts FROM ok GROUP BY page_num""")
def page_translated_split(spark, sf_dir):
    d = fx_dialogue(spark, sf_dir)
    return dialogue.translated_pages(dialogue.apply_response(d, fx_response(d)))


@query("""SELECT conv_id, turn, count(*) OVER w AS remembered, CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS signs FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def history_window(spark, sf_dir):
    return dialogue.history(table(spark, sf_dir, "conversations"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf_dir):
    return state.remaining(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def resume_merge(spark, sf_dir):
    return state.last_wins(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id")


_STATUS = "SELECT n_pages, n_done, n_pages > 0 AND n_pages = n_done AS complete FROM (SELECT count(*) AS n_pages, count(l.doc_id) AS n_done FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)"


@query(_STATUS)
def pass2_status(spark, sf_dir):
    return state.status(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"SELECT complete AS covered FROM ({_STATUS})")
def output_superset_check(spark, sf_dir):
    return state.status(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select(F.col("complete").alias("covered"))


@query(f"""WITH {_PROFILE}, runs AS (SELECT vec_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY vec_id ORDER BY pos) - 1 <= 2 THEN 0 ELSE 1 END AS fresh FROM fx_profile WHERE val > 0.05),
b AS (SELECT vec_id, pos, sum(fresh) OVER (PARTITION BY vec_id ORDER BY pos) AS band FROM runs)
SELECT vec_id, min(pos) AS start, max(pos) + 1 AS stop FROM b GROUP BY vec_id, band HAVING max(pos) + 1 - min(pos) >= 3""")
def profile_bands(spark, sf_dir):
    return profiles.bands(fx_profile(spark, sf_dir), threshold=0.05)


@query(f"WITH {_PROFILE} SELECT vec_id, round(quantile_cont(val, 0.7), 9) AS p70, round(stddev_pop(val), 9) AS spread FROM fx_profile GROUP BY vec_id")
def profile_p70(spark, sf_dir):
    return fx_profile(spark, sf_dir).groupBy("vec_id").agg(F.round(F.percentile("val", 0.7), 9).alias("p70"), F.round(F.stddev_pop("val"), 9).alias("spread"))


@query(f"WITH {_PROFILE} SELECT vec_id, pos, round(sum(val) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 9) AS mean FROM fx_profile")
def moving_average(spark, sf_dir):
    return profiles.moving_average(fx_profile(spark, sf_dir))


@query(f"""WITH {_PROFILE}, p AS (SELECT vec_id, pos, exp(val) / sum(exp(val)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY val DESC, pos) AS k FROM fx_profile)
SELECT vec_id, max(CASE WHEN k = 1 THEN pos END) AS best, round(max(CASE WHEN k = 1 THEN p END), 9) AS top, round(max(CASE WHEN k = 1 THEN p END) - max(CASE WHEN k = 2 THEN p END), 9) AS margin FROM p WHERE k <= 2 GROUP BY vec_id""")
def style_top2_margin(spark, sf_dir):
    return profiles.top2_margin(fx_profile(spark, sf_dir))


@query("SELECT label, round(degrees(atan2(avg(sin(CAST(embedding[1] AS DOUBLE) * 3)), avg(cos(CAST(embedding[1] AS DOUBLE) * 3)))), 6) AS angle FROM embeddings GROUP BY label")
def circular_angle(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("a", F.col("embedding")[0].cast("double") * 3)
    return e.groupBy("label").agg(F.round(F.degrees(F.atan2(F.avg(F.sin("a")), F.avg(F.cos("a")))), 6).alias("angle"))


@query(f"""WITH {_SIZE}, a AS (SELECT *, count(*) OVER (PARTITION BY page, style) AS n, CASE WHEN size <= lag(size) OVER (PARTITION BY page, style ORDER BY size, ord) * 1.22::DOUBLE THEN 0 ELSE 1 END AS fresh FROM fx_size),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY page, style ORDER BY size, ord) AS chain FROM a),
m AS (SELECT page, style, chain, count(*) AS k, quantile_cont(CAST(size AS DOUBLE), 0.5) AS middle, first(n) AS n FROM c GROUP BY page, style, chain),
w AS (SELECT page, style, CAST(round_even(middle, 0) AS BIGINT) AS centre FROM (SELECT *, row_number() OVER (PARTITION BY page, style ORDER BY k DESC, chain) AS place FROM m) WHERE place = 1 AND n >= 4 AND k * 10 >= n * 6)
SELECT c.page, c.style, c.ord, c.size, CASE WHEN abs(c.size - centre) <= 0.25::DOUBLE * centre OR c.size > 1.5::DOUBLE * centre THEN centre ELSE c.size END AS harmonised FROM c LEFT JOIN w ON c.page = w.page AND c.style = w.style""")
def size_harmonise(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value > 0")
    return profiles.harmonise(e.select(F.col("user_id").alias("page"), F.col("event_type").alias("style"), F.col("event_id").alias("ord"), F.floor(F.col("value") * 10).alias("size")))


@query(r"""SELECT conv_id, turn, CASE WHEN len(ws) = 0 THEN '' ELSE list_reduce(ws, lambda a, w: a || CASE WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(w) <= 24 THEN ' ' ELSE chr(10) END || w) END AS wrapped
FROM (SELECT conv_id, turn, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '') AS ws FROM conversations)""")
def wrap_greedy(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.wrap_greedy(F.regexp_replace("text", "\n", " "), 24).alias("wrapped"))


@query(f"WITH {_BOX} SELECT page, bid, round(least(1.0::DOUBLE, 64::DOUBLE / greatest(x2 - x1, y2 - y1)), 9) AS scale FROM fx_box")
def canvas_scale(spark, sf_dir):
    b = g.box()
    return fx_box(spark, sf_dir).select("page", "bid", F.round(g.fit_scale(b["x2"] - b["x1"], b["y2"] - b["y1"], 64), 9).alias("scale"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total, max(event_id) AS last_event FROM events GROUP BY event_type")
def event_rollup(spark, sf_dir):
    return events.rollup(table(spark, sf_dir, "events"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return events.hourly(table(spark, sf_dir, "events"))
