"""Queries of whole pages, requests with a retry and resumed runs, added to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import boxes, dialogue, state
from .catalogue import _BOX, _DIALOGUE, _PARSED, _RESPONSE, ORACLE_SQL, fx_box, fx_dialogue, fx_response, query, table

_MATCH = ORACLE_SQL["bubble_match"].rpartition("SELECT page, bubble, txt FROM walk")[0]


@query(f"""{_MATCH}, matched AS (SELECT page, bubble, txt FROM walk WHERE txt IS NOT NULL),
held AS MATERIALIZED (SELECT b.page, b.bid AS bubble, list(t.bid ORDER BY t.bid) AS texts, row_number() OVER (PARTITION BY b.page ORDER BY b.bid) AS k FROM fx_box b JOIN fx_box t ON b.page = t.page AND b.cls = 'bubble' AND t.cls = 'free_text'
  AND t.x1 >= b.x1 AND t.y1 >= b.y1 AND t.x2 <= b.x2 AND t.y2 <= b.y2 WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.page = b.page AND m.bubble = b.bid) GROUP BY b.page, b.bid),
second(page, k, bubble, txt, used) AS (SELECT DISTINCT page, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) FROM held
  UNION ALL SELECT w.page, h.k, h.bubble, list_filter(h.texts, lambda x: NOT list_contains(w.used, x))[1], list_concat(w.used, list_filter(h.texts, lambda x: NOT list_contains(w.used, x))[1:1]) FROM second w JOIN held h ON h.page = w.page AND h.k = w.k + 1),
more AS (SELECT page, bubble, txt FROM second WHERE txt IS NOT NULL)
SELECT page, 'bubble' AS kind, bubble, txt FROM matched UNION ALL SELECT page, 'bubble', bubble, txt FROM more
UNION ALL SELECT page, 'free', NULL, bid FROM fx_box b WHERE cls = 'free_text' AND NOT EXISTS (SELECT 1 FROM more m WHERE m.page = b.page AND m.txt = b.bid)""")
def page_structure(spark, sf_dir):
    return boxes.structure(fx_box(spark, sf_dir))


@query(f"WITH {_BOX}, c AS (SELECT *, ((x1 * 7 + y1 * 13) % 100) / 100::DOUBLE AS conf FROM fx_box) SELECT page, bid, cls, conf FROM c WHERE conf >= 0.35::DOUBLE AND cls <> 'other'")
def detection_filter(spark, sf_dir):
    b = fx_box(spark, sf_dir).withColumn("conf", ((F.col("x1") * 7 + F.col("y1") * 13) % 100) / 100)
    return boxes.detected(b).select("page", "bid", "cls", "conf")


@query(f"WITH {_BOX} SELECT page, bid, x1, y1, x2, y2, CASE cls WHEN 'bubble' THEN 0 ELSE 255 END AS r, CASE cls WHEN 'bubble' THEN 255 ELSE 0 END AS g, CASE cls WHEN 'text' THEN 255 ELSE 0 END AS b FROM fx_box")
def debug_boxes(spark, sf_dir):
    return boxes.debug_boxes(fx_box(spark, sf_dir), {"bubble": (0, 255, 0), "text": (255, 0, 255), "free_text": (255, 0, 0)})


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, doc_id % 31 AS w, doc_id % 17 + 5 AS h FROM documents)
SELECT doc_id, w >= 10 AND h >= 10 AND length(t) > 0 AND (length(t) > 1 OR regexp_matches(t, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]')) AND regexp_matches(t, '\p{L}') AS valid FROM s""")
def element_validity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.valid_element(F.col("text"), F.col("doc_id") % 31, F.col("doc_id") % 17 + 5).alias("valid"))


@query("SELECT doc_id, replace(text, ' ', '') AS text FROM documents")
def spaces_removed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.without_spaces(F.col("text")).alias("text"))


@query(f"WITH {_BOX}, e AS (SELECT page, CASE cls WHEN 'bubble' THEN 0 ELSE 1 END AS kind, bid AS ord, CASE WHEN x1 % 6 > 0 THEN 'text ' || bid ELSE '' END AS text FROM fx_box) SELECT page, kind, ord, text, page || '.' || row_number() OVER (PARTITION BY page ORDER BY kind, ord) AS key FROM e WHERE text <> ''")
def request_numbering(spark, sf_dir):
    text = F.when(F.col("x1") % 6 > 0, F.concat(F.lit("text "), "bid")).when(F.col("x1") % 12 > 0, "")
    e = fx_box(spark, sf_dir).select("page", F.when(F.col("cls") == "bubble", 0).otherwise(1).alias("kind"), F.col("bid").alias("ord"), text.alias("text"))
    return dialogue.number_elements(e)


@query(f"""WITH {_DIALOGUE}, {_RESPONSE}, {_PARSED}, ok AS (SELECT page_num, coalesce(trim(answer) <> '', false) AS ok FROM keyed k LEFT JOIN answers a ON k.key = a.key WHERE page_num % 9 > 0)
SELECT p.page_num, coalesce(bool_and(ok), true) AS translated FROM (SELECT DISTINCT page_num FROM keyed) p LEFT JOIN ok ON p.page_num = ok.page_num GROUP BY p.page_num""")
def pages_translated(spark, sf_dir):
    d = fx_dialogue(spark, sf_dir)
    return dialogue.pages_translated(d, dialogue.apply_response(d.filter("page_num % 9 > 0"), fx_response(d)))


@query(f"WITH {_DIALOGUE}, {_RESPONSE}, {_PARSED} SELECT page_num, string_agg(k.key || '.(' || text || ')', chr(10) ORDER BY text_num) AS request FROM keyed k WHERE k.key NOT IN (SELECT key FROM answers) GROUP BY page_num")
def retry_request(spark, sf_dir):
    d = fx_dialogue(spark, sf_dir)
    return dialogue.second_request(d, fx_response(d))


@query(f"WITH {_DIALOGUE}, {_RESPONSE}, {_PARSED} SELECT k.key, CASE WHEN a.key IS NOT NULL THEN answer WHEN text_num % 2 = 0 THEN 'second ' || k.key ELSE '' END AS answer FROM keyed k LEFT JOIN answers a ON k.key = a.key")
def retry_apply(spark, sf_dir):
    d = fx_dialogue(spark, sf_dir)
    first = fx_response(d)
    second = dialogue.missing(d, first).filter("text_num % 2 = 0").select(F.col("text_num").alias("line_no"), F.concat("key", F.lit(".(second "), "key", F.lit(")")).alias("line"))
    return dialogue.with_retry(d, first, second).select("key", "answer")


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS \"left\", count(l.doc_id) AS skipped FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def resume_counts(spark, sf_dir):
    return state.remaining_with_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS reuse FROM documents")
def resume_plan(spark, sf_dir):
    return state.plan(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT l.doc_id, l.quality, d.n_chars AS place FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id % 3 > 0")
def resume_order(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").filter("doc_id % 3 > 0").select("doc_id", F.col("n_chars").alias("place"))
    return state.in_input_order(table(spark, sf_dir, "labels").select("doc_id", "quality"), pages, "doc_id", "place")


@query("SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 'plain.ttf' WHEN 'click' THEN 'bold.ttf' ELSE 'standard.ttf' END AS font FROM events")
def style_font(spark, sf_dir):
    fonts = spark.createDataFrame([("view", "plain.ttf"), ("click", "bold.ttf")], "event_type string, font string")
    return state.with_default(table(spark, sf_dir, "events").select("event_id", "event_type"), fonts, "event_type", {"font": "standard.ttf"})
