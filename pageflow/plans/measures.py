"""Queries of styles, glyph bodies, drawing choices and counts of a run, added to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout
from ..functions import text as t
from ..operators import events, placing, profiles, state
from .catalogue import _BOX, _PROFILE, fx_box, query, table


def _profile(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "val")).withColumn("val", F.col("val").cast("double"))


@query(f"""WITH {_PROFILE}, p AS (SELECT vec_id // 3 AS item, pos, exp(val) / sum(exp(val)) OVER (PARTITION BY vec_id) AS p FROM fx_profile),
m AS (SELECT item, pos, round(avg(p), 9) AS p FROM p GROUP BY item, pos), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, pos) AS k FROM m)
SELECT a.item, a.pos AS best, a.p AS top, round(a.p - b.p, 9) AS margin FROM r a JOIN r b ON a.item = b.item AND a.k = 1 AND b.k = 2""")
def style_of_views(spark, sf_dir):
    views = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 3").alias("item"))
    return profiles.top2_of_views(_profile(spark, sf_dir), views)


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS v FROM events)
SELECT event_id, CASE WHEN event_id % 4 > 0 AND TRY_CAST(v AS DOUBLE) > 0 THEN TRY_CAST(v AS DOUBLE) END AS target FROM s""")
def ratio_target(spark, sf_dir):
    value = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", layout.char_ratio_target(value).alias("target"))


@query(f"""WITH {_BOX} SELECT page, bid, CASE WHEN y2 - y1 > 2 * (x2 - x1) THEN 'vertical' WHEN abs(x1 % 9 - 4) > 2 THEN 'rotated' ELSE 'plain' END AS kind,
CASE WHEN x1 % 5 > 0 AND y1 < 100 THEN 'white' ELSE 'black' END AS fill, CASE WHEN x1 % 5 > 0 AND y1 < 100 THEN 'black' ELSE 'white' END AS outline FROM fx_box""")
def drawing_choice(spark, sf_dir):
    b = fx_box(spark, sf_dir)
    luma = F.when(F.col("x1") % 5 > 0, F.col("y1"))
    kind = layout.render_kind(F.col("y2") - F.col("y1") > 2 * (F.col("x2") - F.col("x1")), F.col("x1") % 9 - 4)
    return b.select("page", "bid", kind.alias("kind"), *(c.alias(n) for n, c in layout.colours_on(luma, F.lit("black"), F.lit("white")).items()))


@query("""WITH s AS (SELECT doc_id, text || ' ⋯ ︙' AS text, doc_id % 3 AS font FROM documents)
SELECT doc_id, CASE font WHEN 0 THEN text WHEN 1 THEN replace(replace(text, '⋯', '・・・'), '︙', ':') ELSE replace(replace(text, '⋯', '...'), '︙', '⋮') END AS text FROM s""")
def drawable_text(spark, sf_dir):
    has = {"⋯": 0, "︙": 0, "・": 1, "⋮": 2}
    drawn = t.drawable(F.concat("text", F.lit(" ⋯ ︙")), lambda sign: F.col("doc_id") % 3 == has[sign])
    return table(spark, sf_dir, "documents").select("doc_id", drawn.alias("text"))


@query(r"""WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS sign FROM conversations),
g AS (SELECT conv_id, turn, (30 + unicode(sign) % 41) / 100::DOUBLE * (10 + turn) AS w, (50 + unicode(sign) % 31) / 100::DOUBLE * (10 + turn) AS h FROM s WHERE unicode(sign) % 11 > 0 AND NOT regexp_matches(sign, '\s')),
m AS (SELECT conv_id, turn, median(w) AS w, median(h) AS h FROM g GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, round(coalesce(w, 0), 9) AS body_width, round(coalesce(h, 0), 9) AS body_height, round(coalesce(h, 0) / greatest(c.turn * 0.3::DOUBLE, 1), 9) AS ratio FROM (SELECT DISTINCT conv_id, turn FROM conversations) c LEFT JOIN m USING (conv_id, turn)""")
def body_size(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") + 10).alias("size"))
    signs = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)))).alias("sign")).distinct()
    code = F.ascii("sign")
    metrics = signs.filter(code % 11 > 0).select("sign", ((code % 41 + 30) / 100).alias("width"), ((code % 31 + 50) / 100).alias("height"))
    found = placing.body_sizes(texts, metrics, ["conv_id", "turn"])
    ratio = placing.height_ratio(F.col("body_height"), F.col("turn") * F.lit(0.3).cast("double"))
    return found.select("conv_id", "turn", *(c.alias(n) for n, c in (("body_width", F.round("body_width", 9)), ("body_height", F.round("body_height", 9)), ("ratio", F.round(ratio, 9)))))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pages_to_draw(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("translated"))
    return state.translated_pages(table(spark, sf_dir, "documents").select("doc_id", "source"), verdicts, "doc_id")[0]


@query("""WITH l AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT 'warning' AS level, count(*) AS n_left, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS first FROM l HAVING count(*) > 0""")
def pages_left_event(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("translated"))
    event = state.translated_pages(table(spark, sf_dir, "documents").select("doc_id", "source"), verdicts, "doc_id")[1]
    return event.withColumn("first", F.array_join(F.col("first").cast("array<string>"), ","))


@query(f"""WITH {_BOX}, e AS (SELECT page // 50 AS batch, page, cls <> 'bubble' AS box, x1 % 4 > 0 AS got, x1 % 3 > 0 AS ok FROM fx_box),
c AS (SELECT batch, count(DISTINCT page) AS pages, count(*) FILTER (NOT box) AS bubbles, count(*) FILTER (box) AS raw_boxes, count(*) FILTER (box AND got AND ok) AS kept, count(*) FILTER (box AND got AND NOT ok) AS filtered FROM e GROUP BY batch)
SELECT *, CASE WHEN filtered > 0 AND kept = 0 THEN 'warning' ELSE 'info' END AS level FROM c""")
def batch_metrics(spark, sf_dir):
    e = fx_box(spark, sf_dir).withColumns({"text": F.when(F.col("x1") % 4 > 0, F.lit("read")), "valid": F.col("x1") % 3 > 0})
    return events.batch_metrics(e, F.expr("page div 50"))
