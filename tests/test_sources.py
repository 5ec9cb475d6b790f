"""Image, record, settings and stream round trips."""

import datetime
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageflow import config
from pageflow.operators import pixels, stages
from pageflow.sources import pages, sinks
from pageflow.streaming import progress


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pages")
    rng = np.random.default_rng(0)
    for k in range(5):
        (path / f"p{k}.png").write_bytes(sinks.png(rng.integers(0, 256, (20 + k, 30, 3), dtype=np.uint8)))
    (path / "broken.png").write_bytes(b"no image")
    return f"file://{path}"


def test_images_round_trip(spark, folder, tmp_path):
    listed = pages.listing(spark, folder, 2).orderBy("page_no").collect()
    assert [(r.page, r.page_no, r.batch_no) for r in listed][:3] == [("broken.png", 1, 0), ("p0.png", 2, 0), ("p1.png", 3, 1)]
    images = pages.images(spark, folder)
    report = pages.decode_report(images.select("page", (images.image.height < 0).alias("failed"))).first()
    assert (report.n, report.failed, report.names) == (6, 1, ["broken.png"])
    good = images.filter("image.height > 0")
    assert sinks.write_images(good, f"file://{tmp_path}/out").count() == 5
    again = {r.page: r.image for r in pages.images(spark, f"file://{tmp_path}/out").collect()}
    for r in good.collect():
        assert (pixels.decoded(again[r.page].asDict()) == pixels.decoded(r.image.asDict())).all()
    assert [r.page for r in pages.one_image(spark, folder, "p3.png").collect()] == ["p3.png"] and pages.one_image(spark, folder, "p9.png").count() == 0
    skipped = spark.createDataFrame([("p0.png",), ("broken.png",), ("p9.png",), ("p0.png",)], "page string")
    assert [r.page for r in pages.finished_images(spark, skipped, folder).collect()] == ["p0.png"]
    boxes = spark.createDataFrame([("p1.png", 0, 0, 5, 5), ("p1.png", 1, 2, 9, 9)], "page string, x1 int, y1 int, x2 int, y2 int")
    got = pixels.measure(good, boxes, lambda page, b: {"page": b["page"], "mean": float(page[b["y1"] : b["y2"], b["x1"] : b["x2"]].mean())}, "page string, mean double")
    assert got.count() == 2 and got.agg({"mean": "min"}).first()[0] > 0


def test_records(spark, tmp_path):
    text = {"text_box": [1.5, 2, 3, 4], "original_text": "a", "font_size": 9}
    data = [
        {"source_page": "b", "speech_bubbles": [{"bubble_box": [0, 0, 9, 9], "attachment": "none", "text_element": text | {"font_stroke_ratio": 0.5}}]},
        {"source_page": "c", "speech_bubbles": [], "freeform_texts": [text | {"font_stroke_ratio": 0.5, "font_char_ratio": None}, text | {"font_char_ratio": 0.25, "translated_text": ""}]},
    ]
    (tmp_path / "r.json").write_text(json.dumps(data, indent=1))
    records = pages.page_records(spark, f"file://{tmp_path}/r.json")
    rows = {r.source_page: r for r in records.collect()}
    assert rows["b"].speech_bubbles[0].text_element.font_char_ratio == 0.5 and rows["b"].freeform_texts == []
    assert [x.font_char_ratio for x in rows["c"].freeform_texts] == [None, 0.25] and [x.translated_text for x in rows["c"].freeform_texts] == [None, ""]
    sinks.write_records(records, f"file://{tmp_path}/out")
    sinks.write_records(records, f"file://{tmp_path}/out", append=True)
    assert pages.page_records(spark, f"file://{tmp_path}/out").count() == 4
    by_line = pages.stored_records(spark, f"file://{tmp_path}/out")
    assert sorted(by_line.distinct().collect()) == sorted(records.collect()) and by_line.count() == 4
    assert pages.stored_records(spark, f"file://{tmp_path}/none").count() == 0 and pages.stored_records(spark, f"file://{tmp_path}/none").columns == records.columns
    assert pages.elements(records).count() == 3
    state = f"file://{tmp_path}/state"
    assert pages.completed(spark, state).count() == 0
    sinks.mark_done(records.select("source_page").toDF("page"), state, 1)
    assert pages.completed(spark, state).count() == 2


def test_settings(tmp_path, monkeypatch):
    s = config.Settings(size_mode="light", tolerance=0.9, fallback_mode="loose", view_mode="fast")
    assert (s.char_weight, s.shrink, s.growth, s.low_confidence, s.views) == (25.0, 0.5, 1.5, 0.15, 2)
    s.fill_colour = (1, 2, 3)
    s.save(str(tmp_path / "s.json"))
    t = config.load(str(tmp_path / "s.json"))
    assert t == s and "views" not in json.loads((tmp_path / "s.json").read_text())
    t.update({"views": 9, "unknown": 1})
    assert t.views == 2
    monkeypatch.setenv("PAGEFLOW_API_KEY", " k ")
    assert t.key() == "k"
    with pytest.raises(ValueError):
        config.Settings(least_size=80)


def test_stages(spark):
    tries = []

    def call():
        tries.append(1)
        yield "part"
        if len(tries) < 3:
            raise OSError
        yield "s"

    waits = []
    assert stages.with_retries(call, sleep=waits.append) == "parts" and waits == [3, 8]
    requests = spark.createDataFrame([("a", k, f"r{k}") for k in range(4)] + [("b", 0, "x")], "session string, turn long, request string")
    got = stages.chat(requests, lambda history, request: iter([str(len(history)), request]), exchanges=2, waits=())
    assert sorted(r.response for r in got.collect()) == ["0r0", "0x", "1r1", "2r2", "2r3"]

    class Double:
        def load(self):
            return 2

        def run(self, loaded, rows: pd.DataFrame) -> pd.DataFrame:
            return rows.assign(v=rows["v"] * loaded)

    assert stages.infer(spark.createDataFrame([(3,)], "v long"), Double(), "v long").first().v == 6
    with pytest.raises(OSError):
        stages.first_loadable(lambda: open("/none"))


def test_streams(spark, folder, tmp_path):
    schema = "ts timestamp, phase string, level string, current long, total long, message string, page_name string, elapsed double, extras map<string, string>"
    rows = [(datetime.datetime(2024, 1, 1, h), p, "info", 1, 4, "m", None, None, None) for h in range(8) for p in ("ocr", "pass2_page")]
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/events")
    query = progress.counts(progress.read(spark, f"file://{tmp_path}/events"), f"file://{tmp_path}/hours", f"file://{tmp_path}/ck")
    query.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/hours").filter("n = 1").count() == 10  # hours behind the watermark of 2 hours
    line = progress.lines(spark.createDataFrame(rows[1:2], schema)).first().line
    assert line == "[pass 2] 1/4 (25%) m"
    seen = []
    progress.page_batches(spark, folder, lambda df, k: seen.append(df.count()), f"file://{tmp_path}/ck2", pages=4).awaitTermination(120)
    assert seen == [4, 2]


def test_numbers_are_gapless_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        rows = spark.range(400_000, numPartitions=16).select(((F.col("id") * 7919) % 400_000).alias("id"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("payload"))
        got = pages.numbered(rows, "id").agg(F.count("*"), F.countDistinct("page_no"), F.count_if(F.col("page_no") == F.col("id") + 1)).first()
        assert tuple(got) == (400_000, 400_000, 400_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
