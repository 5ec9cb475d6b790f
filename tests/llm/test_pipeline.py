"""The corpus pipeline against plain versions of its stages, on awkward rows with columns of clashing names."""

import random

import pyarrow as pa
import pytest

from pageflow.llm import cf_toxicity, common, dart_minhash, fm_quality
from tests.llm.conftest import SCHEMA, prose

pipeline = pytest.importorskip("corpus_pipeline")
CLASHING = "size long, target double, taken long, copies long, source_size long, _own string, _id long, _copy long, sequence_id long"


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('pipeline')}"
    rng = random.Random(8)
    bad = [(500 + k, " ".join(rng.choice(["$$$", "click!!", "BUY", "now|", "##"]) for _ in range(80)), "en", "a", 1, 0.0, 0) for k in range(30)]
    rude = [(600 + k, f"{prose(rng, 60)} scumbag {prose(rng, 5)} filthy scumbag", "de", "b", 1, 0.0, 0) for k in range(30)]
    every = [(*r, k, 0.5, 1, 2, 3, f"own{k}", 4, 5, 6) for k, r in enumerate([*rows, *bad, *rude])]
    spark.createDataFrame(every, f"{SCHEMA}, {CLASHING}").write.parquet(f"{where}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(500 + k, 0, 0) for k in range(30)] + [(600 + k, 1, 1) for k in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    toxic = dict(enumerate(r.score for r in cf_toxicity.score_texts(docs, *cf_toxicity.train(docs, labels)).collect()))
    rows = docs.collect()
    got = pipeline.toxicity(spark, docs, folder)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted(map(str, kept)) == sorted(str(r) for k, r in enumerate(rows) if toxic[k] < pipeline.TOXIC)
    ids = {r.doc_id for r in kept}
    assert not ids & set(range(600, 630)) and set(range(60)) <= ids
    machine = fm_quality.train(docs, labels)
    good = pipeline.quality(spark, got, folder)
    assert good.columns == docs.columns
    left = good.collect()
    assert sorted(map(str, left)) == sorted(str(r) for r in kept if machine.score((r.text or "").encode()) >= pipeline.QUALITY)
    assert not {r.doc_id for r in left} & set(range(500, 530)) and set(range(60)) <= {r.doc_id for r in left}
    one = pipeline.near_duplicates(spark, good, folder)
    assert one.columns == docs.columns
    stays = one.collect()
    bags = [dart_minhash.bag((r.text or "").encode()) for r in stays]
    same = [(i, j) for i in range(len(bags)) for j in range(i) if (stays[i].text or "") == (stays[j].text or "") or dart_minhash.similarity(bags[i], bags[j]) >= 0.8]
    assert not same and {str(r) for r in stays} <= {str(r) for r in left}
    mixed = pipeline.mixing(spark, one, folder)
    assert mixed.columns == docs.columns and {str(r) for r in mixed.collect()} <= {str(r) for r in stays}


def test_run_gives_gapless_sequences_and_takes_empty_tables(spark, folder, none, tmp_path):
    at = {}
    for r in pipeline.run(spark, folder).collect():
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    empty = f"file://{tmp_path}"
    none.write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert pipeline.run(spark, empty).count() == 0


def test_workers_hold_the_caches_of_one_operator():
    kept = common.store("one")
    kept["words"] = 1
    assert common.store("one") is kept
    assert common.store("two") == {} and common.store("one") == {}


def test_stages_with_texts_in_python_take_small_batches(spark, folder, monkeypatch):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before, seen = [spark.conf.get(n) for n in names], []
    save = common.Scratch.save

    def saved(self, df, name):
        seen.append((name, int(spark.conf.get(names[0])), int(spark.conf.get(names[1]).rstrip("b"))))
        return save(self, df, name)

    monkeypatch.setattr(common.Scratch, "save", saved)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pipeline.near_duplicates(spark, docs, folder)
    pipeline.packing(spark, docs, folder)
    assert {"signed", "bags", "items"} <= {name for name, _, _ in seen}
    assert all(rows <= 1000 and size <= 4 << 20 for _, rows, size in seen)
    assert [spark.conf.get(n) for n in names] == before


def test_small_batches_reach_python(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    wide = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) as text")
    with common.small_batches(spark):
        found = wide.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 3000 and max(r.n for r in found) <= 1000 and max(r.bytes for r in found) < 8 << 20


def test_filter_judges_parts_of_batches(spark):
    def odd(batch):
        assert batch.num_rows <= 1000
        return [i % 2 == 1 for i in batch.column(0).to_pylist()]

    assert [r.id for r in common.filtered(spark.range(0, 2501, 1, 1), odd).collect()] == list(range(1, 2501, 2))
