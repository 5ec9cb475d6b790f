import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "red", "river", "stone", "walks", "into", "an", "old", "house"]) + rng.choice(["", "s", "ly", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(55, 160)) for _ in range(60)]
    found = [(k, t, ["en", "de", None][k % 3], ["a", "b", None][k % 3], len(t), 0.5, 7) for k, t in enumerate(texts)]
    near = texts[0].split(" ")
    near[5] = "changed"
    found += [
        (100, texts[0], "en", "a", 1, None, 1), (101, " ".join(near), "en", "b", 1, 0.1, None), (102, None, None, None, None, None, None), (103, "", "en", "a", 0, 0.0, 0),
        (104, " \n\t ", "en", "b", 3, 0.0, 0), (105, prose(rng, 9000), "en", "a", 1, 0.0, 0), (106, "x" * 20000, "en", "a", 1, 0.0, 0), (None, texts[3], "en", "a", 1, 0.0, 0),
        (107, "same row", "en", "a", 8, 0.0, 0), (107, "same row", "en", "a", 8, 0.0, 0), (108, "a <|endoftext|>  b\r\n  ünï ½ 漢字 it's", "en", "a", 8, 0.0, 0),
    ]
    return found


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
