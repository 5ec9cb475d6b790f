"""Document quality by a factorisation machine.

Inputs of a text: hashed words (presence, scaled to unit length), structure statistics (each as a value and as a hashed
band) and metadata that the text itself gives (length bands, whether it holds links or markup). Score: logistic of
bias + <w, x> + 1/2 * sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], so pairs cost linear time. Trained by AdaGrad
on a bounded sample of labelled rows; the model has a fixed size and is broadcast.

Null and empty texts are scored from their statistics (all zero). Rows are scored one by one, whole however long, so
repeated rows and ties have equal scores, an empty table has none, and other columns, whatever their names, are kept as
they are. Without labelled rows the machine keeps its first, random factors and no weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import filtered, scored, store, text_bytes
from .labelled import training_rows

BITS, FACTORS = 16, 8
#: Statistics come first among the inputs, each with BANDS hashed-free bands of its own; hashed words follow.
STATS, BANDS = 14, 12
WIDTH = STATS * (1 + BANDS) + (1 << BITS)
_WORD_SPACE = 1 << BITS
_LINK = re.compile(rb"https?://|www\.|<[a-z/]", re.I)
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_NOT_SYMBOL = bytes(set(range(256)) - set(b"#*$%&|<>{}[]=+~^\\/_@"))
_NOT_MARK = bytes(set(range(256)) - set(b"!?"))
_NOT_DIGIT = bytes(set(range(256)) - set(b"0123456789"))


def statistics(data: bytes, words: list[bytes]) -> list[float]:
    """STATS values of about 0 to 1."""
    n, size = max(1, len(words)), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    share = lambda drop: len(data.translate(None, drop)) / size
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        min(1.0, np.log1p(len(words)) / 10),
        min(1.0, size / n / 20),
        distinct / n,
        same / n,
        pairs / n,
        share(_NOT_UPPER),
        share(_NOT_SYMBOL),
        min(1.0, 4 * share(_NOT_MARK)),
        share(_NOT_DIGIT),
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, sum(w[-1:] in b".,;:" for w in words) / n * 4),
        min(1.0, data.count(b" | ") / n * 2),
        min(1.0, len(_LINK.findall(data)) / n * 10),
    ]


def inputs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the inputs that aren't 0; indices are distinct."""
    words = data.split()
    stats = np.array(statistics(data, words))
    bands = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * (BANDS - 1) + 0.999).astype(int), BANDS - 1)
    hashed = np.unique(np.fromiter(map(zlib.crc32, set(data.lower().split())), np.int64) & (_WORD_SPACE - 1))
    at = np.concatenate([np.arange(STATS), STATS + np.arange(STATS) * BANDS + bands, STATS * (1 + BANDS) + hashed])
    value = np.concatenate([stats, np.full(STATS, 0.5), np.full(len(hashed), 0.5 / np.sqrt(max(1, len(hashed))))])
    return at, value


class Machine:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(WIDTH, np.float32)
        self.v = rng.normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32)

    def logit(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        v = self.v[at]
        sums = x @ v
        return self.bias + float(self.w[at] @ x) + 0.5 * float(sums @ sums - (x * x) @ (v * v).sum(1)), sums

    def score(self, data: bytes) -> float:
        return 1 / (1 + np.exp(-np.clip(self.logit(*inputs(data))[0], -30, 30)))

    def fit(self, texts: Iterable[bytes], y: np.ndarray, *, epochs: int = 6, rate: float = 0.15, l2: float = 1e-5, seed: int = 3) -> Machine:
        rows = [(at.astype(np.int32), x.astype(np.float32)) for at, x in map(inputs, texts)]
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(WIDTH, 0.1, np.float32), np.full((WIDTH, FACTORS), 0.1, np.float32), 0.1
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                at, x = rows[k]
                logit, sums = self.logit(at, x)
                g = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[k]
                if abs(g) < 1e-3:
                    continue
                v = self.v[at]
                dw = g * x + l2 * self.w[at]
                dv = g * x[:, None] * (sums - v * x[:, None]) + l2 * v
                gw[at] += dw * dw
                gv[at] += dv * dv
                gb += g * g
                self.w[at] -= rate * dw / np.sqrt(gw[at])
                self.v[at] -= rate * dv / np.sqrt(gv[at])
                self.bias -= rate * g / np.sqrt(gb)
        return self


def train(docs: DataFrame, labels: DataFrame, *, most: int = 12288, parts: int = 5, held: int = 0, **options) -> Machine:
    return Machine().fit(*training_rows(docs, labels, "quality", parts=parts, held=held, most=most), **options)


def scorer(docs: DataFrame, machine: Machine):
    """A function from a batch with texts to their scores, for use on executors."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    def score(batch: pa.RecordBatch) -> np.ndarray:
        store("quality")  # what other operators kept goes
        model = Machine.__new__(Machine)
        model.bias, model.w, model.v = shared.value
        return np.fromiter((model.score(t) for t in text_bytes(batch)), float, batch.num_rows)

    return score


def score_texts(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every whole text; no shuffle."""
    return scored(docs, scorer(docs, machine))


def keep(docs: DataFrame, machine: Machine, *, threshold: float) -> DataFrame:
    """The rows that score at least the threshold, all columns as they are; no shuffle."""
    score = scorer(docs, machine)
    return filtered(docs, lambda batch: score(batch) >= threshold)
