"""Toxicity by a counterfactual-regularised linear classifier.

The score of a text is a logistic function of the sum of its distinct words' weights; a word's weight adds those of its
hashed features (the word and its beginnings of 4 to 6 letters), so inflected forms of a learnt stem count. Training
takes mini-batches of labelled texts. For sentences with identity terms it also makes the text with every term swapped
for another one and adds a penalty on the squared change of the logit, so that naming a group doesn't move the score.
Where few labelled sentences name a group, the same pair is made by putting two terms into the sentence in turn.

Inputs are the texts alone, however long. Null and empty texts get the score of the bias. Rows are scored one by one, so
repeated rows and ties have equal scores, an empty table has none, and other columns, whatever their names, are kept as
they are. Without labelled rows all weights are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, filtered, scored, store, text_bytes
from .labelled import training_rows

IDENTITY_TERMS = (
    "women men woman man girls boys muslim muslims christian christians jewish jews hindu hindus buddhist atheist catholic protestant "
    "black white asian african latino arab american european immigrant immigrants refugee refugees foreigner foreigners gay lesbian "
    "bisexual straight queer transgender trans disabled deaf blind elderly old young poor rich "
    "frauen männer juden muslime christen ausländer femmes hommes juifs musulmans chrétiens étrangers mujeres hombres judíos musulmanes cristianos extranjeros"
).split()
_EDGES = b".,;:!?\"'()[]{}<>*#$%&|_-"
BITS = 18


def words(data: bytes) -> set[bytes]:
    """Distinct words, ASCII case and edge punctuation dropped."""
    return {w.strip(_EDGES) for w in data.lower().split()} - {b""}


def features(word: bytes) -> list[int]:
    """Hashed features of a word."""
    mask = (1 << BITS) - 1
    text = word.decode("utf-8", "replace")
    return [zlib.crc32(word) & mask] + [zlib.crc32(text[:n].encode(), n) & mask for n in (4, 5, 6) if len(text) >= n]


def swapped(data: bytes, terms: dict[bytes, bytes]) -> bytes | None:
    """The text with each identity term replaced by its partner; None where it holds none."""
    found = False
    out = []
    for word in data.lower().split():
        bare = word.strip(_EDGES)
        if bare in terms:
            found = True
            word = word.replace(bare, terms[bare])
        out.append(word)
    return b" ".join(out) if found else None


def text_features(data: bytes) -> np.ndarray:
    return np.fromiter((f for w in sorted(words(data)) for f in features(w)), np.int32)


def fit(texts: Iterable[bytes], y: np.ndarray, *, terms: Iterable[str] = IDENTITY_TERMS, penalty: float = 1.0, l1: float = 0.01, epochs: int = 5, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) by AdaGrad over single texts and counterfactual pairs, in a fixed order.

    Weights are evidence for toxicity: they stay at 0 or above, and `l1` takes those of neutral words back to 0, so the
    many neutral words of a long text don't outweigh (or add up to) a toxic one. Texts are taken one at a time; what is
    held of each are its features and those by which its counterfactual differs.
    """
    rng = np.random.default_rng(seed)
    ring = [t.lower().encode() for t in dict.fromkeys(terms)]
    partner = {a: ring[(k + 1) % len(ring)] for k, a in enumerate(ring)}
    rows: list[np.ndarray] = []
    differs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, text in enumerate(texts):
        own = text_features(text)
        rows.append(own)
        other = swapped(text, partner) if ring else None
        if other is not None:
            other = text_features(other)
        elif len(ring) > 1 and k % 8 == 0:  # sentences that name no group: two terms put in, in turn
            own, other = (text_features(text + b" " + ring[i]) for i in rng.choice(len(ring), 2, replace=False))
        if other is not None:
            differs[k] = np.setdiff1d(own, other), np.setdiff1d(other, own)
    w, total = np.zeros(1 << BITS), np.ones(1 << BITS)
    bias, bias_total = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else 0.0, 1.0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            f = rows[k]
            g = 1 / (1 + np.exp(-np.clip(w[f].sum() + bias, -30, 30))) - y[k]
            if abs(g) > 1e-4 and len(f):
                unique = np.unique(f)
                total[unique] += g * g
                w[unique] = np.maximum(0, w[unique] - rate * (g + l1) / np.sqrt(total[unique]))
            bias_total += g * g
            bias -= 0.1 * g / np.sqrt(bias_total)
            if (pair := differs.get(int(k))) is not None:
                change = penalty * (w[pair[0]].sum() - w[pair[1]].sum())
                for part, sign in zip(pair, (1, -1), strict=True):
                    if len(part) and change:
                        step = sign * change
                        total[part] += step * step
                        w[part] = np.maximum(0, w[part] - rate * step / np.sqrt(total[part]) / max(1, len(part)))
    return w, bias


def scorer(docs: DataFrame, weights: np.ndarray, bias: float):
    """A function from a batch with texts to their scores, for use on executors. The model has a fixed size (2 ** BITS weights), so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    key = ("toxic", id(shared), zlib.crc32(weights.tobytes()))

    def score(batch: pa.RecordBatch) -> np.ndarray:
        w, b = shared.value
        kept = store("toxicity")
        if kept.get("toxic", (None,))[0] != key:
            kept["toxic"] = key, Memo(lambda word: float(w[features(word)].sum()), 400_000)
        get = kept["toxic"][1].__getitem__
        logits = np.fromiter((sum(map(get, words(t))) for t in text_bytes(batch)), float, batch.num_rows) + b
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    return score


def score_texts(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score of every whole text; no shuffle."""
    return scored(docs, scorer(docs, weights, bias))


def keep(docs: DataFrame, weights: np.ndarray, bias: float, *, threshold: float) -> DataFrame:
    """The rows that score below the threshold, all columns as they are; no shuffle."""
    score = scorer(docs, weights, bias)
    return filtered(docs, lambda batch: score(batch) < threshold)


def train(docs: DataFrame, labels: DataFrame, *, most: int = 16384, parts: int = 4, held: int = 2, **options) -> tuple[np.ndarray, float]:
    return fit(*training_rows(docs, labels, "toxic", parts=parts, held=held, most=most), **options)
