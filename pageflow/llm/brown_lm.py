"""Language-model scores by a Brown class-based bigram model.

P(word | previous) = P(class | previous class) * P(word | class), words lower-cased (A-Z) and ended by an end token, which
also starts a text. Exchange clustering assigns the classes in two stages, as the method does for large vocabularies:

1. The core: the `frequent` commonest words and `affixes` groups of all other words (by their first and last two bytes)
   are moved one by one to the class that raises the likelihood of the adjacent-pair counts most, until a sweep moves
   nothing or `sweeps` are over.
2. The rest: every other word that occurs `evidence` times or more, however many there are, is moved by itself. Its own
   counts of neighbours by class are gathered from the whole training part, and it goes from the class of its affix group
   to the class that raises the likelihood most, the other words staying where the core put them. This is distributed by
   word, so the clustered vocabulary grows with the corpus. (The few pairs of a word with itself, or with a neighbour in
   the class it leaves or enters, are weighed as if the neighbour's class stayed as it was.)

Only words that are rarer, or were not seen, keep the class of their affix group. Then all tokens are coded with their
final classes and the class pairs counted anew. Emissions are smoothed by one, with one unseen word per class;
transitions back off to class frequencies. Both sum to one.

Counts cover the whole training part. What reaches the driver is bounded by parameters: the `direct` commonest words with
their classes and (frequent + affixes)^2 pair counts. Rarer words get counts and classes by a join, so no vocabulary is
broadcast that grows with the data. Executors hold bounded parts: texts come in batches of about 4 MiB, results go back in
slices, tokens are scored about a million at a time. Null and empty texts are the end token alone. Repeated rows, null ids and ties are
separate rows with equal scores. Without training rows N and V are 0 and all classes are even; an empty table gives no
rows. Long texts are taken whole. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, fold, small_batches, text_bytes

END = b""  # no word is empty


def sliced(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows, as the JVM holds a part at a time."""
    return (batch.slice(low, rows) for low in range(0, batch.num_rows, rows))


def by_tokens(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `most` bytes (tokens) in a column of codes, or of one row."""
    ends, low = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(), dtype=np.int64), 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def word_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """word (binary, lower case; the end token is empty) and its count c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            found = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return sliced(found)

        for batch in batches:
            for data in text_bytes(batch):
                counts.update(data.lower().split())
                if len(counts) > flush:
                    yield from out()
            counts[END] += batch.num_rows
        if counts:
            yield from out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def affix(word: bytes, groups: int) -> int:
    return zlib.crc32(word[:2] + b"|" + word[-2:]) % groups


def pair_counts(docs: DataFrame, ids: dict[bytes, int], affixes: int) -> DataFrame:
    """pair (left item * items + right item) and n over adjacent tokens."""
    frequent, items = len(ids), len(ids) + affixes
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, held, size = shared.value, np.zeros(items * items, np.int64), [], 0
        item = Memo(lambda w: known[w] if w in known else frequent + affix(w, affixes), limit=100_000)
        for batch in batches:
            for data in text_bytes(batch):
                words = [END, *data.lower().split(), END]
                codes = np.fromiter(map(item.__getitem__, words), np.int64, len(words))
                held.append(codes[:-1] * items + codes[1:])
                size += len(words)
                if size > 500_000:
                    total += np.bincount(np.concatenate(held), minlength=items * items)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=items * items)
        pairs = np.flatnonzero(total)
        for at in range(0, len(pairs), 50_000):
            part = pairs[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["pair", "n"])

    return docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 6) -> np.ndarray:
    """Class of each item, from the items' adjacent-pair counts."""
    items = len(pairs)
    weight = pairs.sum(1) + pairs.sum(0)
    order = np.argsort(-weight, kind="stable")
    own = np.empty(items, np.int64)
    own[order] = np.arange(items) % classes
    right = np.zeros((items, classes))  # to the item's right, by class
    left = np.zeros((items, classes))
    for c in range(classes):
        right[:, c] = pairs[:, own == c].sum(1)
        left[:, c] = pairs[own == c].sum(0)
    table = np.stack([right[own == c].sum(0) for c in range(classes)])
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a, loop = own[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= loop
            l[a] -= loop
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= loop
            rows, columns, middle = table.sum(1) + l, table.sum(0) + r, np.diag(table)  # of all other tokens
            gain = (_f(table + r) - _f(table)).sum(1) + (_f(table + l[:, None]) - _f(table)).sum(0)
            gain += _f(middle + r + l + loop) - _f(middle + r) - _f(middle + l) + _f(middle)
            gain -= _f(rows + r.sum() + loop) - _f(rows) + _f(columns + l.sum() + loop) - _f(columns)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += l
            table[b, b] += loop
            if b != a:
                moved += 1
                own[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return own


def packed(code: np.ndarray, near: np.ndarray, counts: np.ndarray, n: int) -> pa.Array:
    """For each word code below n (all occur, in order) its neighbours' counts, as bytes (near, up to 255)."""
    times = (counts - 1) // 255 + 1
    ends = np.cumsum(times)
    data = np.empty((int(ends[-1]) if len(ends) else 0, 2), np.uint8)
    data[:, 0] = np.repeat(near, times)
    data[:, 1] = 255
    data[ends - 1, 1] = counts - (times - 1) * 255
    last = np.flatnonzero(np.append(code[1:] != code[:-1], True)[: len(code)])
    offsets = np.concatenate([[0], 2 * ends[last]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Interned(dict):
    """Numbers words in the order of their first look-up."""

    def __missing__(self, key):
        self[key] = value = len(self)
        return value


def neighbours(docs: DataFrame, class_of: Callable[[list[bytes]], np.ndarray], classes: int, flush: int = 1_500_000) -> DataFrame:
    """word and its `packed` neighbours, right ones by class, left ones by `classes` + class; several rows a word."""

    def out(code: Interned, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, wide = list(code), 2 * classes
        at = np.concatenate(held).astype(np.int32 if len(words) * wide < 1 << 31 else np.int64)
        code.clear()
        held.clear()
        kind = class_of(words).astype(at.dtype)[at]
        keys = np.concatenate([at[:-1] * wide + kind[1:], at[1:] * wide + classes + kind[:-1]])
        del at, kind
        keys.sort()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
        counts, keys = np.diff(starts, append=starts.dtype.type(len(keys))), keys[starts]
        near = packed(keys // wide, (keys % wide).astype(np.uint8), counts, len(words))
        return sliced(pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), near], ["word", "near"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, size = Interned(), [], 0
        for batch in batches:
            for data in text_bytes(batch):
                if not held:  # each text's end is the next one's start
                    code[END]
                    held.append(np.zeros(1, np.int32))
                words = data.lower().split()
                words.append(END)
                held.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size > flush:
                    yield from out(code, held)
                    size = 0
        if held:
            yield from out(code, held)

    return docs.select("text").mapInArrow(run, "word binary, near binary")


def best_classes(near: np.ndarray, at: np.ndarray, table: np.ndarray, block: int = 64) -> np.ndarray:
    """Where the likelihood gains most, for words now in the classes `at`: near has counts of right, then left classes."""
    classes = len(table)
    cells = np.concatenate([table, table.T], 1)  # by class of the word: right classes, then left ones
    sums = table.sum(1), table.sum(0)
    found = np.empty(len(near), np.int64)
    for low in range(0, len(near), block):
        part, own = near[low : low + block], at[low : low + block]
        word, side = np.nonzero(part)
        n = part[word, side]
        others = cells[:, side].T.copy()
        others[np.arange(len(n)), own[word]] -= n
        np.maximum(others, 0, out=others)
        gain = np.zeros((len(part), classes))
        some, starts = np.unique(word, return_index=True)
        if len(some):
            gain[some] = np.add.reduceat(_f(others + n[:, None]) - _f(others), starts)
        for total, count in zip(sums, (part[:, :classes].sum(1), part[:, classes:].sum(1)), strict=True):
            left = np.repeat(total[None, :], len(part), 0)
            left[np.arange(len(part)), own] -= count
            gain -= _f(left + count[:, None]) - _f(left)
        best = gain.argmax(1)
        here = np.arange(len(part))
        found[low : low + block] = np.where(gain[here, best] > gain[here, own] + 1e-9, best, own)
    return found


def insert(near: DataFrame, core: set[bytes], class_of: Callable[[list[bytes]], np.ndarray], table: np.ndarray, evidence: int) -> DataFrame:
    """word, c and its class k, from the rows of `neighbours`; a word's rows are summed as they stream by in order."""
    classes = len(table)

    def decide(words: list[bytes], sums: np.ndarray) -> pa.RecordBatch:
        c, k = sums[:, :classes].sum(1), class_of(words)
        moving = np.flatnonzero((c >= evidence) & np.fromiter((w not in core for w in words), bool, len(words)))
        k[moving] = best_classes(sums[moving], k[moving], table)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c.astype(np.int64)), pa.array(k.astype(np.int32))], ["word", "c", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                piece = batch.slice(low, 4096)
                words = piece.column(0).to_pylist()
                new = np.fromiter((a != b for a, b in zip(words, [None, *words[:-1]], strict=True)), bool, len(words))
                data = np.frombuffer(b"".join(piece.column(1).to_pylist()), np.uint8).reshape(-1, 2)
                at = np.repeat(np.cumsum(new) - 1, pc.binary_length(piece.column(1)).to_numpy() // 2)
                names = [words[i] for i in np.flatnonzero(new)]
                sums = np.bincount(at * (2 * classes) + data[:, 0], weights=data[:, 1], minlength=len(names) * 2 * classes).reshape(len(names), -1)
                if last == names[0]:
                    sums[0] += carried
                elif last is not None:
                    yield decide([last], carried[None, :])
                if len(names) > 1:
                    yield decide(names[:-1], sums[:-1])
                last, carried = names[-1], sums[-1].copy()
        if last is not None:
            yield decide([last], carried[None, :])

    return near.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, c long, k int")


@dataclass
class Model:
    """words: word, c and class k of every training word; the other words' class is that of their affix group."""

    words: DataFrame
    n_tokens: int
    n_types: int
    class_of: Callable[[list[bytes]], np.ndarray]  # by the core


def learn(training: DataFrame, scratch: Scratch, *, classes: int, frequent: int, affixes: int, evidence: int) -> Model:
    """Classes and counts of the words of the whole training part."""
    counts = scratch.save(word_counts(training), "counts")
    n_all, n_types = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    ids = {bytes(w): k for k, w in enumerate(counts.orderBy(F.desc("c"), "word").limit(frequent).toArrow().column("word").to_pylist())}
    if END not in ids:
        ids[END] = len(ids)
    items = len(ids) + affixes
    found = scratch.save(pair_counts(training, ids, affixes), "pairs").toArrow()
    pairs = np.zeros(items * items)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    pairs = pairs.reshape(items, items)
    own = exchange(pairs, classes)
    table = np.zeros((classes, classes))
    np.add.at(table, (own[:, None], own[None, :]), pairs)
    n_core = len(ids)

    def class_of(words: list[bytes]) -> np.ndarray:
        return own[np.fromiter((ids[w] if w in ids else n_core + affix(w, affixes) for w in words), np.int64, len(words))]

    near = neighbours(training, class_of, classes)
    return Model(scratch.save(insert(near, set(ids), class_of, table, evidence), "words"), n_all, n_types, class_of)


def coded(docs: DataFrame, model: Model, scratch: Scratch, direct: int) -> DataFrame:
    """doc_id, n (tokens), known, logs (sum of log10(c + 1)) and codes (a byte for each token's class) of every text."""
    top = model.words.orderBy(F.desc("c"), "word").limit(direct).toArrow().to_pydict()
    shared = docs.sparkSession.sparkContext.broadcast(({bytes(w): k for k, w in enumerate(top["word"])}, np.array(top["c"], np.int64), np.array(top["k"], np.uint8)))
    class_of = model.class_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, c, k = shared.value
        unknown = len(code)
        kind, log_c = np.append(k, np.uint8(0)), np.append(np.log10(c + 1.0), 0.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            heads, rare, owners, places = [], [], [], []
            for data in text_bytes(batch):
                words = data.lower().split()
                words.append(END)
                at = np.fromiter((code.get(w, unknown) for w in words), np.int64, len(words))
                where = np.flatnonzero(at == unknown)
                heads.append((row, len(words), len(words) - len(where), float(log_c[at].sum()), kind[at].tobytes()))
                rare.extend([words[i] for i in where])
                owners.append(np.full(len(where), row))
                places.append(where)
                row += 1
            n, m = len(heads), len(rare)
            columns = list(zip(*heads, strict=True)) or [()] * 5
            first, second = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (owners, places))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(columns[0], pa.int64()), pa.array(first)]),
                    pa.concat_arrays([batch.column(0), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(rare, pa.binary())]),
                    # of a text its number of tokens, of a rare word its place and the class of its affix group
                    pa.concat_arrays([pa.array(columns[1], pa.int64()), pa.array(second * 256 + class_of(rare))]),
                    *(pa.concat_arrays([pa.array(columns[i], kind_), pa.nulls(m, kind_)]) for i, kind_ in ((2, pa.int64()), (3, pa.float64()), (4, pa.binary()))),
                ],
                ["row", "doc_id", "word", "n", "known", "logs", "codes"],
            )

    rows = scratch.save(docs.mapInArrow(run, "row long, doc_id long, word binary, n long, known long, logs double, codes binary"), "rows")
    found = rows.filter("word is not null").select("word", "row", "n").join(model.words, "word", "left")
    at = F.when(F.col("k").isNull(), F.col("n")).otherwise(F.col("n") - F.pmod("n", F.lit(256)) + F.col("k"))
    found = found.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"), F.collect_list(at).alias("at"))
    d = rows.filter("word is null").drop("word").join(found, "row", "left")
    d = d.select("doc_id", "n", (F.col("known") + F.coalesce("more", F.lit(0))).alias("known"), (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))).alias("logs"), "codes", "at")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4).to_pylist()
            ends = np.cumsum([len(x) for x in texts])
            all_codes, lists = np.frombuffer(b"".join(texts), np.uint8).copy(), batch.column(5)
            many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = lists.flatten().to_numpy()
            all_codes[at // 256 + np.repeat(np.concatenate([[0], ends[:-1]]), many)] = at % 256
            data = all_codes.tobytes()
            filled = pa.array([data[e - len(x) : e] for e, x in zip(ends, texts, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], filled], ["doc_id", "n", "known", "logs", "codes"])

    done = scratch.save(d.mapInArrow(fill, "doc_id long, n long, known long, logs double, codes binary"), "coded")
    scratch.drop("rows")
    shared.destroy()
    return done


def score(
    docs: DataFrame, *, parts: int = 7, held: int = 2, classes: int = 64, frequent: int = 1024, affixes: int = 256, evidence: int = 5, direct: int = 131_072, backoff: float = 20.0
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    if not 0 < classes <= 128:
        raise ValueError("a neighbour has to fit a byte: 1 to 128 classes")
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    with small_batches(docs.sparkSession, rows=4096):
        model = learn(docs.filter(fold("doc_id", parts) != held), scratch, classes=classes, frequent=frequent, affixes=affixes, evidence=evidence)
        tokens = coded(docs, model, scratch, direct)
    start = int(model.class_of([END])[0])

    def pairs_of(texts: list[bytes]) -> np.ndarray:
        # A text ends with the class that starts the next one.
        k = np.frombuffer(bytes([start]) + b"".join(texts), np.uint8).astype(np.uint16)
        return k[:-1] * np.uint16(classes) + k[1:]

    def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for part in by_tokens(batch, 0):
                total += np.bincount(pairs_of(part.column(0).to_pylist()), minlength=classes * classes)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    by_class = np.zeros(classes * classes)
    training = tokens.filter(fold("doc_id", parts) != held).select("codes")
    for pair, n in training.mapInArrow(adjacent, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        by_class[pair] = n
    by_class = by_class.reshape(classes, classes)
    prior = (by_class.sum(0) + 1) / (by_class.sum() + classes)
    transition = np.log10((by_class + backoff * prior) / (by_class.sum(1, keepdims=True) + backoff))
    size = np.ones(classes)
    for k, v, n in model.words.groupBy("k").agg(F.count("*"), F.sum("c")).collect():
        size[k] = n + v + 1
    step = (transition - np.log10(size)).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_tokens(batch, 4):
                texts = part.column(4).to_pylist()
                sums = np.add.reduceat(step[pairs_of(texts)], np.cumsum([0, *(len(x) for x in texts[:-1])]))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sums, pa.float64())], ["doc_id", "n", "known", "logs", "model"])

    rest = math.log10(model.n_tokens + model.n_types + 1)
    return tokens.mapInArrow(run, "doc_id long, n long, known long, logs double, model double").select(
        "doc_id",
        (fold("doc_id", parts) == held).alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(int(model.n_tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n") * F.lit(rest)).alias("base_score"),
        (F.col("logs") + F.col("model")).alias("score"),
    )
