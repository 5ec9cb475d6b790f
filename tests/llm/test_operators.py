"""Each corpus operator against a brute-force version, a round trip or held-out labels, on awkward rows and empty tables."""

import collections
import io
import math
import re
import zlib
from array import array
from unittest import mock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pageflow.llm import adaptive_scan, bpe_count, brown_lm, certified_packing, cf_toxicity, dart_minhash, encoding, entropy_mix, fm_quality, mcd_rules, queries, seekable_ids

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long"


def ids(name, text, end=2):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return array("I", [*t.encode(text or "", add_special_tokens=False).ids, end]).tobytes()


def test_brown_base_scores_and_distribution(spark, docs, none, rows):
    got = brown_lm.score(docs, classes=8, frequent=16, affixes=16, direct=20).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [b""]
    c = collections.Counter(w for r in rows if not held(r[0]) for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r[0], held(r[0]), len(words(r[1])), sum(c[w] > 0 for w in words(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r[1])), 6)) for r in rows)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert brown_lm.score(none).count() == 0


@pytest.mark.parametrize("direct", [5, 10_000])
def test_brown_scores_equal_those_of_a_plain_model(spark, docs, rows, direct):
    options = {"classes": 6, "frequent": 8, "affixes": 16, "evidence": 5}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [b""]
    model = brown_lm.learn(docs.filter(brown_lm.fold("doc_id", 7) != 2), brown_lm.Scratch(spark), **options)
    table = {bytes(r.word): (r.c, r.k) for r in model.words.collect()}
    c = collections.Counter(w for r in rows if not held(r[0]) for w in words(r[1]))
    assert {w: n for w, (n, _) in table.items()} == c
    # Of the words beyond the core some were moved by themselves.
    assert any(k != model.class_of([w])[0] for w, (n, k) in table.items() if n >= 5)
    assert all(k == model.class_of([w])[0] for w, (n, k) in table.items() if n < 5)
    kind = lambda w: table[w][1] if w in table else int(model.class_of([w])[0])
    pairs, size = np.zeros((6, 6)), np.ones(6)
    for r in rows:
        if not held(r[0]):
            k = [kind(b""), *map(kind, words(r[1]))]
            np.add.at(pairs, (k[:-1], k[1:]), 1)
    for n, k in table.values():
        size[k] += n + 1
    prior = (pairs.sum(0) + 1) / (pairs.sum() + 6)
    transition = (pairs + 20 * prior) / (pairs.sum(1, keepdims=True) + 20)
    assert transition.sum(1) == pytest.approx(np.ones(6))

    def total(text):
        k = [kind(b""), *map(kind, words(text))]
        return sum(math.log10(transition[a, b] * (table.get(w, (0,))[0] + 1) / size[b]) for a, b, w in zip(k, k[1:], words(text)))

    want = collections.Counter((r[0], round(total(r[1]), 6)) for r in rows)
    assert collections.Counter((r.doc_id, round(r.score, 6)) for r in brown_lm.score(docs, direct=direct, **options).collect()) == want


def test_inserted_words_take_the_class_of_most_gain():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 400, (5, 5)).astype(float) + 50
    near, at = rng.integers(0, 4, (40, 10)).astype(float), rng.integers(0, 5, 40)
    near[:, 5:] = rng.permuted(near[:, :5], axis=1)  # as many left neighbours as right ones
    f = lambda x: x * math.log(x) if x > 1 else 0.0

    def gain(w, b):
        own, total = at[w], 0.0
        for side, t in ((near[w, :5], table), (near[w, 5:], table.T)):
            without = t - (np.arange(5) == own)[:, None] * side
            total += sum(f(without[b, j] + side[j]) - f(without[b, j]) for j in range(5))
            row = t[b].sum() - (b == own) * side.sum()
            total -= f(row + side.sum()) - f(row)
        return total

    assert brown_lm.best_classes(near, at, table, block=7).tolist() == [max(range(5), key=lambda b: gain(w, b)) for w in range(40)]


def test_packed_neighbours_sum_to_the_counts(spark):
    near = brown_lm.packed(np.array([0, 0, 1]), np.array([3, 4, 0]), np.array([700, 255, 1]), 2)
    sums = [collections.Counter() for _ in range(2)]
    for total, x in zip(sums, near.to_pylist()):
        for k, n in zip(x[::2], x[1::2]):
            total[k] += n
    assert sums == [{3: 700, 4: 255}, {0: 1}]


def test_brown_reads_texts_in_small_batches(spark, monkeypatch):
    def checked(batch, read=brown_lm.text_bytes):
        assert batch.num_rows <= 4096 and batch.nbytes <= 8 << 20, (batch.num_rows, batch.nbytes)
        return read(batch)

    monkeypatch.setattr(brown_lm, "text_bytes", checked)
    limits = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(x) for x in limits]
    docs = spark.range(6300).repartition(1).selectExpr("id doc_id", "if(id < 6000, 'a b', repeat('long text ', 10000)) text")
    got = brown_lm.score(docs, classes=2, frequent=2, affixes=2).agg({"doc_id": "count", "n_tokens": "sum"}).first()
    assert sorted(got) == [6300, 6000 * 3 + 300 * 20_001]
    assert [spark.conf.get(x) for x in limits] == before


@pytest.mark.parametrize("part", [brown_lm.word_counts, lambda docs: brown_lm.neighbours(docs, lambda words: np.zeros(len(words), np.int64), 1)])
def test_brown_returns_words_in_small_batches(part):
    class Frame:
        """Keeps the function that Python workers would run."""

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        select = groupBy = agg = lambda self, *_: self

    with mock.patch.object(brown_lm, "F"):
        run = part(frame := Frame()) and frame.run
    texts = [" ".join(f"w{k}" for k in range(low, low + 1000)) for low in range(0, 120_000, 1000)]
    got = list(run([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert max(x.num_rows for x in got) <= 50_000
    words = [w for x in got for w in x.column(0).to_pylist()]
    assert len(words) == 120_001 and set(words) == {b"", *(f"w{k}".encode() for k in range(120_000))}


def test_codes_are_scored_in_parts_of_bounded_tokens():
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in (3, 4, 0, 9, 1, 1, 6)], pa.binary())], ["codes"])
    assert [[len(x) for x in part.column(0).to_pylist()] for part in brown_lm.by_tokens(batch, 0, most=7)] == [[3, 4, 0], [9], [1, 1], [6]]
    assert list(brown_lm.by_tokens(batch.slice(0, 0), 0)) == []


def test_exchange_separates_alternating_words():
    pairs = np.zeros((6, 6))
    pairs[:3, 3:] = pairs[3:, :3] = 10
    own = brown_lm.exchange(pairs, 2)
    assert len(set(own[:3])) == len(set(own[3:])) == 1 and own[0] != own[3]


@pytest.mark.parametrize("module, label, parts, held, least", [(fm_quality, "quality", 5, 0, 0.95), (cf_toxicity, "toxic", 4, 2, 0.7)])
def test_classifiers_on_held_out_labels(spark, docs, none, module, label, parts, held, least):
    source, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = module.train(source, labels)
    model = model if isinstance(model, tuple) else (model,)
    scores = {r.doc_id: r.score for r in module.score_texts(source, *model).collect()}
    test = [(scores[r.doc_id], r[label]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % parts == held]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > least
    got = module.score_texts(docs, *model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert module.keep(docs, *model, threshold=0.3).columns == docs.columns
    assert module.score_texts(none, *model).count() == 0
    if module is cf_toxicity:
        assert module.train(none.select("doc_id", "text"), labels.limit(0))[0].sum() == 0


def test_machine_equals_all_pairs():
    m = fm_quality.Machine()
    at, x = fm_quality.inputs(b"some words, some text | more !!")
    pairs = sum(float(m.v[i] @ m.v[j]) * a * b for k, (i, a) in enumerate(zip(at, x)) for j, b in list(zip(at, x))[:k])
    assert m.logit(at, x)[0] == pytest.approx(m.bias + float(m.w[at] @ x) + pairs, abs=1e-5)


def test_identity_terms_do_not_move_the_score():
    texts = [b"those deaf people are scum"] * 30 + [b"the weather is fine"] * 60
    w, _ = cf_toxicity.fit(texts, np.array([1.0] * 30 + [0.0] * 60), penalty=5.0)
    total = lambda word: w[cf_toxicity.features(word)].sum()
    assert total(b"deaf") < total(b"scum")


def test_near_duplicates(spark, docs, none, rows):
    got = dart_minhash.classes(docs).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.class_id for r in got}
    assert of[100] == of[101] == of[0] == 0 and of[102] == of[103] and of[None] == of[3] == 3 and of[107] == 107
    assert sum(r.stays for r in got) == len({r.class_id for r in got})
    kept = dart_minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.class_id for r in got})
    assert dart_minhash.classes(none).count() == 0


@pytest.mark.parametrize("per_block", [16, 1024])
def test_links_in_hot_bands_are_all_found(spark, per_block):
    """Texts with six of 60 changes each; twins share three of them (0.816), others at most two (0.762), and all share bands."""
    rng = np.random.default_rng(3)
    base, chosen, texts = [f"word{k}" for k in range(300)], [], []
    while len(chosen) < 160:
        six = rng.permutation(60)
        pair = [set(six[:6].tolist()), set(six[3:9].tolist())]
        if all(len(x & y) < 3 for x in pair for y in chosen):
            chosen += pair
    for some in chosen:
        texts.append(" ".join(f"changed{k}" if k % 5 == 0 and k // 5 in some else w for k, w in enumerate(base)))
    bags, label = [dart_minhash.bag(t.encode()) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if dart_minhash.similarity(bags[i], bags[j]) >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert len(set(label)) == 80
    got = dart_minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), per_block=per_block).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(label))


def test_texts_of_own_elements_are_not_dealt_into_blocks(spark, monkeypatch):
    """A hot band of 20 pairs of similar texts and 60 texts that share only 0.78 of their elements with any other."""
    base, texts = [f"word{k}" for k in range(300)], []
    for n in range(40):  # twins share six of their eight changes
        some = {k: f"changed{n // 2}" for k in range(1, 7)} | {k: f"own{n}" for k in (20, 21)}
        texts.append(" ".join(some.get(k // 5, w) if k % 5 == 0 else w for k, w in enumerate(base)))
    for n in range(60):
        texts.append(" ".join(f"own{n}x{k}" if k % 5 == 0 and k // 5 < 13 else w for k, w in enumerate(base)))
    bags = [dart_minhash.bag(t.encode()) for t in texts]
    want = [min(j for j in range(100) if dart_minhash.similarity(x, bags[j]) >= 0.8) for x in bags]
    assert want == [n - n % 2 for n in range(40)] + list(range(40, 100))
    dealt, save = {}, dart_minhash.Scratch.save

    def saved(self, df, name):
        done = save(self, df, name)
        if name in ("active", "members"):
            dealt[name] = {r.node for r in done.select("node").collect()}
        return done

    monkeypatch.setattr(dart_minhash.Scratch, "save", saved)
    got = dart_minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))
    assert dealt["members"] and dealt["active"] & set(range(40, 100)) and not dealt["members"] & set(range(40, 100))


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.integers(0, 6, 400), rng.integers(0, 6, 400)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    equal = (dart_minhash.signature(h[a > 0], a[a > 0], 2048) == dart_minhash.signature(h[b > 0], b[b > 0], 2048)).mean()
    assert equal == pytest.approx(truth, abs=0.05)


def test_outlier_statistics_and_verdicts(spark, docs, none, rows):
    def brute(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        places = collections.defaultdict(list)
        for i in range(len(w) - 2):
            places[tuple(w[i : i + 3])].append(i)
        covered = {p + k for v in places.values() if len(v) > 1 for p in v for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)

    extra = [(200, "a b c a b c a b c", "en", "a", 1, 0.0, 0), (201, "x y\nx y\n\nx y", "en", "a", 1, 0.0, 0), (202, "#* $", None, None, 1, 0.0, 0)]
    got = mcd_rules.judge(docs.unionByName(spark.createDataFrame(extra, docs.schema))).collect()
    want = collections.Counter((r[0], *brute(r[1])) for r in [*rows, *extra])
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert mcd_rules.judge(none).count() == 0


def test_outliers_are_the_low_quality_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [r for r in mcd_rules.judge(spark.read.parquet(f"{DATA}/documents.parquet")).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept for r in got if labels[r.doc_id]]) > 0.99 and np.mean([r.kept for r in got if not labels[r.doc_id]]) < 0.1


def test_id_files_round_trip(spark, docs, none, rows, tmp_path):
    manifest, digest = seekable_ids.encode_documents(docs, to=f"file://{tmp_path}/ids")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = collections.Counter(), 0
    for r in order:
        b = ids("word_bpe_49k.json", r[1])
        want[r[0], start, len(b) // 4, zlib.crc32(b)] += 1
        start += len(b) // 4
    assert collections.Counter(tuple(r) for r in digest.collect()) == want
    found = dict(x for part in manifest.collect() for x in seekable_ids.open_part(part.path).find([5, 105]))
    assert found == {k: ids("word_bpe_49k.json", next(r[1] for r in rows if r[0] == k)) for k in (5, 105)}
    assert seekable_ids.encode_documents(none)[1].count() == 0


def test_new_words_are_few_texts_to_the_library():
    """Pieces by the library's merge model one at a time were most of the cost of op6_seekable_frames."""
    rng = np.random.default_rng(5)
    sign = list("abcdeftz" * 4 + "éçüÉß½漢\x00\x7f\x85\xa0'.,-<>/w1")
    words = ["".join(rng.choice(sign, rng.integers(1, 12))) + str(rng.choice(["", ".", ",", "'s", "</w>", "!!"])) for _ in range(3000)]
    texts = [" ".join(words[k : k + 50]).encode() for k in range(0, 3000, 50)] + [b"", b" \n", "\u3000 x\u2028y".encode()]
    want = [ids("word_bpe_49k.json", t.decode())[:-4] for t in texts]

    class Counted:
        def __init__(self, model):
            self.model, self.pieces = model, 0

        def encode_batch_fast(self, texts, **options):
            self.pieces += len(texts)
            return self.model.encode_batch_fast(texts, **options)

    e = encoding.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    e.merges = Counted(e.merges)
    assert list(e.encode_all(texts)) == want
    assert len(e.pieces) > 1000 and e.merges.pieces < 100
    e.pieces.clear()
    e.chunks.clear()
    e.last[:] = False  # where ends of pieces aren't told, each piece is a text
    assert list(e.encode_all(texts, group=1000)) == want and e.merges.pieces > 1000


def test_damaged_frame_is_found():
    class Out(io.BytesIO):
        def close(self):
            pass

    out = Out()
    w = seekable_ids.FrameWriter(out)
    w.add(1, b"abcd" * 50)
    w.close()
    data = bytearray(out.getvalue())
    assert seekable_ids.FrameReader(io.BytesIO(bytes(data))).ids(0) == b"abcd" * 50
    data[12] ^= 255
    with pytest.raises(Exception):
        seekable_ids.FrameReader(io.BytesIO(bytes(data))).ids(0)


def test_packing(spark, docs, none, rows):
    got = certified_packing.pack_documents(docs, capacity=256, per_part=20).collect()
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 256
    want = collections.Counter()
    for r in rows:
        b = ids("byte_bpe_50k.json", r[1])
        for k, (s, n) in enumerate(certified_packing.cut(len(b) // 4, 256)):
            want[r[0], k, s, n, zlib.crc32(b[4 * s : 4 * (s + n)])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert certified_packing.pack_documents(none).count() == 0


def test_lower_bound_holds():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 101, 60)
        rooms = certified_packing.best_fit(sizes, 100)[2]
        assert -(-sizes.sum() // 100) <= certified_packing.lower_bound(sizes, 100) <= len(rooms)
    assert certified_packing.lower_bound(np.array([60, 60, 60]), 100) == 3


def test_token_counts(spark, docs, none, rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    want = collections.Counter((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 1024) for r in rows)
    assert collections.Counter(tuple(r) for r in bpe_count.count_tokens(docs).collect()) == want
    assert bpe_count.count_tokens(none).count() == 0


def test_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[5] = x[7] = x[9] = x[40]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (None, [1.0] * 16), (2060, [1.0] * 3)]
    got = collections.defaultdict(list)
    for r in adaptive_scan.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), per_group=64).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        best = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and all(abs(v - s[i]) < 1e-9 for _, i, v in found)
        hits += len(set(best) & {i for _, i, _ in found})
    assert hits / (45 * 20) > 0.9
    assert adaptive_scan.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_search_gives_every_query_all_its_rows(spark):
    """The bound comes from sampled rows in lists that a query may not scan; these rows are found all the same."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32))
    x[::3] = x[1] * 2  # a third are copies, the best of many queries
    got = collections.defaultdict(list)
    for r in adaptive_scan.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), recall=0.5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 2000, 20))
    for q, found in got.items():
        s = x @ x[q]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and len({i for _, i, _ in found}) == 20
        assert sorted((v for _, _, v in found), reverse=True) == pytest.approx(np.sort(np.delete(s, q))[::-1][:20])


def test_mixing(spark, docs, none, rows):
    got = entropy_mix.mix_documents(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((r[0], count(r[1])) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    order, total = sorted((s for s in sizes if s is not None)) + [None], sum(sizes.values())
    weight, free, target = dict(zip(order, (5, 2, 1))), set(order), {}
    while True:
        left, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.remove(s)
    taken = collections.Counter()
    for r in got:
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[round(r.target, 3)] += r.taken
    for s, t in target.items():
        assert abs(taken[round(t, 3)] - t) <= 0.02 * t + 100
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, entropy_mix.mix_documents(docs).collect()), key=str)
    assert entropy_mix.mix_documents(none).count() == 0


def test_outlier_distances_equal_a_plain_estimate(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mcd_rules.judge(docs, least=20).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    floors = np.array(list(mcd_rules.FLOORS.values()))
    x = np.array([[np.log1p(r.n_words), np.log1p(r.word_chars / max(1, r.n_words)), np.log1p(100 * r.n_symbols / max(1, r.word_chars)), np.log1p(r.n_dup_lines), r.n_repeat_words / max(1, r.n_words)] for r in got])
    fine = np.array([not r.base_failed for r in got])
    own = np.array([f"{r.lang}|{r.source}" for r in got])
    size = collections.Counter(own[fine])
    group = np.array([g if size[g] >= 20 else "" for g in own])
    rank = lambda v, p: np.sort(v, axis=0)[max(0, math.ceil(p * len(v)) - 1)]

    def estimate(rows):
        m = rows.mean(0)
        c = (rows - m).T @ (rows - m) / len(rows) + np.diag(floors**2)
        return m, np.linalg.inv(c), np.linalg.slogdet(c)[1] / 2

    worst = 0.0
    for g in set(group):
        rows = x[(group == g) & fine]
        if not len(rows):
            continue
        spread = np.maximum((rank(rows, 0.75) - rank(rows, 0.25)) / 1.349, floors)
        found = []
        for m, inverse in ((rank(rows, 0.5), np.diag(spread**-2)), estimate(rows)[:2]):
            volume = np.inf
            for _ in range(40):
                d2 = np.einsum("ij,jk,ik->i", rows - m, inverse, rows - m)
                m, inverse, now = estimate(rows[d2 <= rank(d2, 0.75) * (1 + 1e-12)])
                if now >= volume - 1e-6:
                    break
                volume = now
            found.append((now, m, inverse))
        _, m, inverse = min(found, key=lambda f: f[0])
        for k in np.flatnonzero(group == g):
            d2 = (x[k] - m) @ inverse @ (x[k] - m) / 1.413
            if got[k].distance is not None and got[k].kept != (fine[k] and d2 <= mcd_rules.quantile(1e-11)):
                assert abs(d2 / mcd_rules.quantile(1e-11) - 1) < 0.05
            if got[k].distance is not None and d2 < 1e3:
                worst = max(worst, abs(d2 - got[k].distance) / (1 + d2))
    assert worst < 0.05


def test_outliers_without_broadcast_are_the_same(spark, docs):
    a = sorted(map(str, mcd_rules.judge(docs, least=5).select("doc_id", "n_words", "kept").collect()))
    assert a == sorted(map(str, mcd_rules.judge(docs, least=5, most_models=0, salts=4).select("doc_id", "n_words", "kept").collect()))


def test_swapped_terms_score_alike_only_with_the_penalty():
    terms = ["deaf", "jewish", "muslim", "gay"]
    toxic = [f"those {t} people are {w}".encode() for t in ("deaf", "gay") for w in ("scum", "vermin", "filth") for _ in range(8)]
    clean = [f"the {t} people sing {w}".encode() for t in ("jewish", "muslim") for w in ("well", "songs", "loudly") for _ in range(8)]
    texts, y = toxic + clean, np.array([1.0] * len(toxic) + [0.0] * len(clean))
    change, neutral = {}, {}
    for penalty in (0.0, 5.0):
        w, bias = cf_toxicity.fit(texts, y, terms=terms, penalty=penalty)
        logit = lambda t: w[cf_toxicity.text_features(t)].sum() + bias  # noqa: E731, B023
        partner = {a.encode(): b.encode() for a, b in zip(terms, terms[1:] + terms[:1])}
        change[penalty] = np.mean([abs(logit(t) - logit(cf_toxicity.swapped(t, partner))) for t in texts])
        neutral[penalty] = max(logit(f"the {t} people sing songs".encode()) for t in ("deaf", "gay"))
        assert min(map(logit, toxic)) > max(map(logit, clean))
    assert change[5.0] < 0.5 * change[0.0] and neutral[5.0] < neutral[0.0]


def test_quality_without_labels(spark, docs, none):
    model = fm_quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not model.w.any() and fm_quality.score_texts(none, model).count() == 0
    assert all(0 <= r.score <= 1 for r in fm_quality.score_texts(docs, model).collect())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    import random

    rng = random.Random(5)
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", "　", "\x1f", "a", "the", "It's", "'LL", "é", "É", "ß", "İ", "Σ", "á", "²", "½", "42", ".", "!!", "$$$", "'", "漢字", "가", "😀", "‍", "\xad", "<|endoftext|>", "<|ENDOFTEXT|>", "_", "ŉ", "\x00", "\x7f", "١", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    want = [array("I", e.ids).tobytes() for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]
    encoder = encoding.Encoder(public_tokenizers.path(name), limit=500)
    assert list(encoder.encode_all([t.encode() for t in texts], group=4096)) == want
    assert list(encoder.encode_all([])) == []


def test_packing_certificates(spark):
    rng = np.random.default_rng(4)
    rows = [(k, 0, int(n)) for k, n in enumerate(rng.integers(1, 100, 600))]
    placed, report = certified_packing.pack(spark.createDataFrame(rows, "row long, piece int, length long"), capacity=100, per_part=150)
    got = placed.collect()
    assert len(got) == 600 and all(r.bound <= r.bins for r in got) and all(r.bound <= r.bins for r in report.collect())
    used, least = len({r.sequence_id for r in got}), certified_packing.lower_bound(np.array([n for *_, n in rows]), 100)
    assert least <= used <= 1.02 * least + 1


def test_queries_give_their_contracts_columns(spark, rows, tmp_path):
    """The opN_ queries on awkward rows: folds, predictions and columns."""
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 2), int(k % 5 == 0)) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for query, parts, held in ((queries.op2_factorisation_machine, 5, 0), (queries.op5_counterfactual_toxicity, 4, 2)):
        got = query(spark, folder).collect()
        assert len(got) == len(rows)
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % parts == held) and r.predicted == int(r.score >= 0.3) for r in got)
    assert {"doc_id", "class_id", "stays"} <= set(queries.op3_dart_minhash(spark, folder).columns)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(queries.op7_certified_packing(spark, folder).columns)
