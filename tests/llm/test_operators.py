"""The training-data operators against brute force, on small tables with nulls, repeats, empty and long texts."""

import collections
import collections.abc
import hashlib
import itertools
import os
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import common, cover_tree, decontaminate, importance, licences, minhash_dedup, mixing, suffix_dedup, token_counts, warc, wrapper
from tensorloom.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, n_bytes_ string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    base, shared = words(rng, 120), words(rng, 40)
    rows = [(None, shared), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one  TWO"), (6, base), (7, base), (7, base), (8, base + " tail"), (9, shared + " " + words(rng, 60)), (10, words(rng, 30) + " " + shared)]
    rows += [(11, words(rng, 20_000)), (12, "é" * 60), (13, "ab" * 300), (14, "x" + "ab" * 200), (15, "naïve " + base[5:300])]
    near = base.split()
    for i in range(20, 45):
        w = list(near)
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    return [(i, t, None if i == 9 else "en", (None, "a", "b")[(i or 0) % 3], None if t is None else len(t), 3, "x") for i, t in rows]


def test_suffix_dedup(spark, docs):
    got = collections.Counter()
    for r in suffix_dedup.dedup_substrings(spark.createDataFrame(docs, SCHEMA), carry=["bucket", "lang"]).collect():
        got[(r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept), r.bucket)] += 1
    big = 1 << 62
    texts = [(big if d[0] is None else d[0], (d[1] or "").encode()) for d in docs]
    first = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    want = collections.Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        spans = tuple(m.span() for m in re.finditer(b"\1+", bytes(gone)))
        want[(None if i == big else i, len(t), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g), 3)] += 1
    assert got == want
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup_substrings(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup_substrings(empty, min_len=200)


def test_single_window_buckets(monkeypatch):
    texts = [b"abracadabra", b"abrab", b"", b"cadab"]
    ix = suffix_dedup.RunLengthIndex(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    for p in (b"abra", b"a", b"ra", b"cad", b"zz", b"dab", b"abrab"):
        assert ix.search(p) == sum(len(re.findall(b"(?=%s)" % p, t)) for t in texts)
    assert ix.runs() < ix.rows


def test_hot_contexts(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 1)  # captured by the plan on the driver
    test_suffix_dedup(spark, docs)


def test_hot_windows_that_come_once_need_no_index(monkeypatch):
    """A line between different neighbours: windows of its own come from all texts, those over its ends from one each."""
    rng, indexed = random.Random(7), []
    line = "".join(rng.choice("abcdefgh") for _ in range(56))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(60)) + line + "".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(80)]
    least = suffix_dedup.least_owners
    monkeypatch.setattr(suffix_dedup, "least_owners", lambda buf, *a: indexed.append(len(buf)) or least(buf, *a))
    told = []
    for batch in range(2):  # of 40 texts each
        mine = {"batch": batch, "ids": [np.arange(40 * batch, 40 * batch + 40).tobytes()], "lens": [np.full(40, 176).tobytes()], "text": [suffix_dedup._z("".join(texts[40 * batch : 40 * batch + 40]).encode())]}
        told.append((mine, [r for b in suffix_dedup._anchor(1, 50, 24)([pa.RecordBatch.from_pylist([mine])]) for r in b.to_pylist()]))
    codes = [r for b in suffix_dedup._settle(1, False)((), iter([suffix_dedup._rows([r for _, rows in told for r in rows])])) for r in b.to_pylist()]
    sent = []
    for mine, _ in told:
        sent += suffix_dedup._send(1, 50)([pa.RecordBatch.from_pylist([mine | {"parts": [r for r in codes if r["batch"] == mine["batch"]]}])])
    found = [r for b in suffix_dedup._index(50)((), iter(sent)) for r in b.to_pylist()]
    assert 0 < sum(indexed) < 10_000  # bytes; most windows are of one text
    assert sum(struct.unpack_from("<i", r["payload"])[0] for r in found) >= 79 * 7  # each window of the line, in all texts but the first


def _least_owner_brute(texts, owner, n):
    of = {}
    for t, o in zip(texts, owner, strict=True):
        for j in range(len(t) - n + 1):
            of[t[j : j + n]] = min(of.get(t[j : j + n], 1 << 62), o)
    return [of[t[j : j + n]] if j + n <= len(t) else suffix_dedup.NULL_ID for t in texts for j in range(len(t))]


def test_least_owners():
    rng = random.Random(1)
    for n in (25, 26, 33, 50):
        for _ in range(6):
            base = "".join(rng.choice("ab") for _ in range(400)).encode()
            texts = [base[(x := rng.randrange(300)) : x + rng.randrange(120)] for _ in range(60)] + [b"", b"a" * 80, b"a" * 90]
            owner = [rng.randrange(40) for _ in texts]
            lens = np.array([len(t) for t in texts])
            got = suffix_dedup.least_owners(np.frombuffer(b"".join(texts), np.uint8), lens, np.array(owner), n)
            assert got.tolist() == _least_owner_brute(texts, owner, n)
    ix = suffix_dedup.RunLengthIndex(np.frombuffer(b"abcabcabc" * 20, np.uint8), np.full(20, 9))
    assert len(ix.first_place) < ix.rows / 3  # places are sampled
    assert suffix_dedup.least_owners(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), 50).tolist() == []


@pytest.mark.parametrize("verify", [False, True])
@pytest.mark.parametrize("hot", [1, 2048])
def test_suffix_dedup_random(spark, monkeypatch, hot, verify):
    """Passages that overlap, repeat within and across texts, batches and buckets."""
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rng = random.Random(hot)
    passages = ["".join(rng.choice("ab ") for _ in range(rng.randrange(40, 200))) for _ in range(12)]
    rows = []
    for i in range(150):
        t = "".join((p := rng.choice(passages))[(x := rng.randrange(len(p) // 2)) : x + rng.randrange(30, 160)] if rng.random() < 0.7 else words(rng, 6) for _ in range(rng.randrange(0, 7)))
        rows.append((i if i % 17 else None, t if i % 29 else None))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    big = 1 << 62
    texts = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for j in range(len(t) - 49):
            first[t[j : j + 50]] = min(first.get(t[j : j + 50], big), i)
    want = collections.Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        want[None if i == big else i, tuple(m.span() for m in re.finditer(b"\1+", bytes(gone)))] += 1
    got = collections.Counter((r.doc_id, tuple((s.start, s.stop) for s in r.spans)) for r in suffix_dedup.dedup_substrings(df, verify=verify).collect())
    assert got == want and sum(bool(s) for _, s in want) > 50


def test_suffix_dedup_needs_the_index(spark, docs, monkeypatch):
    """Without what the index says, windows are left; and with verify, all of them."""
    df = spark.createDataFrame(docs, SCHEMA)
    whole = sum(s.stop - s.start for r in suffix_dedup.dedup_substrings(df).collect() for s in r.spans)
    def nothing(min_len):
        def run(key: tuple[pa.Scalar, ...], batches: collections.abc.Iterator[pa.RecordBatch]) -> collections.abc.Iterator[pa.RecordBatch]:
            for _ in batches:
                pass
            yield from ()

        return run

    monkeypatch.setattr(suffix_dedup, "_index", nothing)
    assert sum(s.stop - s.start for r in suffix_dedup.dedup_substrings(df).collect() for s in r.spans) < whole
    assert not any(r.spans for r in suffix_dedup.dedup_substrings(df, verify=True).collect())


@pytest.mark.parametrize("verify", [False, True])
def test_suffix_dedup_rows_exchanged(spark, monkeypatch, verify):
    """A row for each batch and bucket at most, in few record batches: both grow with the input, so their costs by its square."""
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1 << 14)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1 << 12, raising=False)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 12)
    rng = random.Random(7)
    passages = [words(rng, 40) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(passages)[rng.randrange(60) :] if rng.random() < 0.6 else words(rng, 20) for _ in range(rng.randrange(6)))) for i in range(300)]
    rows += [(300, words(rng, 9000)), (301, None), (302, rows[7][1]), (None, rows[8][1]), (7, rows[9][1])]
    kept = {}

    def keep(df, tag):
        kept[tag] = common.materialize(df, tag)
        return kept[tag]

    monkeypatch.setattr(suffix_dedup, "materialize", keep)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    big = 1 << 62
    texts = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    of = {}
    for i, t in texts:
        for j in range(len(t) - 49):
            of[t[j : j + 50]] = min(of.get(t[j : j + 50], big), i)
    want = collections.Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if of[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        want[None if i == big else i, bytes(c for c, g in zip(t, gone, strict=True) if not g)] += 1
    assert collections.Counter((r.doc_id, bytes(r.kept)) for r in suffix_dedup.dedup_substrings(df, verify=verify).collect()) == want
    total = sum(len(t) for _, t in texts)
    batches, buckets = kept["packed"].count(), max(4, -(-total // (1 << 12)))
    assert batches > 5 and buckets > 30
    assert 100 < kept["found"].count() <= batches * buckets  # not one for each part of a bucket's index
    for tag in ("codes", "found"):
        assert kept[tag].groupBy("batch", "kind", "bucket").count().where("count > 1").count() == 0
    sent = [pa.RecordBatch.from_pylist([r.asDict() for r in kept["packed"].select("batch", "ids", "lens", "text").collect()])]
    got = list(suffix_dedup._anchor(buckets, 50, 24)(sent))
    assert sum(b.num_rows for b in got) > 100 and len(got) <= 1 + sum(b.num_rows for b in got) // 64


def test_dedup_stage(spark):
    passage = "äb" * 40
    rows = [(1, "x " + passage, 82, "a", 1), (2, passage + " y", 82, "b", 2), (3, None, 7, "c", 3), (4, "", 0, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string, kept int").withColumn("n_bytes", F.lit("z"))
    got = suffix_dedup.dedup_stage(spark, df, "")
    assert got.columns == df.columns
    assert {(r.doc_id, r.text, r.n_chars, r.spans, r.kept, r.n_bytes) for r in got.collect()} == {(1, "x " + passage, 82, "a", 1, "z"), (2, " y", 2, "b", 2, "z"), (3, None, 7, "c", 3, "z"), (4, "", 0, None, None, "z")}
    assert suffix_dedup.dedup_stage(spark, df.limit(0), "").count() == 0


def test_near_duplicates(spark, docs):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    ids = [d[0] for d in docs if d[0] is not None]
    sets = {d[0]: shingles(d[1]) for d in docs}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(set(ids)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            up[max(find(a), find(b))] = min(find(a), find(b))
    rows = minhash_dedup.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c = (words(rng, 60) for _ in range(3))
    almost = lambda t: t + " more"
    rows = [(1, a), (2, b), (None, almost(a)), (None, almost(b)), (5, a), (5, b), (5, c), (6, almost(c)), (None, "null alone is here now"), (None, "null alone is here now"), (None, None), (7, None), (7, None), (2, b)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, th string, node int, _id string")
    got = collections.Counter((r.doc_id, r.component_id, r.n_shingles > 0, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    want = [(1, 1, True, True), (2, 2, True, True), (2, 2, True, True), (None, 1, True, False), (None, 2, True, False), (5, 1, True, False), (5, 2, True, False), (5, 5, True, True), (6, 5, True, False)]
    want += [(None, None, True, True)] * 2 + [(None, None, False, True), (7, 7, False, True), (7, 7, False, True)]
    assert got == collections.Counter(want)
    out = minhash_dedup.near_dedup_stage(spark, df, "")
    assert out.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter([(1, a), (2, b), (5, c), (None, "null alone is here now"), (None, None), (7, None), (7, None)])
    assert minhash_dedup.near_dedup_stage(spark, df.limit(0), "").count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_mixing(spark, docs):
    df = spark.createDataFrame([d for d in docs if d[0] != 11], SCHEMA)
    got = mixing.mix(df).collect()
    size = collections.Counter()
    for d in docs:
        if d[0] != 11:
            size[d[3]] += len(re.findall(r"[^\x20\x09-\x0d]+", d[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(size.values())
    while open_:
        over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in over:
            target[s] = 2 * size[s]
        rest -= sum(2 * size[s] for s in over)
        open_ -= over
    of = {d[0]: d[3] for d in docs}
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[of[r.doc_id]]) and r.taken <= 2 * r.size
        taken[of[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 130
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decontamination(spark):
    rng = random.Random(1)
    items = [(i, words(rng, 30, 5000)) for i in range(12)] + [(50, None), (51, ""), (52, "tiny item")]
    edited = list(items[3][1])
    for p in range(5, len(edited), 15):
        edited[p] = "q"
    rows = [(1, words(rng, 200) + "\n " + items[0][1].upper().replace(" ", "  ") + " " + words(rng, 50)), (2, words(rng, 300)), (3, None), (4, ""), (5, words(rng, 9) + " " + "".join(edited)), (6, "see the Tiny  ITEM here"), (6, "clean"), (None, items[1][1])]
    got = [(r.doc_id, sorted(x.item_id for x in r.leaks)) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, [0]), (2, []), (3, []), (4, []), (5, [3]), (6, [52]), (6, []), (None, [1])]))
    assert decontaminate.edit_distance_within(b"kitten", b"xx sitting xx", 3)[0] == 2


def test_decontamination_spread_edits(spark):
    rng = random.Random(9)
    items = [(i, words(rng, n, 5000)) for i, n in enumerate((4, 8, 15, 30, 60))]
    rows = []
    for i, t in items:
        edited = list(t)
        for p in range(11, len(t), 12):  # 8.3 per cent: runs of 11 bytes are left
            edited[p] = "q"
        rows.append((i, words(rng, 50) + " " + "".join(edited) + " " + words(rng, 50)))
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: [i] for i, _ in items}
    # every item within the edits is found, whatever the edits
    block = decontaminate.Items([(i, t.encode()) for i, t in items])
    for k, t in enumerate(block.texts):
        for _ in range(60):
            e = list(t)
            for _ in range(int(len(t) * decontaminate.MAX_EDITS)):
                p = rng.randrange(len(e))
                e[p : p + rng.randrange(2)] = rng.choice(([], [ord("q")], [ord("z")]))
            text = b"some text before " + bytes(e) + b" and after"
            if decontaminate.edit_distance_within(t, text, int(len(t) * decontaminate.MAX_EDITS)):
                assert k in [x[1] for x in block.leaks(pa.array([text.decode()]))]


def test_mixing_probabilities(spark):
    """Over many seeds, documents are in the sample as often as their class says, and more often the longer they are."""
    rows = [(i, " ".join(["w"] * (3 if i % 2 else 40)), "ab"[i % 3 == 0]) for i in range(240)] + [(900, None, None), (901, "", None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, w string")
    size = df.select("source", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n")).withColumn("size", F.when(F.col("n") > 1, F.col("n")).otherwise(0).cast("long"))
    classes = size.groupBy("source", mixing.bits(F.col("size")).alias("w")).agg(F.sum("size").alias("words"))
    told = {(r.source, r.w): r.whole + r.p for r in mixing.copies(classes, mixing.targets(classes.withColumnRenamed("words", "size"))).collect()}
    assert told["a", 2] < told["a", 6] <= 2 and all(0 <= c <= 2 for c in told.values())
    taken = collections.Counter()
    for seed in range(12):
        for r in mixing.mix(df, seed=seed).collect():
            if r.size:
                taken["ab"[r.doc_id % 3 == 0], r.size.bit_length()] += r.taken / r.size
    for (s, w), n in taken.items():
        docs = sum(("ab"[i % 3 == 0], (3 if i % 2 else 40).bit_length()) == (s, w) for i in range(240))
        assert n / docs / 12 == pytest.approx(told[s, w], abs=0.12)


def test_mixing_many_sources(spark, monkeypatch):
    rows = [(i, "one two three " * (i % 7), f"s{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CLASSES", 0)
    assert sorted(map(str, mixing.mix(df).collect())) == want


def _edited(rng, t, rate, how):
    """t with so many edits of its length: at random, evenly spaced of all kinds, or evenly spaced substitutions."""
    e, n = list(t), int(len(t) * rate)
    if how == "substituted":
        for p in range(rng.randrange(len(t) // n), len(t), -(-len(t) // n)):
            e[p] = "q"
        return "".join(e)
    for p in sorted((int((k + 0.5) * len(t) / n) for k in range(n)) if how == "even" else rng.sample(range(len(t)), n), reverse=True):
        kind = rng.randrange(3)
        e[p : p + (kind < 2)] = [] if kind == 1 else [rng.choice("etaoinshr")]
    return "".join(e)


@pytest.mark.parametrize("rate", [0.06, 0.08, 0.09, 0.099])
@pytest.mark.parametrize("how", ["random", "even", "substituted"])
def test_decontamination_recall(rate, how):
    """The index finds nine of ten windows within the edits and more, held against the distance itself."""
    rng = random.Random(3)
    items = [" ".join(rng.choice(("the", "tion", "on", "ered", "thand", "inge", "st", "reou", "wh")) + rng.choice(("", "er", "ly", "n")) for _ in range(rng.randrange(18, 70))) for _ in range(60)]
    block = decontaminate.Items([(i, t.encode()) for i, t in enumerate(items)])
    assert len(block.texts) == 60 and min(block.sizes) >= decontaminate.SHORT
    texts, want = [], []
    for i, t in enumerate(items):
        x = f"some thand before {_edited(rng, t, rate, how)} and after reou"
        if decontaminate.edit_distance_within(t.encode(), x.encode(), int(len(t) * decontaminate.MAX_EDITS)):
            texts.append(x)
            want.append(i)
    found = {(d, i) for d, i, *_ in block.leaks(pa.array(texts))}
    assert len(want) >= 40 and sum((d, i) in found for d, i in enumerate(want)) >= 0.95 * len(want)
    # one window a text or many texts at once, the same leaks
    assert {(d, i) for d, t in enumerate(texts) for _, i, *_ in block.leaks(pa.array([t]))} == found


def test_decontamination_needs_the_index(monkeypatch):
    text = " ".join(f"word{i * i}" for i in range(30))
    assert [x[1] for x in decontaminate.Items([(7, text.encode())]).leaks(pa.array([f"before {text} after"]))] == [7]
    monkeypatch.setattr(decontaminate, "embed", lambda buf, start, walk: np.random.default_rng(len(start)).integers(0, 256, (decontaminate.STEPS, len(start)), np.uint8))
    assert not list(decontaminate.Items([(7, text.encode())]).leaks(pa.array([f"before {text} after"])))


def test_decontamination_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    syllables = ("the", "tion", "on", "ered", "thand", "inge", "st", "reou", "wh")
    prose = lambda n: " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(n))
    items = [(i, prose(rng.randrange(1, 40))) for i in range(25)] + [(9, prose(30)), (None, prose(30)), (40, None), (41, " ")]
    rows = [(i, prose(rng.randrange(0, 60)) + " " + _edited(rng, t, 0.05, "random") + "\n" + prose(20), "x") for i, t in enumerate(t for _, t in items if t and len(t) > 40)]
    rows += [(None, items[3][1], "y"), (3, items[3][1], None), (3, items[3][1], None), (5, None, "x"), (6, "", "x"), (7, prose(20_000) + items[5][1].upper(), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def clean(t):
        return " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split())

    def brute(text):
        short = [(i, clean(t)) for i, t in items if clean(t)]
        return sorted({str(i) for i, t in short if decontaminate.edit_distance_within(t.encode(), clean(text).encode(), int(len(t.encode()) * decontaminate.MAX_EDITS))})

    want = sorted((str(i), tuple(brute(t))) for i, t, _ in rows)
    for size in (1 << 20, 500):  # one block of items, and several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.find_leaks(docs, bench).collect()
        assert sorted((str(r.doc_id), tuple(sorted({str(x.item_id) for x in r.leaks}))) for r in got) == want
        kept = decontaminate.decontaminate_stage  # its own table of items
        monkeypatch.setattr(decontaminate, "table", lambda *_: bench)
        assert sorted(map(str, kept(spark, docs, "").collect())) == sorted(map(str, (r for r in docs.collect() if not brute(r.text))))
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert all(not r.leaks for r in decontaminate.find_leaks(docs, bench.limit(0)).collect())


def test_token_counts(spark):
    vocab = [b"a", b"b", b"ab", b"abc", b"c", b"bcd", b"d"]
    pieces = {tuple(v) for v in vocab} | {(*v, 256) for v in vocab} | {(*b"abcd", *b"x")}
    a = token_counts.Automaton(list(pieces))

    def brute(w):
        s, i, n = (*w, 256), 0, 0
        while i < len(s):
            k = next((k for k in range(len(s) - i, 0, -1) if s[i : i + k] in pieces), 0)
            if not k:
                return 1
            i, n = i + k, n + 1
        return n

    rng = random.Random(2)
    ws = [bytes(rng.choice(b"abcdx") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    ends = np.cumsum([len(w) for w in ws])
    got = a.counts(np.frombuffer(b"".join(ws), np.uint8), ends - [len(w) for w in ws], ends)
    assert got.tolist() == [brute(w) for w in ws]


def test_cover_tree():
    rng = np.random.default_rng(3)
    for n, d in ((1, 3), (40, 2), (900, 8)):
        x = rng.integers(-50, 50, (n, d))
        x[: n // 2] = x[0]  # ties
        ids = np.arange(n)
        got = cover_tree.dual_top_k(x[::7], ids[::7], x, ids, 10)
        for q, (i, s) in zip(ids[::7], got, strict=True):
            want = sorted((-int(x[q] @ x[j]), int(j)) for j in ids if j != q)[:10]
            assert list(zip((-s).tolist(), i.tolist(), strict=True)) == want


def test_cover_tree_repeated_ids():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5)) * 4
    for spread in (0, 0.05, 1):  # tight clusters prune pairs of inner nodes
        x = np.floor(1024 * (centres[rng.integers(0, 6, 700)] + spread * rng.normal(size=(700, 5)))).astype(np.int64)
        ids = rng.integers(0, 400, 700)
        got = cover_tree.dual_top_k(x[:90], ids[:90], x, ids, 10)
        for q, own, (i, s) in zip(x[:90], ids[:90], got, strict=True):
            want = sorted((-int(q @ v), int(j)) for v, j in zip(x, ids, strict=True) if j != own)[:10]
            assert list(zip((-s).tolist(), i.tolist(), strict=True)) == want


def test_match_by_path():
    a, b = (wrapper.label(wrapper.parse(h)) for h in ("<div><p>x<p>y</div><ul><li>z</ul>", "<div><p>x<p>w<p>v</div><ol><li>z</ol>"))
    assert [(x.text, y.text) for x, y in wrapper.match_by_path(a, b) if x.text] == [("x", "x"), ("y", "w")]


def test_search_edges(spark):
    rows = [(0, [1.0, 0.5]), (100, [0.1]), (1, [float("nan"), 1.0]), (2, None), (3, [1.0, None]), (4, [2.0, 2.0]), (4, [2.0, 2.0]), (None, [1.0, 1.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in cover_tree.top_k(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 4), (0, 2, 4), (0, 3, 100), (100, 1, 4), (100, 2, 4), (100, 3, 0)]
    assert cover_tree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_search_repeated_queries(spark):
    """Query rows of one id each have a list; huge and clashing columns; the query's own brute force."""
    rng = random.Random(7)
    rows = [(i % 230, [rng.uniform(-2, 2) for _ in range(6)], "x", i) for i in range(300)] + [(1000, [1e30] * 6, "x", 1), (200, [0.5], "x", 2), (300, [float("inf")] * 6, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, id int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in cover_tree.top_k(df, df.where("vec_id % 100 = 0")).collect()]
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, *_ in rows if max(map(abs, v)) < 1e9]
    want = []
    for q, v in ints:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != q)[:10]
            want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert collections.Counter(got) == collections.Counter(want) and len(got) == 50


def test_wrapper(spark):
    page = '<html><head><title>T</title><script>x="</p>"</script></head><body><header>H</header><nav><ul><li>m</ul></nav><div class="cookie-notice">c</div><div class="main"><h1>Head {0} &amp;amp; more</h1><p>One{0}<br>two <b>bold</b> &eacute;<p>Three{0}.<ul><li>a<li>b</ul></div><div id="sidebar">s</div><section class="comments"><p>nice</p></section><form>q</form><footer>f</footer>'
    rows = [(i, "http://h.example/x", page.replace("{0}", str(i))) for i in range(9)] + [(20, "http://one.example/", "<p>alone<p>two"), (21, None, None), (22, "x", ""), (20, "http://one.example/", "<p>alone<p>two")]
    got = collections.Counter((r.page_id, r.text) for r in wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = collections.Counter((i, f"Head {i} &amp; more\nOne{i} two bold é\nThree{i}.\na\nb") for i in range(9))
    assert {k: v for k, v in got.items() if k[0] >= 20} == {(20, "alone\ntwo"): 2, (21, ""): 1, (22, ""): 1}
    # what every page of a host repeats word for word is template
    assert {k for k in got if k[0] < 9} <= set(want) | {(i, f"Head {i} &amp; more\nOne{i} two bold é\nThree{i}.") for i in range(9)}


def test_wrapper_constants_of_one_path(spark):
    page = '<html><body><div class="main"><h1>Head {0}</h1><p>Body of page number {0}.<p>Share this story<p>Subscribe now<p>More on page {0}.</div>'
    rows = [(i, "http://h.example/x", page.replace("{0}", str(i))) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert {(r.page_id, r.text) for r in wrapper.extract_text(df).collect()} == {(i, f"Head {i}\nBody of page number {i}.\nMore on page {i}.") for i in range(12)}


def test_wrapper_references(spark):
    page = '<html><body><div class="main"><p class="teaser">Share this story<h1>Head {0}</h1><p>Body of page number {0}.</div>'
    rows = [(i, "http://h.example/x", page.replace("{0}", str(i))) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {(i, f"Head {i}\nBody of page number {i}.") for i in range(40)}
    for n in (1, 40):  # pages of a host in one task, and each in its own
        assert {(r.page_id, r.text) for r in wrapper.extract_text(df.repartition(n)).collect()} == want


def test_tree_matching():
    def brute(x, y):
        if x.name != y.name:
            return 0
        p, q = wrapper._kids(x), wrapper._kids(y)
        w = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, j in itertools.product(range(len(p)), range(len(q))):
            w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + brute(p[i], q[j]))
        return w[-1][-1] + 1

    def tree(rng, depth):
        return "".join(f"<{t}>{rng.choice('xyz')}{tree(rng, depth - 1) if depth else ''}</{t}>" for t in rng.choices(("div", "section", "ul"), k=rng.randrange(1, 5)))

    rng = random.Random(8)
    for i in range(40):
        a, b = wrapper.parse(tree(rng, 2 + i % 2)), wrapper.parse(tree(rng, 2 + i % 2))
        wrapper.label(a), wrapper.label(b)
        got = wrapper.match(a, b)
        assert len(got) == brute(a, b) == len({id(x) for x, _ in got}) == len({id(y) for _, y in got})
        assert all(x.name == y.name and (x is a or (id(x.parent), id(y.parent)) in {(id(p), id(q)) for p, q in got}) for x, y in got)


def test_wrapper_large_pages(spark):
    # an additional item in an earlier section, on pages of some 400 nodes
    page = '<html><body><div class="main">{1}<section><p>Share this story<h1>Head {0}</h1><p>Body of page number {0}.<p>Subscribe now</section></div>'
    item = "<section><p>Item {0} of page {1}</section>"
    rows = [(i, "http://h.example/x", page.replace("{1}", "".join(item.format(k, i) for k in range(190 + i % 7))).replace("{0}", str(i))) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in wrapper.extract_text(df).collect()}
    assert got == {i: [*(f"Item {k} of page {i}" for k in range(190 + i % 7)), f"Head {i}", f"Body of page number {i}."] for i in range(30)}
    big = [wrapper.parse("<ul>" + "".join(f"<li>{k * m}<div><p>a</div>" if k % 3 else f"<li>{k}" for k in range(3000)) + "<li>end</ul>") for m in (1, 2)]
    [wrapper.label(x) for x in big]
    assert len(wrapper.match(*big)) == len(list(wrapper._walk(big[0])))


def test_wrapper_declared(spark):
    def text(html):
        return wrapper.blocks_of(wrapper.parse(html), "", set())

    for name in ("content has-sidebar", "no-sidebar", "page-with-comments", "content sidebar", "widget"):
        assert text(f'<body><div class="{name}"><div><article><h1>Head</h1><p>Text</article></div><div class="sidebar">s</div></div>') == ["Head", "Text"]
    assert text("<body><form><main><p>Text</main><button>b</button></form>") == ["Text"]
    assert text('<body><p>Text<div class="comments"><article>c</article></div><aside>s</aside>') == ["Text"]
    assert text('<body><article><p>Text</article><aside class="related"><article>r</article></aside>') == ["Text"]
    for name in ("entry-header", "post-header", "header", "articleHeader"):
        assert text(f'<body><article><div class="{name}"><h1>Head</h1></div><p>Text</article>') == ["Head", "Text"]
    assert text('<body><div class="entry-header"><h1>Head</h1></div><p>Text') == ["Head", "Text"]
    for name in ("cookie-notice", "site-header", "left-sidebar", "nav_main", "mainNav", "share", "comments-area"):
        assert text(f'<body><div class="{name}">n</div><p>Text') == ["Text"]
    # the region of what varies overrules a name
    page = '<html><body><div id="page-widget"><div class="x"><p>Body of page number {0}.<p>More on {0}</div></div><div class="widget">w</div><p>Same</p>'
    rows = [(i, "http://h.example/x", page.replace("{0}", str(i))) for i in range(12)]
    got = wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(i, f"Body of page number {i}.\nMore on {i}") for i in range(12)}


def test_wrapper_loses_nothing():
    def text(html):
        return wrapper.blocks_of(wrapper.parse(html), "", set())

    assert text("<p title=don't>hello</p><p>more text</p>") == ["hello", "more text"]
    assert text('<p class=x">hello</p><p>more</p>') == ["hello", "more"]
    assert text("<p>one<p title='never closed>two<p>three</p>") == ["one", "two", "three"]
    assert text("<p data-x=\"a>b\" data-y = 'c>d'>t</p><a href=x/y?a='b'>z</a>") == ["t", "z"]
    assert text("<p/ a b=c / =d e==f>t") == ["t"]
    assert text("<p>one</p><article class=teaser><p>teaser</article>") == ["one", "teaser"]
    assert text("<p>before <span class='share'>the share price</span> after</p>") == ["before the share price after"]
    assert text("<p>hello <span class=ad>buy</span> x<div class=share>Share") == ["hello x"]
    assert text("<body><p>a<article><p>b</article><p>c") == ["a", "b", "c"]
    assert text("<p>1 &lt 2 &amp;amp; &#x41; &nbsp;x&eacute;</p>") == ["1 < 2 &amp; A xé"]
    assert text("<p " + "a='" * 20_000) == [] and text("<" * 100_000) == ["<" * 100_000]
    deep = 30_000
    assert text("<div>" * deep + "x" + "</div>" * deep) == ["x"]


def _site(rng, pages):
    """Pages of one template with known articles, the template's parts named by nothing."""
    said = lambda n: " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega")) + str(rng.randrange(999)) for _ in range(n))
    top, end, before = said(6), [said(4) for _ in range(3)], said(3)
    rows = []
    for i in range(pages):
        blocks = [said(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 9))]
        body = "".join(f"<div>{b}</div>" for b in blocks)
        rows.append((i, "http://site.example/a", f"<html><body><div class=top>{top}</div><div class=one><div class=before>{before}</div>{body}</div><div class=end>{''.join(f'<p>{e}</p>' for e in end)}</div></body></html>", "\n".join(blocks)))
    return rows


def test_wrapper_induction_decides(spark, monkeypatch):
    """What no name declares goes by induction alone; without it the template stays."""
    rows = _site(random.Random(3), 30)
    df = spark.createDataFrame([r[:3] for r in rows] + [(90, "http://site.example/a", None)], "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("_host", F.lit(1))
    want = {(i, t) for i, _, _, t in rows} | {(90, "")}
    assert {(r.page_id, r.text) for r in wrapper.extract_text(df).collect()} == want
    plain = {i: "\n".join(wrapper.blocks_of(wrapper.parse(h), "", set())) for i, _, h, _ in rows}
    assert all(plain[i] != t for i, _, _, t in rows)
    monkeypatch.setattr(wrapper, "BROADCAST_HOSTS", 0)  # hosts joined, not broadcast
    monkeypatch.setattr(wrapper, "BROADCAST_CHARS", 0)
    assert {(r.page_id, r.text) for r in wrapper.extract_text(df).collect()} == want
    assert wrapper.extract_text(df.limit(0)).count() == 0


def test_wrapper_equal_pages(spark):
    rows = [(i, "http://same.example/", "<body><div><p>All pages<p>say this</div>") for i in range(6)]
    got = wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["All pages\nsay this"] * 6
    # constants alone on a host of different pages
    rows += [(i + 10, "http://same.example/", f"<body><div><p>All pages<p>say this</div><p>and number {i}") for i in range(8)]
    got = wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text for r in got)


def test_warc(spark):
    rows = [(1, "u", "x" * 2000), (5, "u\r\nv", "x" * 2000), (3, None, "x" * 2000), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (None, "u", "y" * 1500), (None, "u", "x" * 2000), (8, "u", "é" * 40_000)]
    bundles = warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_bundles(bundles).collect()}
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        to = 5 if b == b"x" * 2000 and i != 5 else None
        want.add((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to else "response", to))
    assert got == want
    assert warc.fetch(bundles, [bundles.first()["records"][0]["record_id"]]).count() >= 1
    data, index = warc.bundle_of([(str(i), bytes([i]) * 30_000) for i in range(9)])
    frames = warc.seek_table(data)
    assert len(frames) == 5 and warc.read_frame(data, frames[index[8]["frame"]])[index[8]["offset"] :][: index[8]["length"]] == b"\x08" * 30_000
    assert struct.unpack_from("<I", data, len(data) - 4)[0] == warc.SEEKABLE


def test_classifier(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        w = words(rng, 60, 300).split()
        if kind == 1:
            w[rng.randrange(60)] = rng.choice(("vile", "awful"))
        rows.append((i, " ".join(w) if kind < 2 else " ".join(x.upper() + "!!" for x in w)))
        if i < 400:
            labels.append((i, int(kind < 2), int(kind == 1)))
    rows += [(None, "w1x"), (900, None), (901, "")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    r = importance.Resampler(df, lab)
    kept = {x.doc_id for x in r.result().where("kept").collect()}
    held = range(400, 600)  # never labelled
    assert sum((i in kept) == (i % 3 == 0) for i in held) >= 190
    assert {x.doc_id for x in r.keep(df).collect()} == kept
    assert importance.Resampler(df, lab.limit(0)).result().where("not kept").count() == 0
    assert importance.Resampler(df.limit(0), lab).result().count() == 0


def test_classifier_brute_force(spark):
    """Weights from plain dictionaries of n-grams; the k largest keys; noise without which others would be kept."""
    rng = random.Random(16)
    texts = [" ".join(rng.choice(("Alpha", "beta", "gamma", "delta", "epsilon", "awful")[: 5 + (i % 4 == 0)]) for _ in range(rng.randrange(0, 12))) for i in range(300)]
    texts += [None, "", " \n", "beta beta", "x" * 5000 + " beta", texts[5], texts[5]]
    rows = [(i if i < 306 else 305, t, "z") for i, t in enumerate(texts)] + [(None, "awful awful", "z"), (None, "gamma", None)]
    labels = [(i, int("awful" not in (texts[i] or "")), int(i % 8 == 0)) for i in range(0, 300, 2)] + [(None, 1, 0), (4, None, None)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, log_weight string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    r = importance.Resampler(df, lab, k=100)
    fit = {x._id for x in lab.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").where(F.pmod(F.xxhash64("_id", F.lit(importance.SEED)), F.lit(3)) < 2).collect()}

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        out = []
        for i, x in enumerate(w):
            y, low, tail = (w[i - 1] if i else None), x.lower(), x[-2:]
            last = y and y.lower()
            out.append([("w", low), ("5", low[:5]), ("4", low[:4]), ("t", tail), ("b", last, low), ("bt", y and y[-2:], tail), ("again", last == low)])
        return out

    raw, target = collections.Counter(), collections.Counter()
    for i, t, _ in rows:
        for g in grams(t):
            raw.update(g)
            if i in fit:
                target.update(g)
    share = sum(n for g, n in target.items() if g[0] == "w") / sum(n for g, n in raw.items() if g[0] == "w")

    def weight(t):
        w = [sum(np.log((target[x] + importance.PRIOR) / (raw[x] * share + importance.PRIOR)) for x in g) for g in grams(t)]
        p = importance.PASSAGE
        return min((sum(w[i : i + p]) for i in range(max(1, len(w) - p + 1))), default=0)

    got = r.result().collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t, _ in rows if i is not None and i != 305}
    for x in got:
        if x.doc_id in by_id:
            assert x.log_weight == pytest.approx(weight(by_id[x.doc_id]), abs=1e-4)
    keys = sorted((x.gumbel_key for x in got), reverse=True)
    assert all(x.kept == (x.gumbel_key >= keys[99]) for x in got) and 100 <= sum(x.kept for x in got) <= 102
    plain = sorted((x.log_weight for x in got), reverse=True)[99]
    assert any(x.kept != (x.log_weight > plain) for x in got if x.log_weight != plain)
    noise = np.array([x.gumbel_key - x.log_weight for x in got])
    assert abs(noise.mean() - 0.577) < 0.3 and abs(noise.std() - 1.28) < 0.3
    kept = importance.Resampler(df, lab).keep(df)
    assert kept.columns == df.columns and importance.Resampler(df.limit(0), lab).keep(df.limit(0)).count() == 0


def test_licences(spark):
    mit = "Copyright 2020 Someone\n" + licences.MIT.replace("sublicense", "SUBLICENCE")
    rows = [(1, mit), (2, "Text.\nReleased under the MIT license\nmore"), (3, None), (4, ""), (5, "nothing"), (1, mit)]
    got = collections.Counter((r.doc_id, r.licence, tuple(r.line_licences)) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(1, "MIT", ()), (1, "MIT", ()), (2, None, ("MIT",)), (3, None, ()), (4, None, ()), (5, None, ())])


def test_licences_whole_texts(spark):
    folder = "/usr/share/common-licenses"
    want = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    have = [n for n in want if os.path.exists(f"{folder}/{n}")]
    if not have:
        pytest.skip("no licence texts here")
    texts = {n: open(f"{folder}/{n}").read() for n in have}
    rows = [(n, t) for n, t in texts.items()] + [(n, " ".join(t.split("END OF TERMS AND CONDITIONS")[0].upper().split(" ")) + "\n\n") for n, t in texts.items()] + [("cut", texts[have[0]][:-300])]
    got = collections.Counter((r.doc_id, r.licence) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == {**{(n, want[n]): 2 for n in have}, ("cut", None): 1}


def test_pipeline_stages(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[0].startswith("quality") and names[-1].startswith("mixing")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d)
    assert 0 < out.count() <= docs.count()


def test_licence_edges(spark):
    """Nulls, empty and very long texts, ties and repeated rows, clashing columns; brute force in Python."""
    rng = random.Random(2)
    notices = ["Released under the MIT licence.", "licensed under CC BY 4.0", "(c) 2020 someone", "Copyright: me", "plain words", "", " \t", "Released under CC0 1.0\r"]
    rows = [(i, "\n".join(rng.choices(notices, k=rng.randrange(0, 6))), "x") for i in range(60)] + [(None, notices[0], "x"), (None, notices[0], "x"), (None, None, "x"), (3, "word " * 200_000 + "\n" + notices[1], "x"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumn("name", F.lit(1)).withColumn("th", F.lit(2))
    known = licences.known_digests()

    def look(t):
        return known.get(hashlib.md5(licences.canonical(t).encode()).hexdigest())

    want = collections.Counter((i, look(t or ""), tuple(sorted({look(x) for x in (t or "").split("\n")} - {None}))) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.licence, tuple(r.line_licences)) for r in licences.scan_licences(df).collect()) == want
    assert licences.scan_licences(df.limit(0)).count() == 0
    plan = licences.scan_licences(df)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def _vocabulary(path, pieces):
    import json

    path.write_text(json.dumps({"model": {"vocab": {p: i for i, p in enumerate(pieces)}}}))
    return str(path)


def test_token_counts_table(spark, tmp_path):
    """Whole tables against greedy matching: nulls, blanks, very long words and texts, repeats, other columns."""
    pieces = ["a", "b", "ab", "abb", "b</w>", "a</w>", "ab</w>", "c"]
    path = _vocabulary(tmp_path / "v.json", pieces)
    own = set(token_counts.pieces_of(path))

    def brute(text):
        total = 0
        for w in re.findall(r"[^\x20\x09-\x0d]+", text or ""):
            s, i, n = (*w.lower().encode(), token_counts.END), 0, 0
            while i < len(s):
                k = next((k for k in range(min(5, len(s) - i), 0, -1) if s[i : i + k] in own), 0)
                if not k:
                    n = 1
                    break
                i, n = i + k, n + 1
            total += n
        return len(re.findall(r"[^\x20\x09-\x0d]+", text or "")), total

    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abAB") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 20))), "x") for i in range(60)]
    rows += [(None, "ab", "y"), (1, None, "y"), (1, None, "y"), (2, " \t\n", None), (3, "ab" * 3000 + " c é", "x"), (4, "ab " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("n_words", F.lit(0))
    got = collections.Counter((r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(df, path).collect())
    assert got == collections.Counter((i, *brute(t)) for i, t, _ in rows)
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def test_mix_edges(spark):
    """Sources whose texts are all empty, null ids and texts, ties and repeated rows, other columns, an empty table."""
    rows = [(i % 5 if i % 7 else None, "one two" if i % 3 else None, ("s", "t", None)[i % 3]) for i in range(60)] + [(99, "word " * 30_000, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("id", F.lit(2))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    of = collections.Counter()
    for r in got:
        of[r.target] += r.taken
    assert all(r.target == 0 for r in got if r.source_size == 0) and sum(1 for r in got if r.source_size == 0) == 20
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix_stage(spark, df, "").columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_warc_edges(spark):
    rows = [(1, "u", "é" * 600_000, "a"), (2, None, None, None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").withColumn("digest", F.lit(1))
    back = warc.read_bundles(warc.write_bundles(df))
    assert collections.Counter((r.page_id, r.payload_bytes, r.record_type) for r in back.collect()) == collections.Counter([(1, 1_200_000, "response"), (2, 0, "response"), (2, 0, "response")])
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


def test_pipeline_against_its_stages(spark):
    """Each stage on what the one before kept, held to what its operator says; other columns, nulls and repeated rows live on."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("n_bytes", F.lit(1)).withColumn("kept", F.lit("k")).withColumn("spans", F.lit(2.0)).withColumn("leaks", F.lit(3))
    extra = docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    now = spark.createDataFrame(docs.unionByName(extra).collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, now, d).collect(), docs.schema)
        before, left = [tuple(r) for r in now.collect()], [tuple(r) for r in after.collect()]
        at = docs.columns.index("text"), docs.columns.index("n_chars")
        ident = lambda r: tuple(v for i, v in enumerate(r) if i not in at)
        assert not collections.Counter(map(ident, left)) - collections.Counter(map(ident, before)), name
        if name == "quality classifier":
            keys = {(r.doc_id, round(r.gumbel_key, 6)) for r in importance.Resampler(now, spark.read.parquet(f"{d}/labels.parquet")).result().where("kept").collect()}
            assert len(left) >= len(keys) and {r[0] for r in left} == {k for k, _ in keys}
        elif name == "MinHash near-dedup":
            kept = {r.doc_id for r in minhash_dedup.near_duplicates(now).where("kept").collect()}
            assert {r[0] for r in left} == kept
        elif name == "suffix-array dedup":
            spans = {(r.doc_id, r.n_bytes): sum(s.stop - s.start for s in r.spans) for r in suffix_dedup.dedup_substrings(now).collect()}
            assert sum(len((r[at[0]] or "").encode()) for r in left) <= sum(n for _, n in spans) - sum(spans.values()) and len(left) == len(before)
        else:
            leaks = {r.doc_id for r in decontaminate.find_leaks(now, spark.read.parquet(f"{d}/benchmark.parquet")).where("size(leaks) > 0").collect()}
            assert not {r[0] for r in left} & (leaks - {None})
        now = after
    out = corpus_pipeline.STAGES[-1][1](spark, now, d)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(now).collect()))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0
