"""Benchmark decontamination by CGK embedding.

`find_leaks` looks in every whole text for windows within MAX_EDITS of an item's length of a benchmark item, in edit
distance, after lower-casing A-Z and turning white space into one space.

1. Index: an item is embedded from each of its places.  Texts have a window every STRIDE bytes, from their first byte, so
   STEPS / 2 bytes of a leaked item hold several windows whose place in the item is in the index.
2. CGK: window and item take the same random walk (each symbol is written, and a random bit of step and symbol says
   whether to move on), which turns a small edit distance into a small Hamming distance.  LSH by bit sampling: for each
   of WALKS walks, TABLES tables of SAMPLED random steps; a window that agrees with a place of an item on all steps of
   some table sets an item-sized window there.  A window an item's length away from the last edits has another chance
   every STRIDE bytes, which is what the recall comes from.  Found of windows at 10 per cent of edits (tests hold the
   rates): 99 per cent and more of random and of evenly spaced ones.
3. Windows that lack too many of the item's 4-byte strings go (an edit breaks four at most: none within the edits goes);
   the others are verified by the exact edit distance between the item and any part of the window with some slack.

Items under SHORT bytes have too few windows for that and are found without loss: an item that may have k edits is cut
into k + 1 pieces, of which one is left whole, and texts are searched for the pieces.

Items go to the tasks in blocks of at most BLOCK_BYTES; of more than one block each goes over all rows in turn, so what is
broadcast has a bound whatever their number.  A text's leaks don't depend on how texts are dealt.
Null or empty texts and items match nothing; null ids are handed through; repeated rows each give their own rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Rolling, materialize, new_name, slices, table, text_bytes

MAX_EDITS = 0.10
STRIDE, STEPS = 8, 40
WALKS, TABLES, SAMPLED = 2, 4, 12
SHORT = 80
BLOCK_BYTES = 1 << 20
BITS = 22
#: The count filter: grams of so many bytes, in a table of so many bits of place.
GRAM, GRAM_BITS = 4, 24
SLICE = 1 << 19


def normalise(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, white space as one space, none at the start of a text; places of the bytes kept; new offsets."""
    n = len(buf)
    space = SPACE[buf]
    before = np.ones(n, bool)  # the byte before is white space, or a text begins
    before[1:] = space[:-1]
    starts = offs[:-1][offs[:-1] < n]
    before[starts] = True
    at = np.flatnonzero(~(space & before))
    out = LOWER[buf[at]]
    out[space[at]] = 32
    return out, at, np.searchsorted(at, offs)


def edit_distance_within(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """Least edits between pattern and any part of text, and where that part ends; None beyond `most`.

    Myers' bit vectors in one long integer."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= most else None


_RNG = np.random.Generator(np.random.PCG64(1000))
_MOVES = _RNG.integers(0, 2, (WALKS, STEPS, 256)).astype(np.int32)
_SAMPLES = [[np.sort(_RNG.choice(STEPS, SAMPLED, replace=False)) for _ in range(TABLES)] for _ in range(WALKS)]


def embed(buf: np.ndarray, start: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings of the windows of buf at start, a row a step; STEPS zeros must follow the last text."""
    pos = start.astype(np.int32)
    out = np.empty((STEPS, len(start)), np.uint8)
    for j in range(STEPS):
        np.take(buf, pos, out=out[j], mode="clip")
        pos += _MOVES[walk, j][out[j]]
    return out


def sampled(embedded: np.ndarray, walk: int, n: int) -> np.ndarray:
    """Of each embedding, a hash of what table n of the walk samples."""
    h = np.full(embedded.shape[1], 1 + walk * TABLES + n, np.uint64)
    for i in range(0, SAMPLED, 4):
        four = np.zeros(embedded.shape[1], np.uint32)
        for j in _SAMPLES[walk][n][i : i + 4]:
            four <<= np.uint32(8)
            four |= embedded[j]
        h += four
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def apart(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with STEPS + 1 zeros after each, and where each begins."""
    gap = (STEPS + 1) * np.arange(len(offs) - 1)
    out = np.zeros(len(buf) + (STEPS + 1) * (len(offs) - 1), np.uint8)
    out[np.arange(len(buf)) + np.repeat(gap, np.diff(offs))] = buf
    return out, offs[:-1] + gap


def _grams(buf: np.ndarray) -> np.ndarray:
    """All strings of GRAM bytes, as numbers."""
    n = max(0, len(buf) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out << np.uint64(8) | buf[i : i + n]
    return out


class Items:
    """A block of items, as tasks need them."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        texts = []
        for i, t in rows:
            b = np.frombuffer(t, np.uint8)
            x = normalise(b, np.array([0, len(b)]))[0].tobytes().strip(b" ")
            if x:
                texts.append((i, x))
        self.ids, self.texts = [i for i, _ in texts], [t for _, t in texts]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array([int(len(t) * MAX_EDITS) for t in self.texts], np.int64)
        self._pieces()
        self._index()
        self.held = np.zeros(1 << GRAM_BITS, bool)
        for k, t in enumerate(self.texts):
            self.held[self._place(_grams(np.frombuffer(t, np.uint8)), k)] = True

    def _pieces(self) -> None:
        """Pieces of the short items, by their length."""
        self.grams = {}
        short = np.flatnonzero(self.sizes < SHORT).tolist()
        least = {k: int(self.sizes[k]) // (int(self.most[k]) + 1) for k in short}
        for q in sorted(set(least.values())):
            h, item, off = [], [], []
            for k in (k for k in short if least[k] == q):
                n = int(self.most[k]) + 1
                at = np.arange(n) * len(self.texts[k]) // n
                h.append(Rolling(np.frombuffer(self.texts[k], np.uint8)).grams(q)[at])
                item.append(np.full(n, k))
                off.append(at)
            h, item, off = np.concatenate(h), np.concatenate(item), np.concatenate(off)
            o = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << BITS, bool)
            bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.grams[q] = (h[o], item[o], off[o], bitmap)

    def _index(self) -> None:
        """What the tables sample of each place of the long items, with half of a walk of the item left."""
        long = np.flatnonzero(self.sizes >= SHORT)
        many = self.sizes[long] - STEPS // 2 + 1
        buf, begin = apart(np.frombuffer(b"".join(self.texts[k] for k in long), np.uint8), np.concatenate(([0], np.cumsum(self.sizes[long]))))
        self.item = np.repeat(long, many)
        self.off = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start = self.off + np.repeat(begin, many)
        keys, entry = [], []
        for w in range(WALKS):
            e = embed(buf, start, w)
            for n in range(TABLES):
                keys.append(sampled(e, w, n))
                entry.append(np.arange(len(start), dtype=np.int32))
        keys, entry = np.concatenate(keys), np.concatenate(entry)
        o = np.argsort(keys, kind="stable")
        self.keys, self.entry = keys[o], entry[o]
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    @staticmethod
    def _place(grams: np.ndarray, item) -> np.ndarray:
        x = (grams + np.asarray(item).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)

    def similar(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, text, diagonal) of windows that meet a place of a long item in some table."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.item) or not len(buf):
            return none
        wide, begin = apart(buf, offs)
        many = -(-np.diff(offs) // STRIDE)
        doc = np.repeat(np.arange(len(many)), many)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
        out = [none]
        for c in range(0, len(doc), 1 << 14):
            own, place = doc[c : c + (1 << 14)], at[c : c + (1 << 14)]
            start = begin[own] + place
            for w in range(WALKS):
                e = embed(wide, start, w)
                for n in range(TABLES):
                    k = sampled(e, w, n)
                    p = np.flatnonzero(self.bitmap[(k >> np.uint64(64 - BITS)).astype(np.int64)])
                    lo, hi = np.searchsorted(self.keys, k[p]), np.searchsorted(self.keys, k[p], side="right")
                    many = hi - lo
                    x = self.entry[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                    p = np.repeat(p, many)
                    out.append((self.item[x], own[p], place[p] + offs[own[p]] - self.off[x]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def pieces(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, text, diagonal) of each piece of a short item."""
        out = [(np.zeros(0, np.int64),) * 3]
        r = Rolling(buf) if self.grams else None
        for q, (h, item, off, bitmap) in self.grams.items():
            if len(buf) < q:
                continue
            g = r.grams(q)
            p = np.flatnonzero(bitmap[(g >> np.uint64(64 - BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(h, g[p]), np.searchsorted(h, g[p], side="right")
            doc = np.searchsorted(offs, p, side="right") - 1
            ok = (hi > lo) & (p + q <= offs[doc + 1])
            p, lo, n, doc = p[ok], lo[ok], (hi - lo)[ok], doc[ok]
            x = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((item[x], np.repeat(doc, n), np.repeat(p, n) - off[x]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def windows(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, text, first, last diagonal) of windows that hold as many of the item's grams as its edits leave.

        Diagonals that lie within an item's edits of each other are one window."""
        item, doc, diag = (np.concatenate(c) for c in zip(self.similar(buf, offs), self.pieces(buf, offs), strict=True))
        if not len(item):
            return item, doc, diag, diag
        o = np.lexsort((diag, item, doc))
        item, doc, diag = item[o], doc[o], diag[o]
        new = np.ones(len(o), bool)
        new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (diag[1:] - diag[:-1] > self.most[item[1:]])
        first = np.flatnonzero(new)
        last = diag[np.append(first[1:], len(o)) - 1]
        item, doc, diag = item[first], doc[first], diag[first]
        grams = _grams(buf)
        need = self.sizes[item] - GRAM + 1 - GRAM * self.most[item]  # an edit breaks GRAM grams at most
        lo = np.maximum(diag - self.most[item], offs[doc])
        hi = np.minimum(last + self.sizes[item] + self.most[item], offs[doc + 1]) - GRAM + 1
        keep = need <= 0
        todo = np.flatnonzero(~keep & (hi - lo >= need))
        todo = todo[np.argsort((hi - lo)[todo], kind="stable")]
        at = 0
        while at < len(todo):
            k = todo[at : at + max(1, (1 << 19) // int((hi - lo)[todo[min(at + 4096, len(todo) - 1)]]))][:4096]
            at += len(k)
            n = (hi - lo)[k]
            x = np.repeat(lo[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            got = self.held[self._place(grams[x], np.repeat(item[k], n))]
            keep[k] = np.add.reduceat(got, np.cumsum(n) - n, dtype=np.int64) >= need[k]
        return item[keep], doc[keep], diag[keep], last[keep]

    def leaks(self, arr: pa.Array):
        """(text, item id, edits, first and last place in the text's bytes) of each item's best window."""
        raw, raw_offs = text_bytes(arr)
        buf, place, offs = normalise(raw, raw_offs)
        item, doc, first, last = self.windows(buf, offs)
        seen = {}
        data = buf.tobytes() if len(item) else b""
        for i, d, a, b in zip(item.tolist(), doc.tolist(), first.tolist(), last.tolist(), strict=True):
            if (d, i) in seen and not seen[d, i][0]:
                continue
            size, most = int(self.sizes[i]), int(self.most[i])
            lo, hi = max(int(offs[d]), a - most), min(int(offs[d + 1]), b + size + most)
            window = data[lo:hi]
            at = window.find(self.texts[i])
            got = (0, at + size) if at >= 0 else edit_distance_within(self.texts[i], window, most)
            if got and ((d, i) not in seen or got[0] < seen[d, i][0]):
                stop = lo + got[1]
                # the part's start: the same distance read backwards
                back = edit_distance_within(self.texts[i][::-1], data[lo:stop][::-1], most) if got[0] else None
                start = stop - (back[1] if back else size)
                seen[d, i] = (got[0], int(place[start] - raw_offs[d]), int(place[stop - 1] - raw_offs[d]) + 1)
        for (d, i), (edits, a, b) in sorted(seen.items()):
            yield d, self.ids[i], edits, a, b


@lru_cache(maxsize=2)
def _items(block: Block) -> Items:
    return Items(pickle.loads(block.rows))


@dataclass(frozen=True)
class Block:
    """Items as they are sent to tasks; a worker indexes them once."""

    rows: bytes


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[Block]:
    rows, size = [], 0
    few = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0)
    for r in few.orderBy("i", "t").toLocalIterator():
        t = r.t.encode()
        if rows and size + len(t) > BLOCK_BYTES:
            yield Block(pickle.dumps(rows))
            rows, size = [], 0
        rows.append((r.i, t))
        size += len(t)
    if rows:
        yield Block(pickle.dumps(rows))


_LEAK = "array<struct<item_id:long,edits:int,start:long,stop:long>>"
_LEAK_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))


def _with_leaks(df: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, leaks: str) -> DataFrame:
    """df and a column of leaks (array of structs), a row per row."""
    out = df.withColumn(leaks, F.array().cast(_LEAK))
    blocks = _blocks(items, item_id, item_text)
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)

        def run(batches, block=block):
            found = _items(block)
            for b in slices(batches, text_col, SLICE):
                got = b.column(leaks).to_pylist()
                for d, i, edits, x, y in found.leaks(b.column(text_col)):
                    got[d].append({"item_id": i, "edits": edits, "start": x, "stop": y})
                at = b.schema.get_field_index(leaks)
                yield b.set_column(at, b.schema.field(at), pa.array(got, _LEAK_TYPE).cast(b.schema.field(at).type))

        out = out.mapInArrow(run, out.schema)
        if after is not None:  # one block's tasks at a time
            out = materialize(out, "leaks")
        block = after
    return out


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id and leaks array<struct<item_id, edits, start, stop>> (best window of each item, places in UTF-8 bytes), a row per row."""
    return _with_leaks(df.select(id_col, text_col), items, text_col, item_id, item_text, "leaks").select(id_col, "leaks")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.transform("leaks", lambda x: x.item_id).alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x.edits)).alias("least_edits"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: documents that hold a benchmark item go.  Nulls, repeated rows and extra columns stay as they are."""
    leaks = new_name(docs, "leaks")
    got = _with_leaks(docs, table(spark, sf_dir, "benchmark"), "text", "item_id", "text", leaks)
    return got.where(F.size(leaks) == 0).select(*docs.columns)
