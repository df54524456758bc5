"""Suffix-array dedup by a run-length index.

`dedup_substrings` finds every byte of every text that is covered by a `min_len`-byte string which also starts in a
text of a smaller id.  The work goes in four steps, each a table of bounded rows:

1. pack: texts are gathered into batches of about 16 MB, in pieces of about 4 MB (a longer text stands alone), compressed.
2. anchors: every `min_len`-byte window names its smallest hashed k-gram (its minimiser).  Neighbouring windows of one
   minimiser form a context; equal windows have equal minimisers, so they meet in the same bucket.  A piece sends a
   context as thirteen bytes (minimiser, hash of the whole context; 103 bits) once, for its smallest id.  A bucket finds
   contexts that are copies of a smaller id's, which this settles, and the minimisers that different contexts of two texts
   share.  With `verify` it settles nothing: copies go through the index, too.
3. index: each different context of a shared minimiser goes, as text, to its bucket (copies, with `verify`, as references to
   it).  A bucket's texts are dealt to INDEX_BUCKETS parts.  Of each part the texts are laid in one string, whose
   Burrows-Wheeler transform is kept by runs with sampled run ends
   (`RunLengthIndex`).  The texts stream through the index backwards, which gives the row of each byte's suffix; the run
   ends give the place of the suffix one row above, and the bytes at both places say whether the match is `min_len` long.
   Rows that match the row above stand together, and the smallest id among them is the least owner of their string.  A
   window is marked where that is smaller than its own text's id, a copy's windows where it is smaller than the copy's.
   Contexts of a minimiser with very many different contexts are dealt by single windows, and copies by their hash.  A batch
   sends equal windows once, and references to them; windows whose hash came once need no index.
4. mark: batches join what step 3 says of them, and give spans and what remains of each text.

Steps 2 and 3 exchange a row for each batch and bucket.  Both grow with the input, so rows grow with its square: batches are
of several pieces, a bucket's parts share rows, and nothing but cutting and compressing is done for a row of its own.

Null text: empty.  Null id: after all other ids, never earlier than another text.  Repeated ids: not earlier than each
other.  Texts under `min_len` bytes and empty tables: nothing is removed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Rolling, ids_of, materialize, mix, new_name, partitions, release, slices, table, text_bytes, trim

MIN_LEN = 50
GRAM = 24
PIECE_BYTES = 4 << 20
BATCH_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
#: Parts of a bucket, indexed one after the other: an index takes about a hundred bytes of memory a byte of text.
INDEX_BUCKETS = 8
CHUNK = 1 << 17
#: A minimiser with more different contexts than this is dealt by single windows.
HOT_CONTEXTS = 2048
#: Marks a single window's place in its context.
WINDOW = 128

_PACKED = "batch long, nbytes long, ids array<binary>, lens array<binary>, text array<binary>, carry array<binary>"
_PART = "batch long, kind int, bucket int, payload binary"


def _z(x: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x)


def _unz(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _pack(id_col: str, text_col: str, carry: list[str]):
    parts = ("ids", "lens", "text", "carry")
    schema = pa.schema([("batch", pa.int64()), ("nbytes", pa.int64()), *((x, pa.list_(pa.binary())) for x in parts)])

    def run(batches):
        part, seq, size, pieces = TaskContext.get().partitionId(), 0, 0, []

        def packed():
            return pa.RecordBatch.from_pylist([{"batch": (part << 32) + seq, "nbytes": size} | {x: [p[x] for p in pieces] for x in parts}], schema=schema)

        for b in slices(batches, text_col, PIECE_BYTES):
            buf, offs = text_bytes(b.column(text_col))
            if pieces and size + len(buf) > BATCH_BYTES:
                yield packed()
                seq, size, pieces = seq + 1, 0, []
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.select(carry).schema) as w:
                w.write_batch(b.select(carry))
            pieces.append({"ids": ids_of(b.column(id_col)).tobytes(), "lens": np.diff(offs).astype("<i8").tobytes(), "text": _z(buf.tobytes(), 3), "carry": _z(sink.getvalue().to_pybytes())})
            size += len(buf)
        if pieces:
            yield packed()

    return run


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())]))


def _together(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of about a MB: one costs as much as many small rows."""
    made, size = [], 0
    for row in rows:
        made.append(row)
        size += len(row["payload"])
        if len(made) >= 512 or size >= 1 << 20:
            yield _rows(made)
            made, size = [], 0
    if made:
        yield _rows(made)


def _window_minima(key: np.ndarray, w: int) -> np.ndarray:
    c = 1
    while c * 2 <= w:
        key = np.minimum(key[:-c], key[c:])
        c *= 2
    return np.minimum(key[: len(key) - (w - c)], key[w - c :]) if c < w else key


def contexts_of(buf: np.ndarray, lens: np.ndarray, min_len: int, k: int):
    """Contexts in order of place: first window, number of windows, minimiser hash, context hash.

    A context's windows start at a .. a + n - 1 within one text and share a minimiser; all windows are covered."""
    n, w = len(buf), min_len - k + 1
    ends = np.cumsum(lens)
    starts, big = ends - lens, lens >= min_len
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts[big], 1)
    np.add.at(step, ends[big] - min_len + 1, -1)
    valid = np.cumsum(step[:n]) > 0
    out = []
    for c in range(0, n - min_len + 1, CHUNK):
        sub = buf[c : c + CHUNK + min_len - 1]
        i = np.flatnonzero(valid[c : c + len(sub) - min_len + 1])
        if not len(i):
            continue
        r = Rolling(sub)
        v = r.grams(k)
        low = _window_minima((v & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(v), dtype=np.uint64), w)
        p = (low[i] & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.ones(len(i), bool)
        cut[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1)
        # a context must not run over the end of a text: the window after the last valid one of a text is invalid
        at = np.flatnonzero(cut)
        a, m = i[at], np.diff(np.append(at, len(i)))
        hm = mix(v[p[at]] * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1))
        out.append((a + c, m, hm, mix(r.raw(a, a + m + min_len - 1) + m.astype(np.uint64))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _five(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _eight(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def _anchor(n_buckets: int, min_len: int, k: int):
    """A batch's contexts: kind 0 says of each context how long it is and which bucket decides it; kind 1 goes there."""

    def contexts(row: dict):
        """Of all contexts in order of place: windows, whether they are sent, and of others the context that they copy; of
        those sent: minimiser, hash (its last bit: has copies here), id."""
        out, before = [], 0
        for text, lens, ids in zip(row["text"], row["lens"], row["ids"], strict=True):
            lens, ids = np.frombuffer(lens, "<i8"), np.frombuffer(ids, "<i8")
            a, m, hm, hr = contexts_of(np.frombuffer(_unz(text), np.uint8), lens, min_len, k)
            if not len(a):
                continue
            did = ids[np.searchsorted(np.cumsum(lens), a, side="right")]
            # a piece sends a context for its smallest id; its copies here go by what is said of that one
            o = np.lexsort((did, hr, hm))
            first = np.ones(len(o), bool)
            first[1:] = (hm[o][1:] != hm[o][:-1]) | (hr[o][1:] != hr[o][:-1])
            at, group = np.flatnonzero(first), np.cumsum(first) - 1
            rep, copied, least = np.empty(len(o), bool), np.empty(len(o), bool), np.empty(len(o), np.int64)
            rep[o] = did[o] == did[o][at][group]
            copied[o] = (did[o][np.append(at[1:], len(o)) - 1] > did[o][at])[group]
            least[o] = o[at][group]
            told = hr & ~np.uint64(1) | copied.astype(np.uint64)
            out.append((m.astype(np.uint8), rep, (least[~rep] + before).astype("<u4"), hm[rep], told[rep], did[rep]))
            before += len(a)
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None

    def rows(batches):
        for b in batches:
            for row in b.to_pylist():
                got = contexts(row)
                if got is None:
                    continue
                m, rep, least, hm, told, did = got
                bucket = ((hm >> np.uint64(32)) % np.uint64(INDEX_BUCKETS * n_buckets)).astype("<u4")
                own = struct.pack("<q", len(m)) + (m | np.where(rep, 0, 128).astype(np.uint8)).tobytes() + bucket.tobytes() + least.tobytes()
                yield {"batch": row["batch"], "kind": 0, "bucket": row["batch"] % n_buckets, "payload": _z(own)}
                bucket %= np.uint32(n_buckets)
                o = np.argsort(bucket, kind="stable")
                bucket, hm, told, did = bucket[o], hm[o], told[o], did[o]
                new = np.ones(len(o), bool)  # ids by runs: in order of place contexts of one text stand together
                new[1:] = (bucket[1:] != bucket[:-1]) | (did[1:] != did[:-1])
                run = np.flatnonzero(new)
                ids, count = did[run], np.diff(np.append(run, len(o))).astype("<i4")
                five = _five(hm)
                cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
                docs = np.searchsorted(run, cuts)
                del o, new, run, hm, did, own
                for x in np.flatnonzero(np.diff(cuts)).tolist():
                    i, j, p, q = cuts[x], cuts[x + 1], docs[x], docs[x + 1]
                    yield {"batch": row["batch"], "kind": 1, "bucket": x, "payload": struct.pack("<ii", q - p, j - i) + ids[p:q].tobytes() + count[p:q].tobytes() + five[5 * i : 5 * j] + _eight(told[i:j])}
        trim()

    return lambda batches: _together(rows(batches))


#: What a bucket says of a context: of no other text; a copy, to be looked up; to be indexed; to be indexed by windows, as a
#: whole too if it has copies; a copy of such a one; a copy that its hash settles.
NONE, COPY, WHOLE, WINDOWS, BOTH, HOT_COPY, SETTLED = range(7)


def _settle(hot: int, verify: bool):
    """Per bucket: a code for each context sent."""

    def rows(batches):
        src, K, R, D = [], [], [], []
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == 0:
                    yield row
                    continue
                p = row["payload"]
                nd, n = struct.unpack_from("<ii", p)
                at = 8 + 12 * nd
                D.append(np.repeat(np.frombuffer(p, "<i8", nd, 8), np.frombuffer(p, "<i4", nd, 8 + 8 * nd)))
                K.append(_unfive(p[at : at + 5 * n]))
                R.append(np.frombuffer(p, "<u8", n, at + 5 * n))
                src.append((row["batch"], row["bucket"], n))
        if not src:
            return
        K = np.concatenate(K)
        R = np.concatenate(R)
        D = np.concatenate(D)
        code = np.zeros(len(K), np.uint8)
        o = np.argsort(K)
        k = K[o]
        same = (R[o] & np.uint64(1)).astype(bool) if verify else np.zeros(len(o), bool)
        again = k[1:] == k[:-1]
        same[1:] |= again
        same[:-1] |= again
        o = o[same]  # only minimisers that came twice
        del k, same, again
        o = o[np.lexsort((D[o], R[o] >> np.uint64(1), K[o]))]
        if len(o):
            k, d, r = K[o], D[o], R[o]
            c = (r & np.uint64(1)).astype(bool)
            r >>= np.uint64(1)
            newk = np.ones(len(o), bool)
            newk[1:] = k[1:] != k[:-1]
            newr = newk.copy()
            newr[1:] |= r[1:] != r[:-1]
            run_of, group = np.cumsum(newr) - 1, np.cumsum(newk) - 1
            first, top = np.flatnonzero(newr), np.flatnonzero(newk)
            low = d[first]
            last = np.append(first[1:], len(o)) - 1
            has = (d[last] > low) | np.logical_or.reduceat(c, first)  # a copy of a larger id
            shared = (np.minimum.reduceat(d, top) < np.maximum.reduceat(d, top)) | np.logical_or.reduceat(c, top)
            many = np.bincount(group[first])
            of, is_hot = has[run_of], (many > hot)[group]
            if verify:
                own = np.where(is_hot, np.where(of, BOTH, WINDOWS), WHOLE)
                code[o] = np.where(shared[group], np.where(d > low[run_of], np.where(is_hot, HOT_COPY, COPY), own), NONE)
            else:  # only contexts that differ from another text's are open
                heads = np.flatnonzero(newk[first])
                open_ = (many > 1) & (np.minimum.reduceat(low, heads) < np.maximum.reduceat(low, heads))
                code[o] = np.where(d > low[run_of], SETTLED, np.where(open_[group], np.where(is_hot, WINDOWS, WHOLE), NONE))
        at = 0
        for batch, bucket, n in src:
            yield {"batch": batch, "kind": 1, "bucket": bucket, "payload": _z(code[at : at + n].tobytes())}
            at += n
        del K, R, D, code, o
        trim()

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(rows(batches))

    return run


def _codes(parts: list[dict], n_buckets: int):
    """A batch's contexts again: windows, code and part of the index of each, and of its copies within a piece the context that
    they copy (of others, itself)."""
    own = next((_unz(p["payload"]) for p in parts if p["kind"] == 0), None)
    if own is None:
        return None
    n = struct.unpack_from("<q", own)[0]
    state = np.frombuffer(own, np.uint8, n, 8)
    m, rep = (state & 127).astype(np.int64), state < 128
    at = np.flatnonzero(rep)
    bucket, of = np.zeros(n, np.int64), np.arange(n)
    bucket[at] = np.frombuffer(own, "<u4", len(at), 8 + n)
    of[~rep] = np.frombuffer(own, "<u4", -1, 8 + n + 4 * len(at))
    code = np.zeros(n, np.uint8)
    told = sorted(((p["bucket"], p["payload"]) for p in parts if p["kind"] == 1))
    code[at[np.argsort(bucket[at] % n_buckets, kind="stable")]] = np.frombuffer(b"".join(_unz(p) for _, p in told), np.uint8)
    return m, code, bucket, of


def _places(lens: np.ndarray, m: np.ndarray, min_len: int) -> np.ndarray:
    """First window of each context: contexts follow each other, and the last min_len - 1 bytes of a text start none."""
    windows = np.maximum(lens - min_len + 1, 0)
    first = np.cumsum(m) - m  # counted over windows alone
    doc = np.searchsorted(np.cumsum(windows), first, side="right")
    return first + (np.cumsum(lens - windows) - (lens - windows))[doc]


def _send(n_buckets: int, min_len: int):
    """Texts of the contexts that are to be indexed and references of copies, one payload for each batch and bucket."""
    fine = INDEX_BUCKETS * n_buckets

    def rows(batches):
        for b in batches:
            for row in b.to_pylist():
                got = _codes(row["parts"] or [], n_buckets)
                if got is None or not ((got[1] != NONE) & (got[1] != SETTLED)).any():
                    continue
                m, code, bucket, of = got
                buf = np.frombuffer(b"".join(_unz(x) for x in row["text"]), np.uint8)
                lens, ids = np.frombuffer(b"".join(row["lens"]), "<i8"), np.frombuffer(b"".join(row["ids"]), "<i8")
                a = _places(lens, m, min_len)
                copied = np.zeros(len(m), bool)
                copied[of[of != np.arange(len(of))]] = True
                sent = np.flatnonzero((code != NONE) & (code != WINDOWS) & (code != SETTLED))  # as wholes, or as copies of such
                one = np.flatnonzero((code == WINDOWS) | (code == BOTH))
                off = np.concatenate([np.arange(x) for x in m[one]]) if len(one) else np.zeros(0, np.int64)
                start = np.concatenate((a[sent], np.repeat(a[one], m[one]) + off))
                size = np.concatenate((m[sent] + min_len - 1, np.full(len(off), min_len)))
                ordinal = np.concatenate((sent, np.repeat(one, m[one])))
                off = np.concatenate((np.zeros(len(sent), np.int64), off))
                ref = np.concatenate((np.isin(code[sent], (COPY, HOT_COPY)), np.zeros(len(off) - len(sent), bool)))
                key = np.empty(len(start), np.uint64)
                for c in range(0, len(buf), CHUNK):
                    mine = np.flatnonzero((start >= c) & (start < c + CHUNK))
                    if len(mine):
                        s = start[mine] - c
                        key[mine] = mix(Rolling(buf[c : c + CHUNK + 2 * min_len]).raw(s, s + size[mine]) + (size[mine] - min_len + 1).astype(np.uint64))
                # a context's part of the index is its minimiser's; of hot ones and of windows, that of their own hash
                hashed = np.arange(len(start)) >= len(sent)
                hashed[: len(sent)] = np.isin(code[sent], (BOTH, HOT_COPY))
                where = np.where(hashed, ((key >> np.uint64(32)) % np.uint64(fine)).astype(np.int64), bucket[ordinal])
                key &= ~np.uint64(1)
                key[: len(sent)] |= copied[sent].astype(np.uint64)
                owner = ids[np.searchsorted(np.cumsum(lens), start, side="right")]
                # a batch sends equal windows once, for their smallest id; the others refer to that one
                o = len(sent) + np.lexsort((owner[len(sent) :], key[len(sent) :]))
                ref[o[1:][key[o[1:]] == key[o[:-1]]]] = True
                off[len(sent) :] |= WINDOW
                o = np.lexsort((ref, where % n_buckets))
                where, ref, start, size = where[o], ref[o], start[o], size[o]
                head = (owner[o], ordinal[o].astype("<i4"), key[o], (where // n_buckets).astype(np.uint8), off[o].astype(np.uint8))
                size8 = size.astype(np.uint8)
                cuts = np.searchsorted(where % n_buckets, np.arange(n_buckets + 1))
                texts = np.append(0, np.cumsum(~ref))  # a bucket's texts come before its references
                del owner, ordinal, key, where, ref, o
                for x in np.flatnonzero(np.diff(cuts)).tolist():
                    i, j = cuts[x], cuts[x + 1]
                    t = texts[j] - texts[i]
                    n = size[i : i + t]
                    src = np.repeat(start[i : i + t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    payload = b"".join((struct.pack("<ii", j - i, t), *(h[i:j].tobytes() for h in head), size8[i : i + t].tobytes(), buf[src].tobytes()))
                    yield {"batch": row["batch"], "kind": 2, "bucket": x, "payload": _z(payload)}
        trim()

    return lambda batches: _together(rows(batches))


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of many short texts, with sampled run ends.

    Kept: the head and first row of each run, the number of each symbol before each of its runs, and of each run the place
    of its first row and that of the last row of the run above (the run end), from which the place above any row follows.
    Places count a terminator after each text.  The suffix array is made to build the index and then let go.
    """

    def __init__(self, buf: np.ndarray, lens: np.ndarray):
        n, ends = len(buf), np.cumsum(lens)
        self.buf, self.n, self.texts = buf, n, len(lens)
        self.text_of = np.repeat(np.arange(len(lens)), lens)
        self.left = np.repeat(ends, lens) - np.arange(n)
        left = self.left
        # rank by as many symbols (0: past the end) as fit beside a place into 63 bits, then double
        used = np.zeros(256, bool)
        used[buf] = True
        base, bits = int(used.sum()) + 1, n.bit_length()
        h = max(k for k in range(1, 22) if base**k < 1 << (63 - bits))
        pad = np.concatenate((np.cumsum(used)[buf].astype(np.int64), np.zeros(h, np.int64)))
        key = np.zeros(n, np.int64)
        for j in range(h):
            key = key * base + np.where(left > j, pad[j : j + n], 0)
        most = int(lens.max()) if len(lens) else 0
        rank, sa = self._ranked(key, bits)
        while h < most:
            nxt = np.where(left > h, rank[np.minimum(np.arange(n) + h, n - 1)], 0)
            rank, sa = self._ranked(rank * (n + 1) + nxt, bits)
            h *= 2
        # row i < texts: the end of text i; then all suffixes, equal ones in order of place
        del rank, key, pad
        begin = ends - lens
        prev = np.zeros(self.texts + n, np.int64)
        filled = lens > 0
        prev[: self.texts][filled] = buf[ends[filled] - 1].astype(np.int64) + 1
        first = np.zeros(n + 1, bool)
        first[begin] = True
        prev[self.texts :] = np.where(first[sa], 0, buf[sa - 1].astype(np.int64) + 1)
        # what comes before a text is no symbol: such rows are runs of their own
        cut = np.ones(len(prev), bool)
        cut[1:] = (prev[1:] != prev[:-1]) | (prev[1:] == 0)
        head = np.flatnonzero(cut)
        self.run_row, self.run_sym = head, prev[head]
        run_len = np.diff(np.append(head, len(prev)))
        o = np.argsort(self.run_sym.astype(np.uint16), kind="stable")  # runs by symbol, then by row
        self.sorted_key = self.run_sym[o] * (len(prev) + 1) + head[o]
        before = np.cumsum(run_len[o]) - run_len[o]
        sym_first = np.searchsorted(self.run_sym[o], np.arange(258))
        total = np.bincount(prev, minlength=257)
        base = np.append(before, len(prev))[np.minimum(sym_first[:257], len(before))]
        # rows of suffixes that begin with symbol c come after the ends of texts and all smaller symbols
        start = self.texts + np.cumsum(total[:257]) - total[:257] - total[0]
        self.lf_base = before - base[self.run_sym[o]] + start[self.run_sym[o]]  # LF of a run's first row
        self.rows = len(prev)
        place = np.concatenate((ends + np.arange(self.texts), sa + self.text_of[sa])) if len(prev) else head
        self.first_place = place[head]
        self.end_above = place[np.maximum(head - 1, 0)]

    @staticmethod
    def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks from 1 of keys, and their places by key, then by place.  A number that holds both is sorted where it fits: that
        takes a fraction of the time of an argsort."""
        n = len(key)
        new = np.ones(n, bool)
        if int(key.max(initial=0)) < 1 << (63 - bits):
            both = np.sort(key << bits | np.arange(n))
            at, both = both & ((1 << bits) - 1), both >> bits
        else:
            at = np.argsort(key, kind="stable")
            both = key[at]
        new[1:] = both[1:] != both[:-1]
        rank = np.empty(n, np.int64)
        rank[at] = np.cumsum(new)
        return rank, at

    def runs(self) -> int:
        return len(self.run_row)

    def rank(self, sym: np.ndarray, row: np.ndarray) -> np.ndarray:
        """LF of the first row at or after `row` whose symbol is `sym`."""
        at = np.searchsorted(self.sorted_key, sym * (self.rows + 1) + row, side="right") - 1
        ok = at >= 0
        s, r = np.divmod(self.sorted_key[np.maximum(at, 0)], self.rows + 1)
        ok &= s == sym
        length = np.diff(np.append(self.run_row, self.rows))[np.searchsorted(self.run_row, r)]
        inside = np.where(ok, self.lf_base[np.maximum(at, 0)] + np.minimum(row - r, length), 0)
        nxt = np.minimum(at + 1, len(self.sorted_key) - 1)
        return np.where(ok, inside, np.where(self.sorted_key[nxt] // (self.rows + 1) == sym, self.lf_base[nxt], 0))

    def search(self, pattern: bytes) -> int:
        """How often a pattern occurs, by backward search."""
        lo, hi = np.array([0]), np.array([self.rows])
        for c in reversed(pattern):
            sym = np.array([c + 1])
            if not (self.run_sym == c + 1).any():
                return 0
            lo, hi = self.rank(sym, lo), self.rank(sym, hi)
            if lo[0] >= hi[0]:
                return 0
        return int(hi[0] - lo[0])

    def own_rows(self, lens: np.ndarray) -> np.ndarray:
        """Row of each byte's suffix: every text of the index streams through it backwards, all in step.

        A text of the index matches itself to its end, so each step is one LF step from the row before it."""
        place = np.empty(len(self.run_row), np.int64)
        place[np.searchsorted(self.run_row, self.sorted_key % (self.rows + 1))] = np.arange(len(self.run_row))
        # LF of every row from its run: rows of a run follow each other
        size = np.diff(np.append(self.run_row, self.rows))
        lf = np.arange(self.rows) + np.repeat(self.lf_base[place] - self.run_row, size)
        row, out = np.arange(self.texts), np.zeros(self.n, np.int64)
        order = np.argsort(-lens, kind="stable")  # the longest first: the texts that still run are a prefix
        ends, row = np.cumsum(lens)[order], row[order]
        by_size = -lens[order]
        for j in range(int(lens.max()) if len(lens) else 0):
            n = int(np.searchsorted(by_size, -j))
            row[:n] = lf[row[:n]]
            out[ends[:n] - 1 - j] = row[:n]
        return out

    def places_above(self) -> np.ndarray:
        """Of each byte's suffix, the place (without terminators) of the suffix one row above; n where that is no suffix.

        Above two rows of one run lie rows that follow each other as they do, so the place above a place is that of the
        nearest sampled one before it, moved on by as much."""
        known = np.full(self.rows, -1, np.int64)
        known[self.first_place] = np.arange(len(self.first_place))
        at = np.maximum.accumulate(np.where(known >= 0, np.arange(self.rows), -1))
        above = self.end_above[known[at]] + np.arange(self.rows) - at
        back = np.full(self.rows, self.n, np.int64)  # from places with terminators to those without
        mine = np.arange(self.n) + self.text_of
        back[mine] = np.arange(self.n)
        return back[above[mine]]


def least_owners(buf: np.ndarray, lens: np.ndarray, owner: np.ndarray, min_len: int) -> np.ndarray:
    """For each byte of the texts: the smallest owner of a text that the min_len-byte string from it occurs in (NULL_ID where
    no such string begins)."""
    ix = RunLengthIndex(buf, lens)
    if not ix.n:
        return np.zeros(0, np.int64)
    row = ix.own_rows(lens)
    above = ix.places_above()
    # matching statistics, as far as they matter: is the match with the row above min_len bytes long?
    left = np.append(ix.left, 0)
    shared = np.flatnonzero((ix.left >= min_len) & (left[above] >= min_len))
    if len(shared):
        words = np.ndarray((max(ix.n - 7, 0),), "<u8", np.ascontiguousarray(buf).data, strides=(1,))
        for j in (*range(0, min_len - 7, 8), min_len - 8):
            shared = shared[words[shared + j] == words[above[shared] + j]]
    cut = np.ones(ix.rows, bool)
    cut[row[shared]] = False
    own = np.full(ix.rows, NULL_ID, np.int64)
    own[row] = owner[ix.text_of]
    group = np.cumsum(cut) - 1
    least = np.minimum.reduceat(own, np.flatnonzero(cut))[group]
    return np.where(ix.left >= min_len, least[row], NULL_ID)


def matches(buf: np.ndarray, lens: np.ndarray, owner: np.ndarray, min_len: int) -> np.ndarray:
    """For each byte of the texts: does the min_len-byte string from it occur in a text of a smaller owner?"""
    return least_owners(buf, lens, owner, min_len) < np.repeat(owner, lens)


def _alone(key: np.ndarray, window: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Which texts are single windows whose hash no other window of the part has: they occur in no other text, as windows of one
    minimiser are all dealt as such, equal ones to one part."""
    at = np.flatnonzero(window)
    out = np.zeros(len(key), bool)
    _, of, n = np.unique(np.concatenate((key[at], refs)), return_inverse=True, return_counts=True)
    out[at] = n[of[: len(at)]] == 1
    return out


def _index(min_len: int):
    def masks(least: np.ndarray, begin: np.ndarray, lens: np.ndarray, of: np.ndarray) -> np.ndarray:
        """A bit for each window of the texts whose least owner is smaller than `of`."""
        out = np.zeros(len(begin), np.uint32)
        for j in range(32):
            on = np.flatnonzero(lens >= min_len + j)
            out[on] |= (least[begin[on] + j] < of[on]).astype(np.uint32) << np.uint32(j)
        return out

    def rows(batches):
        src, parts, refs = [], [], []
        for b in batches:
            for row in b.to_pylist():
                p = _unz(row["payload"])
                n, t = struct.unpack_from("<ii", p)
                head = [np.frombuffer(p, kind, n, 8 + n * at) for kind, at in (("<i8", 0), ("<i4", 8), ("<u8", 12), ("u1", 20), ("u1", 21))]
                at = 8 + 22 * n
                src.append((row["batch"], row["bucket"], t, n - t))
                parts.append((*(x[:t] for x in head), np.frombuffer(p, np.uint8, t, at), np.frombuffer(p, np.uint8, -1, at + t)))
                refs.append([x[t:] for x in head])
        owner, ordinal, named, part, off, lens, buf = (np.concatenate(x) for x in zip(*parts, strict=True))
        ref_owner, ref_ordinal, ref_key, ref_part, ref_off = (np.concatenate(x) for x in zip(*refs, strict=True))
        del parts, refs
        lens = lens.astype(np.int64)
        begin = np.cumsum(lens) - lens
        mask, ref_mask = np.zeros(len(lens), np.uint32), np.zeros(len(ref_owner), np.uint32)
        for x in np.unique(part):  # references name texts of their own part
            mine, theirs = np.flatnonzero(part == x), np.flatnonzero(ref_part == x)
            mine = mine[~_alone(named[mine], off[mine] >= WINDOW, ref_key[theirs[ref_off[theirs] >= WINDOW]])]
            if not len(mine):
                continue
            size = lens[mine]
            first = np.cumsum(size) - size
            least = least_owners(buf[np.repeat(begin[mine] - first, size) + np.arange(size.sum())], size, owner[mine], min_len)
            mask[mine] = masks(least, first, size, owner[mine]) << (off[mine] % WINDOW).astype(np.uint32)
            if len(theirs):
                key = named[mine] & ~np.uint64(1)
                o = np.argsort(key, kind="stable")
                want = ref_key[theirs] & ~np.uint64(1)
                at = o[np.minimum(np.searchsorted(key[o], want), len(o) - 1)]
                found = np.flatnonzero(key[at] == want)
                at = at[found]
                ref_mask[theirs[found]] = masks(least, first[at], size[at], ref_owner[theirs[found]]) << (ref_off[theirs[found]] % WINDOW).astype(np.uint32)
            del least
            trim()
        answered = (mask > 0) | (named & np.uint64(1) > 0)  # the copies within its piece wait for it
        i = j = 0
        for batch, bucket, t, r in src:
            keep, kept = i + np.flatnonzero(answered[i : i + t]), j + np.flatnonzero(ref_mask[j : j + r])
            if len(keep) or len(kept):
                yield {"batch": batch, "kind": 2, "bucket": bucket, "payload": b"".join((struct.pack("<i", len(keep) + len(kept)), ordinal[keep].tobytes(), ref_ordinal[kept].tobytes(), mask[keep].tobytes(), ref_mask[kept].tobytes()))}
            i, j = i + t, j + r

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(rows(batches))

    return run


def _mark(n_buckets: int, min_len: int, schema: pa.Schema, names: tuple[str, str, str], verify: bool):
    def hits(row: dict, lens: np.ndarray) -> np.ndarray:
        """1 for each window of a batch that is found, by first byte."""
        hit = np.zeros(lens.sum() + 1, np.uint8)
        got = _codes(row["parts"] or [], n_buckets)
        if got is None:
            return hit
        m, code, _, of = got
        a = _places(lens, m, min_len)
        answered = np.zeros(len(m), bool)
        told = [(struct.unpack_from("<i", p["payload"])[0], p["payload"]) for p in row["parts"] if p["kind"] == 2]
        if told:
            o, mask = (np.concatenate([np.frombuffer(p, kind, k, 4 + k * at) for k, p in told]) for kind, at in (("<i4", 0), ("<u4", 4)))
            answered[o] = True
            for j in range(32):
                hit[a[o[(mask >> np.uint32(j)) & 1 == 1]] + j] = 1
        # copies within a piece are of larger ids than the context that the index found
        on = np.flatnonzero((of != np.arange(len(of))) & (answered[of] | (not verify)) | (code == SETTLED))
        for j in range(int(m[on].max()) if len(on) else 0):
            on = on[m[on] > j]
            hit[a[on] + j] = 1
        return hit

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                sizes = [np.frombuffer(x, "<i8") for x in row["lens"]]
                hit, at_ = hits(row, np.concatenate(sizes)), 0
                for text, lens, carry in zip(map(_unz, row["text"]), sizes, row["carry"], strict=True):
                    n = len(text)
                    w = np.flatnonzero(hit[at_ : at_ + n])
                    at_ += n
                    cover = np.zeros(n + 1, np.int32)
                    cover[w] += 1
                    cover -= np.bincount(w + min_len, minlength=n + 1)[: n + 1].astype(np.int32)
                    gone = np.cumsum(cover)[:n] > 0
                    ends = np.cumsum(lens)
                    begin = ends - lens
                    edge = np.zeros(n + 1, bool)
                    edge[begin] = True
                    s = np.flatnonzero(gone & ~(np.append(False, gone[:-1]) & ~edge[:n])) if n else np.zeros(0, np.int64)
                    e = np.flatnonzero(gone & ~(np.append(gone[1:], False) & ~edge[1:])) + 1 if n else s
                    doc = np.searchsorted(ends, s, side="right")
                    cuts = np.searchsorted(doc, np.arange(len(lens) + 1))
                    spans, kept = [], []
                    for i in range(len(lens)):
                        lo, hi, at = cuts[i], cuts[i + 1], begin[i]
                        if lo == hi:
                            spans.append([])
                            kept.append(text[at : ends[i]])
                            continue
                        spans.append([{"start": int(x - at), "stop": int(y - at)} for x, y in zip(s[lo:hi], e[lo:hi], strict=True)])
                        edges = [at, *np.ravel(np.column_stack((s[lo:hi], e[lo:hi]))), ends[i]]
                        kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                    carried = pa.ipc.open_stream(_unz(carry)).read_all()
                    cols = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in carried.columns]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(lens, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary())], names=[*carried.schema.names, *names])
        trim()

    return run


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, carry: list[str] | None = None, names: tuple[str, str, str] = ("n_bytes", "spans", "kept"), verify: bool = False) -> DataFrame:
    """The id and carried columns, and n_bytes long, spans array<struct<start, stop>> (bytes removed), kept binary.

    carry: other columns to hand through, of other names than the results; names: of the results; verify: send copies of
    whole contexts through the index, too."""
    if not GRAM < min_len <= GRAM + 32:
        raise ValueError(f"min_len must be from {GRAM + 1} to {GRAM + 32}")
    spark = df.sparkSession
    kept = [id_col, *(carry or [])]
    if clash := set(names) & set(kept):
        raise ValueError(f"carried columns clash with results: {sorted(clash)}")
    packed = materialize(df.select(*dict.fromkeys([*kept, text_col])).mapInArrow(_pack(id_col, text_col, kept), _PACKED), "packed")
    total = packed.agg(F.sum("nbytes")).first()[0] or 0
    n_buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    sent = packed.select("batch", "ids", "lens", "text").mapInArrow(_anchor(n_buckets, min_len, GRAM), _PART)
    codes = materialize(sent.groupBy("bucket").applyInArrow(_settle(HOT_CONTEXTS, verify), _PART), "codes")

    def with_parts(parts: DataFrame, *columns: str) -> DataFrame:
        told = parts.groupBy("batch").agg(F.collect_list(F.struct("kind", "bucket", "payload")).alias("parts"))
        return packed.select("batch", "lens", "text", *columns).join(told, "batch", "left")

    texts = with_parts(codes, "ids").mapInArrow(_send(n_buckets, min_len), _PART)
    found = materialize(texts.groupBy("bucket").applyInArrow(_index(min_len), _PART), "found")
    fields = [df.schema[c] for c in kept]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{names[0]}` long", f"`{names[1]}` array<struct<start:long,stop:long>>", f"`{names[2]}` binary"])
    span = pa.schema([("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
    return with_parts(codes.unionByName(found), "carry").mapInArrow(_mark(n_buckets, min_len, span, names, verify), out)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_substrings(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s.stop - s.start).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: repeated passages go; n_chars follows the text.  Null texts stay null, other columns as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    n, spans, kept, null = (new_name(docs, c) for c in ("n_bytes", "spans", "kept", "no_text"))
    got = dedup_substrings(docs.withColumn(null, F.col("text").isNull()), carry=[*others, null], names=(n, spans, kept))
    text = F.col(kept).cast("string")  # a span may end within a character: what is left of it goes too
    text = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
    text = F.when(~F.col(null), text)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col(null), F.col("n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType))
    return got.withColumn("text", text).select(*docs.columns)


__all__ = ["NULL_ID", "RunLengthIndex", "dedup_stage", "dedup_substrings", "matches", "op1", "release"]
