"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes, with one more symbol for the end of a word.  Greedy longest match takes the longest
piece that fits, again and again.  Each trie node has a failure link, to the node that is reached when the pieces that
greedy matching is then sure of are popped, and the number of those pieces; so a word's pieces are counted in one pass
over its symbols, and no piece is ever built.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; all distinct words of a slice walk the automaton in step.  A word
that the vocabulary can't spell counts as one unknown piece.  Null or blank texts: 0.  A row per row, ids as they are.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, Rolling, mix, slices, table, text_bytes, word_spans

END = 256
SYMBOLS = 257
VOCABULARY = "word_bpe_49k.json"
SUFFIX = "</w>"
SLICE = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces_of(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary whose pieces at the end of a word carry a suffix."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    of = byte_alphabet()
    out = []
    for piece in vocab:
        last = piece.endswith(SUFFIX) and piece != SUFFIX
        chars = piece.removesuffix(SUFFIX) if last else piece
        if all(c in of for c in chars):
            out.append((*(of[c] for c in chars), *((END,) if last else ())))
    return out


class Automaton:
    """Trie with failure links; arrays only, so that many words step at once."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        step: dict[int, int] = {}
        token, parent, symbol, depth = [False], [0], [0], [0]
        for p in pieces:
            s = 0
            for c in p:
                t = step.get(s * SYMBOLS + c)
                if t is None:
                    t = step[s * SYMBOLS + c] = len(token)
                    token.append(False)
                    parent.append(s)
                    symbol.append(c)
                    depth.append(depth[s] + 1)
                s = t
            if p:
                token[s] = True
        n = len(token)
        fail, popped = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for u in np.argsort(np.array(depth), kind="stable")[1:].tolist():
            if token[u]:
                fail[u], popped[u] = 0, 1
                continue
            z, k = int(fail[parent[u]]), int(popped[parent[u]])
            while z >= 0 and (t := step.get(z * SYMBOLS + symbol[u])) is None:
                k += int(popped[z])
                z = int(fail[z])
            if z >= 0:
                fail[u], popped[u] = t, k
        self.fail, self.popped = fail, popped
        keys = np.array(list(step), np.int64)
        o = np.argsort(keys)
        self.keys, self.next = np.append(keys[o], np.iinfo(np.int64).max), np.append(np.array(list(step.values()), np.int64)[o], -1)

    def move(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        k = state * SYMBOLS + sym
        at = np.searchsorted(self.keys, k)
        return np.where(self.keys[at] == k, self.next[at], -1)

    def counts(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word buf[start:end]."""
        order = np.argsort(start - end, kind="stable")  # longest first: the words that still run are a prefix
        start, size = start[order], (end - start)[order]
        state, count, dead = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(len(start), bool)
        for j in range(int(size[0]) + 1 if len(size) else 0):
            n = int(np.searchsorted(-size, -j, side="right"))
            todo = np.flatnonzero(~dead[:n])
            sym = np.where(size[todo] > j, buf[np.minimum(start[todo] + j, len(buf) - 1)].astype(np.int64), END)
            while len(todo):
                to = self.move(state[todo], sym)
                ok = to >= 0
                state[todo[ok]] = to[ok]
                todo, sym = todo[~ok], sym[~ok]
                if not len(todo):
                    break
                f = self.fail[state[todo]]
                count[todo] += self.popped[state[todo]]
                lost = (f < 0) | (state[todo] == 0)
                dead[todo[lost]] = True
                todo, sym = todo[~lost], sym[~lost]
                state[todo] = self.fail[state[todo]]
        todo = np.flatnonzero(~dead & (state > 0))
        while len(todo):
            count[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]
            dead[todo[state[todo] < 0]] = True
            todo = todo[state[todo] > 0]
        count[dead] = 1
        out = np.empty_like(count)
        out[order] = count
        return out


@lru_cache(maxsize=4)
def automaton(path: str) -> Automaton:
    return Automaton(pieces_of(path))


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words long, n_tokens long.  vocabulary: a file that every worker can read."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        a = automaton(vocabulary)
        for b in slices(batches, text_col, SLICE):
            buf, offs = text_bytes(b.column(text_col))
            buf = LOWER[buf]
            s, e, wo = word_spans(buf, offs)
            h = mix(Rolling(buf).raw(s, e) + (e - s).astype(np.uint64))
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            pieces = a.counts(buf, s[first], e[first])[inverse] if len(s) else np.zeros(0, np.int64)
            total = np.concatenate(([0], np.cumsum(pieces)))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(np.diff(wo).astype(np.int64)), pa.array(np.diff(total[wo]))], names=[id_col, "n_words", "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
