"""Choosing trials and chains: argmin by size, first in order on ties.

Trials as a table serve analysis (`best_trials`, `best_chains`, `leave_one_out`, `shapley`).  `encode` needs no such table: a
tensor's chains and codecs are run and chosen among in one pass where the tensor is, so nothing is shuffled and nothing is
computed twice; its result keeps a tensor's planes in its row, and `decode` reads them where they are."""

from __future__ import annotations

import itertools
import math
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import codecs
from . import chain as C

KEYS = ["tensor_id", "chain_id", "plane"]


def best_trials(trials: DataFrame) -> DataFrame:
    """The smallest trial of each plane; the earlier of the menu on ties.  A plane of which all trials failed has codec and
    size null, and its chain is lost."""
    rest = [c for c in trials.columns if c not in (*KEYS, "error")]
    # one number orders trials, so that the aggregate hashes and doesn't sort: sizes are under 2**47, menus under 2**16
    order = F.when(F.col("size").isNotNull(), F.shiftleft(F.col("size").cast("long"), 16) + F.col("menu_pos"))
    least = trials.withColumn("_order", order).groupBy(*KEYS).agg(F.min("_order").alias("_least"))
    # a plane's least order names its trial
    small = [c for c in rest if c not in ("payload", "state")]
    if small == rest and set(rest) == {"codec", "menu_pos", "size"}:
        names = trials.groupBy("codec").agg(F.min("menu_pos").alias("menu_pos"))
        got = least.select(*KEYS, F.shiftright("_least", 16).alias("size"), F.col("_least").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("menu_pos"))
        return got.join(F.broadcast(names), "menu_pos", "left").select(*KEYS, *rest)
    got = trials.withColumn("_order", order).groupBy(*KEYS).agg(F.min_by(F.struct(*rest), F.col("_order")).alias("t"))
    return got.select(*KEYS, "t.*")


def best_chains(best: DataFrame) -> DataFrame:
    """(tensor_id, chain_id, total): the chain of the smallest sum over its planes, the first on ties; chains with a plane
    that no codec took are out."""
    total = best.groupBy("tensor_id", "chain_id").agg(F.sum("size").alias("total"), F.count_if(F.col("size").isNull()).alias("lost")).where("lost = 0")
    return total.groupBy("tensor_id").agg(F.min(F.struct("total", "chain_id")).alias("t")).select("tensor_id", "t.chain_id", "t.total")


def leave_one_out(trials: DataFrame, most: int | None = None) -> DataFrame:
    """(codec, delta): how much larger the best total gets if the codec is left out; trials are not run anew.  most: report
    so many codecs, those that save most.

    A plane's best codec costs the way to its second best, the others nothing; a plane that has one codec alone counts 0."""
    valid = trials.where("size is not null").select(*KEYS, "codec", "size", "menu_pos")
    two = valid.groupBy(*KEYS).agg(F.min(F.struct("size", "menu_pos", "codec")).alias("a"), F.collect_list(F.struct("size", "menu_pos", "codec")).alias("all"))
    rest = F.array_min(F.filter("all", lambda x: x.codec != F.col("a.codec")))
    own = two.select(F.col("a.codec").alias("codec"), (F.coalesce(rest["size"], F.col("a.size")) - F.col("a.size")).alias("d"))
    out = valid.select("codec").distinct().join(own.groupBy("codec").agg(F.sum("d").alias("d")), "codec", "left").select("codec", F.coalesce("d", F.lit(0)).cast("long").alias("delta"))
    return out if most is None else out.orderBy(F.desc("delta"), "codec").limit(most)


def shapley(trials: DataFrame, most: int = 8) -> DataFrame:
    """(codec, value): the mean of what a codec saves over all orders of adding codecs, against no codec but the menu's first
    (which always stays).  From sizes alone: one aggregate gives each coalition's total; more than `most` codecs are an error."""
    valid = trials.where("size is not null")
    menu = [r.codec for r in valid.groupBy("codec").agg(F.min("menu_pos").alias("p")).orderBy("p").collect()]
    base, others = menu[:1], menu[1:]
    if len(others) > most:
        raise ValueError(f"{len(others)} codecs are more than {most}: there would be {2 ** len(others)} coalitions")
    coalitions = [c for n in range(len(others) + 1) for c in itertools.combinations(others, n)]
    per = valid.groupBy(*KEYS).agg(*(F.min(F.when(F.col("codec").isin(*base, *c), F.col("size"))).alias(f"c{i}") for i, c in enumerate(coalitions)))
    row = per.agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(len(coalitions)))).first()
    total = {frozenset(c): row[i] or 0 for i, c in enumerate(coalitions)}
    n, out = len(others), []
    for k in others:
        v = 0.0
        for c in coalitions:
            if k not in c:
                weight = math.factorial(len(c)) * math.factorial(n - len(c) - 1) / math.factorial(n)
                v += weight * (total[frozenset(c)] - total[frozenset((*c, k))])
        out.append((k, float(v)))
    return trials.sparkSession.createDataFrame(out, "codec string, value double")


PLANES = "array<struct<plane:int,role:string,width:int,nibble:boolean,row_len:int,codec:string,payload:binary,size:long,crc:long>>"
_PLANE = pa.struct([("plane", pa.int32()), ("role", pa.string()), ("width", pa.int32()), ("nibble", pa.bool_()), ("row_len", pa.int32()), ("codec", pa.string()), ("payload", pa.binary()), ("size", pa.int64()), ("crc", pa.int64())])


def encode_one(raw: bytes, kind: str, role: str = "STANDARD", row_len: int | None = None, menu: tuple[str, ...] | None = None, chains: list[C.Chain] | None = None, state: bytes | None = None) -> tuple[str, list[dict], int]:
    """(chain, planes, size) of the smallest candidate.  A chain that doesn't fit, or with a plane that no codec takes, is
    out; where all are, the bytes are kept as they are."""
    best, tried = None, {}
    for c in chains if chains is not None else C.candidates(kind, role):
        try:
            planes = C.forward(c, kind, raw)
            types = C.propagate(c, kind, len(raw), role, row_len)
        except C.ChainError:
            continue
        chosen = []
        for i, (b, t) in enumerate(zip(planes, types, strict=True)):
            info = codecs.Info(t.role, t.width, t.nibble, t.row_len, kind, state)
            if (b, info) not in tried:  # chains share planes
                try:
                    of = [x for x in codecs.trials_of(b, info, menu) if x[2] is not None]
                except ValueError:
                    of = []
                tried[b, info] = min(of, key=lambda x: (len(x[2]), x[1]), default=None)
            got = tried[b, info]
            if got is None:
                break
            chosen.append({"plane": i, "role": t.role, "width": t.width, "nibble": t.nibble, "row_len": t.row_len, "codec": got[0], "payload": got[2], "size": len(got[2]), "crc": zlib.crc32(b)})
        else:
            size = sum(x["size"] for x in chosen)
            if best is None or size < best[2]:
                best = (C.to_text(c), chosen, size)
    if best is None:
        best = ("", [{"plane": 0, "role": "raw", "width": 1, "nibble": False, "row_len": None, "codec": "identity", "payload": raw, "size": len(raw), "crc": zlib.crc32(raw)}], len(raw))
    return best


def decode_one(chain: str, kind: str, planes: list[dict], nbytes: int, state: bytes | None = None) -> bytes:
    """The bytes again.  A plane whose checksum differs is an error, and so is one that is longer than its type says."""
    out = []
    for p in sorted(planes, key=lambda p: p["plane"]):
        info = codecs.Info(p["role"], p["width"], p["nibble"], p["row_len"], kind, state)
        b = codecs.CODECS[p["codec"]].decode(p["payload"], info)
        if zlib.crc32(b) != p["crc"]:
            raise ValueError(f"plane {p['plane']} doesn't have its checksum")
        out.append(b)
    if not chain:
        return out[0]
    return C.inverse(C.from_text(chain), kind, out, nbytes)


_ENCODED = "chain string, size long, planes " + PLANES
CARRIED = ("tensor_id", "write_seq", "name", "dtype", "shape", "row_len", "role", "chunk_idx", "delta_ref", "delta_digest")


def encode(tensors: DataFrame, menu: tuple[str, ...] | None = None, extra: dict[tuple[str, str], list[C.Chain]] | None = None) -> DataFrame:
    """A row a tensor (or chunk): what is known of it, nbytes, digest, chain (as text), size and its chosen planes.

    tensors: tensor_id, name, dtype, raw and, if there, role (of operators.classify), row_len, shape, write_seq, chunk_idx,
    state (a model kept elsewhere).  extra: chains to try after the production ones, by dtype and role."""
    have = [c for c in CARRIED if c in tensors.columns]
    cols = [*have, "raw", *(["state"] if "state" in tensors.columns else [])]
    out = ", ".join(f"`{c}` {tensors.schema[c].dataType.simpleString()}" for c in have) + ", nbytes long, digest string, state_used binary, " + _ENCODED
    source = tensors.select(*cols, F.sha2("raw", 256).alias("digest"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # one tensor at a time
                row = b.slice(i, 1)
                r = {c: row.column(c)[0].as_py() for c in ("dtype", "raw", *(x for x in ("role", "row_len", "state") if x in cols))}
                role = r.get("role") or "STANDARD"
                kind = C.dtype(r["dtype"]).name
                chains = C.candidates(kind, role) + (extra or {}).get((kind, role), [])
                chain, planes, size = encode_one(r["raw"], kind, role, r.get("row_len"), menu, chains, r.get("state"))
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in have), pa.array([len(r["raw"])], pa.int64()), row.column("digest"), pa.array([r.get("state")], pa.binary()), pa.array([chain]), pa.array([size], pa.int64()), pa.array([planes], pa.list_(_PLANE))],
                    names=[*have, "nbytes", "digest", "state_used", "chain", "size", "planes"],
                )

    return source.mapInArrow(run, out)


def decode(store: DataFrame) -> DataFrame:
    """What encode was given of each tensor, and raw; a tensor whose digest differs is an error."""
    have = [c for c in CARRIED if c in store.columns]
    cols = [*have, "nbytes", "digest", "state_used", "chain", "planes"]
    out = ", ".join(f"`{c}` {store.schema[c].dataType.simpleString()}" for c in have) + ", digest string, raw binary"

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                r = {c: row.column(c)[0].as_py() for c in ("dtype", "nbytes", "state_used", "chain", "planes")}
                raw = decode_one(r["chain"], C.dtype(r["dtype"]).name, r["planes"], r["nbytes"], r["state_used"])
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in have), row.column("digest"), pa.array([raw], pa.binary())], names=[*have, "digest", "raw"])

    got = store.select(*cols).mapInArrow(run, out)
    checked = F.when(F.sha2("raw", 256) == F.col("digest"), F.col("raw")).otherwise(F.raise_error(F.concat(F.lit("digest mismatch: "), F.coalesce(F.col("name") if "name" in have else F.lit(""), F.lit("")))).cast("binary"))
    return got.select(*have, checked.alias("raw"))


def explode_planes(store: DataFrame) -> DataFrame:
    """A row a plane: the other layout of a store."""
    return store.select("*", F.explode("planes").alias("_p")).drop("planes").select("*", "_p.plane", F.col("_p").alias("member")).drop("_p")


def implode_planes(exploded: DataFrame) -> DataFrame:
    """A row a tensor again; a plane that is missing is an error."""
    keys = [c for c in exploded.columns if c not in ("plane", "member", "state_used", "shape")]
    got = exploded.groupBy(*keys).agg(F.sort_array(F.collect_list("member")).alias("planes"), F.first("state_used").alias("state_used"), *([F.first("shape").alias("shape")] if "shape" in exploded.columns else []))
    whole = F.array_max(F.transform("planes", lambda p: p.plane)) + 1 == F.size("planes")
    return got.withColumn("planes", F.when(whole, F.col("planes")).otherwise(F.raise_error(F.lit("missing plane")).cast(PLANES)))


def bench(tensors: DataFrame, menu: tuple[str, ...] | None = None) -> DataFrame:
    """(tensor_id, dtype, codec, nbytes, size, ratio, encode_ns) of each codec over whole tensors."""
    import time

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                info, rows = codecs.Info(width=C.dtype(r["dtype"]).size, dtype=r["dtype"]), []
                for c in codecs.menu_for(info, len(r["raw"]), menu):
                    t = time.perf_counter_ns()
                    size = len(c.encode(r["raw"], info))
                    rows.append((r["tensor_id"], r["dtype"], c.name, len(r["raw"]), size, len(r["raw"]) / max(size, 1), time.perf_counter_ns() - t))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["tensor_id", "dtype", "codec", "nbytes", "size", "ratio", "encode_ns"])

    return tensors.select("tensor_id", "dtype", "raw").mapInArrow(run, "tensor_id long, dtype string, codec string, nbytes long, size long, ratio double, encode_ns long")
