"""What users add: transforms, codecs, delta schemes, chain builders and explorers, classifiers, scorers, hooks, metrics and
formats, by kind and name.  Functions are plain Python and reach workers with the plans that use them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.metadata import entry_points

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds and what their functions take and give.
KINDS = {
    "transform": "(forward, inverse): bytes to bytes",
    "plane_codec": "(encode, decode): bytes to bytes",
    "delta_scheme": "(encode(base, target), decode(base, residual)): bytes",
    "container_layout": "(write(df, path), read(spark, path))",
    "raw_binary": "(encode, decode): bytes to bytes",
    "chain_builder": "(dtype, role) to a list of chains",
    "chain_explorer": "(dtype, role) to an iterator of chains",
    "classifier": "a list of operators.classify.Rule",
    "scorer": "bytes to float, less is better",
    "training_hook": "(name, bytes) to bytes, before encoding",
    "integration_adapter": "(mode, bytes) to bytes",
    "benchmark_metric": "bytes to float",
}
GROUP = "tensorloom.extensions"


@dataclass(frozen=True)
class Extension:
    kind: str
    name: str
    functions: tuple[Callable, ...] | list


class Registry:
    """Extensions by kind and name; one of a policy's deny list, or missing on its allow list, isn't found."""

    def __init__(self, allow: set[str] | None = None, deny: set[str] = frozenset()):
        self.found: dict[tuple[str, str], Extension] = {}
        self.allow, self.deny = allow, deny

    def add(self, kind: str, name: str, *functions) -> None:
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
        if (kind, name) in self.found:
            raise ValueError(f"there is a {kind} {name} already")
        self.found[kind, name] = Extension(kind, name, functions)

    def load(self) -> None:
        """Those that installed packages offer as entry points; each is called with the registry."""
        for e in entry_points(group=GROUP):
            e.load()(self)

    def get(self, kind: str, name: str) -> Extension:
        if name in self.deny or (self.allow is not None and name not in self.allow) or (kind, name) not in self.found:
            raise KeyError(f"{kind} {name}")
        return self.found[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.found if k == kind and n not in self.deny and (self.allow is None or n in self.allow))


def apply_bytes(df: DataFrame, column: str, function: Callable[..., bytes], *others: str) -> DataFrame:
    """The column with a function of it (and of other columns) in its place: transforms, hooks, adapters, delta schemes."""
    rest = [c for c in df.columns if c != column]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + f", `{column}` binary"

    def run(batches):
        for b in batches:
            args = [b.column(c).to_pylist() for c in (*others, column)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([function(*x) for x in zip(*args, strict=True)], pa.binary())], names=[*rest, column])

    return df.select(*rest, column).mapInArrow(run, schema).select(*df.columns)


def score(df: DataFrame, column: str, function: Callable[[bytes], float], name: str = "score") -> DataFrame:
    """Adds what a scorer or metric says of each row's bytes."""
    return df.withColumn(name, F.pandas_udf(lambda s: pd.Series([float(function(bytes(x))) for x in s]), "double")(F.col(column)))


def codec_of(extension: Extension, priority: int = 0):
    """A registered plane codec as a codec of the menu (opt-in)."""
    from .operators import codecs

    encode, decode = extension.functions
    return codecs.Codec(extension.name, lambda b, info: encode(b), lambda b, info: decode(b), priority=priority, opt_in=True)
