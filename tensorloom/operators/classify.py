"""Roles of tensors from names, types and siblings; shard plans; sets of a policy."""

from __future__ import annotations

import fnmatch
import json
import re
import tomllib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import ROLES


@dataclass(frozen=True)
class Rule:
    """What a classifier says of a name: role where `when` holds, by which source and pattern."""

    when: Column
    role: str
    source: str
    pattern: str


def glob_like(column: Column, pattern: str) -> Column:
    """Whether a whole string fits a glob of *, ? and [...], case told apart."""
    return column.rlike("^(?:" + re.sub(r"\\Z$|\\z$", "", fnmatch.translate(pattern)) + ")$")


def explicit_rules(rules: dict[str, str] | list[str], source: str = "flag") -> list[Rule]:
    """Globs and their roles in order, as a dict or as "glob=role"; an unknown role is an error."""
    pairs = rules.items() if isinstance(rules, dict) else [_flag(r) for r in rules]
    out = []
    for pattern, role in pairs:
        if role not in ROLES:
            raise ValueError(f"{role} is none of {', '.join(ROLES)}")
        out.append(Rule(glob_like(F.col("name"), pattern), role, source, pattern))
    return out


def _flag(text: str) -> tuple[str, str]:
    pattern, eq, role = text.partition("=")
    if not eq:
        raise ValueError(f"{text}: write <glob>=<role>")
    return pattern, role


def config_rules(text: str) -> list[Rule]:
    """Rules of a TOML file: [[rule]] with pattern and role."""
    return [r for e in tomllib.loads(text).get("rule", []) for r in explicit_rules({e["pattern"]: e["role"]}, "config")]


#: Roles by ending in models quantized to four-bit floats with block scales, and formats that are known.
QUANT_ROLES = {".weight": "PACKED_VALUES", ".weight_scale": "SCALE_BLOCK", ".weight_scale_2": "SCALE_GLOBAL", ".input_scale": "SCALE_GLOBAL"}
QUANT_FORMATS = ("NVFP4", "MXFP4")


def quant_rules(text: str) -> list[Rule]:
    """Rules of a quantization config (JSON): endings of modules that have block scales and aren't excluded.

    An unknown format or a config without one is an error; of MXFP4 nothing is said, as its endings aren't fixed."""
    q = json.loads(text).get("quantization")
    if not isinstance(q, dict) or "quant_algo" not in q:
        raise ValueError("no quantization.quant_algo in the config")
    if q["quant_algo"] not in QUANT_FORMATS:
        raise ValueError(f"{q['quant_algo']} is none of {', '.join(QUANT_FORMATS)}")
    if q["quant_algo"] != "NVFP4":
        return []
    out = []
    for end, role in QUANT_ROLES.items():
        module = F.regexp_replace("name", re.escape(end) + "$", "")
        excluded = F.lit(False)
        for pattern in q.get("exclude_modules", ()):
            excluded = excluded | glob_like(module, pattern)
        has = F.array_contains("_siblings", F.lit(".weight_scale"))
        out.append(Rule(F.col("name").endswith(end) & (F.col("_module") == module) & has & ~excluded, role, "quant_config", f"*{end}"))
    return out


#: Endings of scales and of what they belong to, and element types of scales.
SCALE_ENDS, VALUE_ENDS, SCALE_TYPES = (".weight_scale", "_scales", ".scale"), (".weight", "_blocks", "_packed"), ("uint8", "float8_e4m3fn", "float8_e5m2")
ENDS = tuple(sorted({*SCALE_ENDS, *VALUE_ENDS, *QUANT_ROLES, "_scale_2", "input_scale"}, key=len, reverse=True))


def heuristic_rules() -> list[Rule]:
    """Block scales by type, ending and a sibling that holds the values; packed values that have scales; global scales."""
    kind, said = F.col("dtype"), []
    for end in SCALE_ENDS:
        has = F.arrays_overlap("_siblings", F.array(*map(F.lit, VALUE_ENDS)))
        said.append(Rule(F.col("name").endswith(end) & kind.isin(*SCALE_TYPES) & has, "SCALE_BLOCK", "heuristic", f"*{end}"))
    said.append(Rule((F.col("name").endswith("_scale_2") | F.col("name").endswith("input_scale")) & (kind == "float32"), "SCALE_GLOBAL", "heuristic", "*scale"))
    said.append(Rule(F.col("name").endswith("_blocks") & F.array_contains("_siblings", F.lit("_scales")) & (kind == "uint8"), "PACKED_VALUES", "heuristic", "*_blocks"))
    return said


def classify(tensors: DataFrame, flags: dict[str, str] | list[str] | None = None, config: str | None = None, quant: str | None = None, heuristic: bool = True, custom: list[Rule] | None = None) -> DataFrame:
    """Adds role, and role_source and role_pattern, which say why.  The first rule that says something wins: explicit flags,
    rules of a config, a quantization config, custom ones, then names, types and siblings; else STANDARD.

    Siblings are found by one aggregate over (module, ending): the module is the name without its ending."""
    rules = explicit_rules(flags or {}) + (config_rules(config) if config else []) + (quant_rules(quant) if quant else []) + (custom or []) + (heuristic_rules() if heuristic else [])
    end = F.lit("")
    for e in reversed(ENDS):
        end = F.when(F.col("name").endswith(e), F.lit(e)).otherwise(end)
    own = tensors.withColumn("_end", end).withColumn("_module", F.expr("substring(name, 1, length(name) - length(_end))"))
    siblings = own.where("_end <> ''").groupBy("_module").agg(F.collect_set("_end").alias("_siblings"))
    got = own.join(siblings, "_module", "left").withColumn("_siblings", F.coalesce("_siblings", F.array().cast("array<string>")))
    said = F.coalesce(*(F.when(r.when, F.struct(F.lit(r.role).alias("role"), F.lit(r.source).alias("source"), F.lit(r.pattern).alias("pattern"))) for r in rules), F.struct(F.lit("STANDARD").alias("role"), F.lit("default").alias("source"), F.lit("").alias("pattern")))
    return got.withColumn("_said", said).select(*tensors.columns, F.col("_said.role").alias("role"), F.col("_said.source").alias("role_source"), F.col("_said.pattern").alias("role_pattern"))


def audit(classified: DataFrame) -> DataFrame:
    """(name, role, source, pattern) of what was classified other than by default."""
    return classified.where("role_source <> 'default'").select("name", "role", F.col("role_source").alias("source"), F.col("role_pattern").alias("pattern"))


def plan_shards(sized: DataFrame, most: int) -> DataFrame:
    """Adds shard: names in write order fill shards up to `most` bytes; a larger tensor has a shard of its own.

    The sum starts anew at each shard, so the (small) metadata of one model is walked in order in one group."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("write_seq")
        shard, size, out = 0, 0, []
        for n in pdf["nbytes"]:
            if size and size + n > most:
                shard, size = shard + 1, 0
            out.append(shard)
            size += n
        return pdf.assign(shard=out)

    return sized.select("model", "name", "write_seq", "nbytes").groupBy("model").applyInPandas(walk, "model string, name string, write_seq int, nbytes long, shard int")


def policy(trusted: DataFrame, extra: DataFrame, ignored: DataFrame) -> DataFrame:
    """trusted and extra without ignored."""
    return trusted.unionByName(extra).distinct().join(ignored, trusted.columns, "left_anti")


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): only_a, only_b or common."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("common")
    return x.join(y, key, "full").select(key, side.alias("side"))
