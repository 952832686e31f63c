"""Probe files and tables of triggers, windows and dead zones."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("total_nb_channels", "channel_groups", "radius")  # fixed values: the names a probe file must set


def parse_probe(text: str) -> dict:
    """The assignments of a probe file, literals only: nothing in it is run."""
    found = {}
    for node in ast.parse(text).body:
        if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
            found[node.targets[0].id] = _literal(node.value)
    missing = [k for k in REQUIRED if k not in found]
    if missing:
        raise ValueError(f"the probe file lacks {', '.join(missing)}")
    return found


def _literal(node: ast.expr):
    """Literals, and list(range(...)) or range(...) of literals."""
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("list", "range"):
        args = [_literal(a) for a in node.args]
        return list(args[0]) if node.func.id == "list" else list(range(*args))
    if isinstance(node, ast.Dict):
        return {_literal(k): _literal(v) for k, v in zip(node.keys, node.values, strict=True)}
    return ast.literal_eval(node)


def probe_table(spark: SparkSession, text: str) -> DataFrame:
    """(grp, channel, x, y, z); missing coordinates are 0. A channel that the recording has not, a negative one too, is an error."""
    rows, parse = [], parse_probe(text)
    for group, spec in parse["channel_groups"].items():
        for channel in spec["channels"]:
            if int(channel) < 0 or int(channel) >= int(parse["total_nb_channels"]):
                raise ValueError(f"channel {channel} is not one of the recording's")
            rows.append((str(group), int(channel), *(float(v) for v in (*spec["geometry"][channel], 0, 0)[:3])))
    return spark.createDataFrame(rows, "grp string, channel int, x double, y double, z double")


def time_table(spark: SparkSession, path: str, names: tuple[str, str], rate: float | None = None) -> DataFrame:
    """Two numbers a line, blank lines and comments (# and //) left out; with a ``rate`` per second, times in ms become steps."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"(#|//).*", "")).alias("v")).where("v <> ''")
    parts = F.split("v", r"[\s,]+")
    scale = 1.0 if rate is None else rate / 1000
    return lines.select(*((F.get(parts, i).cast("double") * (scale if n in ("t", "start", "stop", "tau") else 1)).cast("long").alias(n) for i, n in enumerate(names)))


def natural_key(name: str) -> list:
    """Sorts file names by the numbers in them."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def clipped(tables: list[tuple[DataFrame, int, int]], names: tuple[str, ...] = ("start", "stop")) -> DataFrame:
    """Times of several streams on one clock: each table's times, counted from its stream's start, are moved by that start; those beyond
    the stream's length are cut off, and rows that lie wholly outside go. tables: (table, stream's start, its length)."""
    parts = []
    for table, start, length in tables:
        inside = table.where((F.col(names[-1]) > 0) & (F.col(names[0]) < length)) if len(names) > 1 else table.where(F.col(names[0]).between(0, length - 1))
        parts.append(inside.withColumns({n: F.least(F.greatest(F.col(n), F.lit(0)), F.lit(length)) + start for n in names}))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def mapping_file(text: str) -> list[str]:
    """The files of a recording in the order in which a mapping file lists them, one a line, comments (# and //) left out."""
    lines = (re.sub(r"(#|//).*", "", line).strip() for line in text.splitlines())
    return [line.split()[0] for line in lines if line]


def batch_list(text: str) -> list[tuple[str, dict[str, str]]]:
    """(file, options) of each line of a list of recordings: a path and name=value pairs."""
    out = []
    for line in text.splitlines():
        parts = re.sub(r"#.*", "", line).split()
        if parts:
            out.append((parts[0], dict(p.split("=", 1) for p in parts[1:])))
    return out


def header_time(text: str):
    """The time in a recorder's header, such as ``(m/d/y): 6/24/2019 (h:m:s.ms) 16:40:4.328`` or ``2019/06/24 16:40:04``; None if there is none."""
    from datetime import datetime

    m = re.search(r"(\d{1,4})/(\d{1,2})/(\d{1,4})\D+?(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d+))?", re.sub(r"\([^)]*\)", "", text))
    if not m:
        return None
    a, b, c, hour, minute, second = map(int, m.groups()[:6])
    year, month, day = (a, b, c) if len(m.group(1)) == 4 else (c, a, b)
    return datetime(year, month, day, hour, minute, second, int((m.group(7) or "0").ljust(6, "0")[:6]))
