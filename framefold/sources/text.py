"""Text readers and writers: output frames as JSON lines, label tables, reader messages, layered settings."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(frames: DataFrame, path: str) -> None:
    """One compact JSON object a line, fields in order and nulls kept."""
    frames.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Frames of a fixed schema; blank lines are skipped and a bad one fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(segment, start_s, end_s, states, margin_s) of lines `start end state[|state] [margin]`; # begins a comment, * isn't scored, the margin is 0.3 by default."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("segment", "line"))
    parts = F.split(F.trim(F.regexp_replace("line", "#.*", "")), r"\s+")
    kept = lines.withColumn("p", parts).where(F.size("p") >= 3)
    return kept.select(F.col("segment").cast("long").alias("segment"), F.col("p")[0].cast("double").alias("start_s"), F.col("p")[1].cast("double").alias("end_s"), F.split(F.col("p")[2], r"\|").alias("states"), F.coalesce(F.get("p", F.lit(3)).cast("double"), F.lit(0.3)).alias("margin_s"))


def reader_message(line: Column) -> Column:
    """A card reader's line as (kind, uid, name): null for what isn't a JSON object or has an unknown type."""
    m = F.from_json(line, "type string, uid string, name string, protocol int")
    known = line.startswith("{") & m["type"].isin("hello", "present", "removed", "status")
    return F.when(known, F.struct(m["type"].alias("kind"), F.upper(F.trim(m["uid"])).alias("uid"), F.nullif(F.trim(m["name"]), F.lit("")).alias("name"), m["protocol"].alias("protocol")))


class UnknownSetting(KeyError):
    """A dotted path that the defaults don't have."""


def layered(defaults: dict[str, Any], *layers: dict[str, Any]) -> dict[str, Any]:
    """Defaults with layers over them, each a tree or dotted paths; raises UnknownSetting for what the defaults lack."""
    out = json.loads(json.dumps(defaults))
    for layer in layers:
        for path, value in leaves(layer):
            keys, at = path.split("."), out
            for k in keys[:-1]:
                if not isinstance(at.get(k), dict):
                    raise UnknownSetting(path)
                at = at[k]
            if keys[-1] not in at:
                raise UnknownSetting(path)
            at[keys[-1]] = value
    return out


def leaves(tree: dict[str, Any], before: str = "") -> list[tuple[str, Any]]:
    """(dotted path, value) of every leaf."""
    found: list[tuple[str, Any]] = []
    for key, value in tree.items():
        path = f"{before}.{key}" if before else key
        found += leaves(value, path) if isinstance(value, dict) and value else [(path, value)]
    return found


def environment_layer(environment: dict[str, str], prefix: str) -> dict[str, Any]:
    """PREFIX_A__B=1 as the path a.b; values are JSON where they can be."""
    out: dict[str, Any] = {}
    for name, value in environment.items():
        if m := re.fullmatch(f"{re.escape(prefix)}_(.+)", name):
            try:
                out[m[1].lower().replace("__", ".")] = json.loads(value)
            except ValueError:
                out[m[1].lower().replace("__", ".")] = value
    return out


def event_rows(frames: DataFrame, keep: int = 300) -> DataFrame:
    """The newest events as `m:ss.s field reason -> new` lines."""
    e = F.from_json("events", "array<struct<field:string,reason:string,severity:string,old:string,new:string>>")
    rows = frames.select("stream_id", "seq", "ts", F.posexplode(e).alias("nth", "e"))
    clock = F.concat(F.floor(F.col("ts") / 60).cast("string"), F.lit(":"), F.format_string("%04.1f", F.col("ts") % 60))
    line = F.concat_ws(" ", clock, "e.field", "e.reason", F.when(F.col("e.new").isNotNull(), F.concat(F.lit("-> "), F.col("e.new"))))
    return rows.orderBy(F.desc("ts"), F.desc("seq"), F.desc("nth")).limit(keep).select("stream_id", "seq", line.alias("line"), (F.col("e.reason") == "tetris").alias("gold"))
