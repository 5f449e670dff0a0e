"""Game recordings: concatenated fixed-size records of three versions, plain or gzip.

A record is a row of big-endian bit fields, most significant first. The layouts below are the format; encoding and
decoding both follow them, for all records of a file at once. A value of all ones stands for null.
"""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.operators.joins import as_of

from framefold.functions.rules import PIECES

HEAD = (("version", 3), ("game_type", 2), ("player_num", 3), ("gameid", 16), ("ctime_ms", 28))
HANDS = (("instant_das", 5), ("preview", 3), ("cur_piece_das", 5), ("cur_piece", 3))
#: By version, the fields and their bits; names with _ are padding.
LAYOUTS = {
    1: (*HEAD, ("_", 8), ("score", 21), ("lines", 9), ("level", 6), *HANDS, *((f"count_{k}", 8) for k in range(7)), *((f"cell_{k}", 2) for k in range(200))),
    2: (*HEAD, ("lines", 12), ("level", 8), ("score", 24), *HANDS, *((f"count_{k}", 9) for k in range(7)), ("_", 1), *((f"cell_{k}", 2) for k in range(200))),
    3: (*HEAD, ("lines", 12), ("level", 8), ("score", 24), *HANDS, *((f"count_{k}", 10) for k in range(7)), ("_", 2), *((f"cell_{k}", 2) for k in range(200))),
}
SIZES = {v: sum(bits for _, bits in layout) // 8 for v, layout in LAYOUTS.items()}
NULLABLE = ("score", "lines", "level", "instant_das", "cur_piece_das", *(f"count_{k}" for k in range(7)))
GZIP = b"\x1f\x8b"
RECORD = "version int, game_type int, player_num int, gameid int, ctime_ms long, lines int, level int, score long, instant_das int, preview string, cur_piece_das int, cur_piece string, counts array<int>, field array<int>"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


class BadRecording(ValueError):
    """An unknown version, or bytes that end inside a record."""


def split_records(data: bytes) -> list[tuple[int, bytes]]:
    """(version, bytes) of each record."""
    data, at, found = gzip.decompress(data) if data[:2] == GZIP else data, 0, []
    while at < len(data):
        version = data[at] >> 5
        size = SIZES.get(version)
        if size is None:
            raise BadRecording(f"unknown version {version} at byte {at}")
        if at + size > len(data):
            raise BadRecording(f"a record of {size} bytes ends after {len(data) - at}")
        found.append((version, data[at : at + size]))
        at += size
    return found


def decode(data: bytes) -> list[dict]:
    """All records of a file in order; raises BadRecording for what isn't one."""
    records = split_records(data)
    out: list[dict | None] = [None] * len(records)
    for version in sorted({v for v, _ in records}):
        own = [k for k, (v, _) in enumerate(records) if v == version]
        bits = np.unpackbits(np.frombuffer(b"".join(records[k][1] for k in own), dtype=np.uint8).reshape(len(own), -1), axis=1).astype(np.int64)
        values, at = {}, 0
        for name, width in LAYOUTS[version]:
            raw = bits[:, at : at + width] @ (1 << np.arange(width - 1, -1, -1))
            at += width
            values[name] = [None if x == (1 << width) - 1 else int(x) for x in raw] if name in NULLABLE else raw.tolist()
        for n, k in enumerate(own):
            row = {c: values[c][n] for c in COLUMNS if c in values}
            for name in ("preview", "cur_piece"):
                row[name] = PIECES[row[name]] if row[name] < len(PIECES) else None
            row["counts"] = [values[f"count_{i}"][n] for i in range(7)]
            row["field"] = [values[f"cell_{i}"][n] for i in range(200)]
            out[k] = row
    return out


def encode(rows: list[dict]) -> bytes:
    """Version 3 records; too large values become the largest that isn't null."""
    columns = []
    for name, width in LAYOUTS[3]:
        top = (1 << width) - 1
        if name == "_":
            raw = [0] * len(rows)
        elif name == "version":
            raw = [3] * len(rows)
        elif name.startswith("count_"):
            raw = [r["counts"][int(name[6:])] for r in rows]
        elif name.startswith("cell_"):
            raw = [int(r["field"][int(name[5:])]) & 3 for r in rows]
        elif name in ("preview", "cur_piece"):
            raw = [PIECES.index(r[name]) if r[name] in PIECES else top for r in rows]
        elif name in ("game_type", "player_num", "gameid"):
            raw = [int(r[name]) & top for r in rows]
        else:
            raw = [r[name] for r in rows]
        if name in NULLABLE:
            raw = [top if x is None or x != x else min(int(x), top - 1 if name != "level" else top) for x in raw]
        elif name == "ctime_ms":
            raw = [min(int(x), top) for x in raw]
        columns.append(np.array(raw, dtype=np.int64).reshape(-1, 1) >> np.arange(width - 1, -1, -1) & 1)
    return np.packbits(np.concatenate(columns, axis=1).astype(np.uint8), axis=1).tobytes() if rows else b""


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, record columns) of all records of the files; a bad file fails the query with its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("idx", pa.int64()), *((c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}.get(c.split()[1], pa.list_(pa.int32()))) for c in RECORD.split(", "))])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = decode(content)
                except BadRecording as e:
                    raise BadRecording(f"{name}: {e}") from e
                yield pa.RecordBatch.from_pylist([{"path": name, "idx": k, **r} for k, r in enumerate(rows)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, idx long, {RECORD}")


def encoded_games(frames: DataFrame, key: str = "game_key", order: str = "ctime_ms") -> DataFrame:
    """(key, frames, recording): each game's records in order as one recording, gzipped."""
    kind = frames.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(order, kind="stable").to_dict("records")
        return pd.DataFrame({key: [frame[key].iloc[0]], "frames": [len(rows)], "recording": [gzip.compress(encode(rows), mtime=0)]})

    return frames.groupBy(key).applyInPandas(run, f"{key} {kind}, frames long, recording binary")


def decoded_games(recordings: DataFrame, key: str = "game_key") -> DataFrame:
    """(key, idx, record columns) of recordings that are held in a column."""
    kind = recordings.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame[key], frame["recording"], strict=True):
                rows = decode(bytes(content))
                out = pd.DataFrame([{key: name, "idx": k, **r} for k, r in enumerate(rows)], columns=[key, "idx", *COLUMNS], dtype=object)
                yield out

    return recordings.select(key, "recording").mapInPandas(run, f"{key} {kind}, idx long, {RECORD}")


def write_recordings(recordings: DataFrame, folder: str, key: str = "game_key", least_frames: int = 60) -> None:
    """One file for each game of enough frames, in a folder that all machines share: written apart, then renamed, so a retry leaves one whole file."""

    def run(rows: Iterator) -> None:
        for row in rows:
            part = os.path.join(folder, f".{uuid.uuid4().hex}.ngf.part")
            with open(part, "wb") as f:
                f.write(bytes(row["recording"]))
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, os.path.join(folder, f"{row[key]}.ngf.gz"))

    os.makedirs(folder, exist_ok=True)
    recordings.where(F.col("frames") >= least_frames).foreachPartition(run)


def replay_seek(records: DataFrame, times: DataFrame, key: str = "path") -> DataFrame:
    """For each (key, at_ms) the last record at or before it; the first record before all; the later among equals."""
    found = as_of(times.select(key, F.col("at_ms").cast("long").alias("at_ms")), records.select(key, F.col("ctime_ms").cast("long").alias("at_ms"), F.col("idx").cast("long").alias("idx")), key, "at_ms", "idx")
    return found.select(key, "at_ms", F.coalesce("idx", F.lit(0)).alias("idx"))
