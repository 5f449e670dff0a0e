"""Text, time, array, map and JSON rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefold.functions.rules import PIECES

#: Schemes of live streams, prefixes of devices, and classes of upload answers.
STREAM_SCHEMES = ("rtsp://", "rtsps://", "rtmp://", "http://", "https://", "tcp://", "udp://", "srt://")
DONE, DROPPED = (200, 299), (400, 409, 413, 422)


def size_of(text: Column) -> Column:
    """(w, h) of `WxH`; null for anything else."""
    parts = r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$"
    number = lambda k: F.regexp_extract(text, parts, k).cast("long")
    return F.when(text.rlike(parts), F.struct(number(1).alias("w"), number(2).alias("h")))


def percent(text: Column) -> Column:
    """The number before the first per cent sign, as a share of one; null without."""
    found = F.regexp_extract(text, r"^[^%]*?([0-9]*\.?[0-9]+|[0-9]+\.)\s*%", 1)
    return F.when(found != "", found.cast("double") / 100)


def safe_token(text: Column) -> Column:
    """Up to 40 letters, digits and . - + _, the first not a point."""
    return F.coalesce(text.rlike(r"\A[A-Za-z0-9+_-][A-Za-z0-9.+_-]{0,39}\z"), F.lit(False))


def topic(base: Column, suffix: Column) -> Column:
    return F.concat(base, F.lit("/"), suffix)


def allowed(key: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a dotted key is one of the patterns, or longer than one that ends in a point."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | (key.startswith(p) & (F.length(key) > len(p)) if p.endswith(".") else key == p)
    return F.coalesce(fits, F.lit(False))


def input_kind(text: Column) -> Column:
    """What an input's name stands for: a device, a live stream or a file."""
    live = F.greatest(*((F.lower(F.substring(text, 1, len(s))) == s) & (F.length(text) > len(s)) for s in STREAM_SCHEMES))
    return F.when(text.startswith("dshow:"), "directshow").when(text.startswith("v4l2:"), "v4l2").when(live, "stream").otherwise("file")


def upload_outcome(status: Column) -> Column:
    """What an upload's HTTP status means for its job: done, drop, or retry for all others."""
    return F.when(status.between(*DONE), "done").when(status.isin(*DROPPED), "drop").otherwise("retry")


def checksums(files: DataFrame, text: str) -> DataFrame:
    """(name, sha256) of lines `hash name`; lines without a hash of 64 hex digits are skipped, the last of a name counts."""
    lines = files.select(F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    kept = lines.select("at", F.split(F.trim("line"), r"\s+", 2).alias("p")).where(F.col("p")[0].rlike(r"\A[0-9A-Fa-f]{64}\z") & (F.size("p") == 2))
    name = F.regexp_replace(F.trim(F.col("p")[1]), r"\A\*+", "")
    return kept.groupBy(name.alias("name")).agg(F.lower(F.max_by(F.col("p")[0], "at")).alias("sha256"))


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


# Times


def stamp(ts: Column) -> Column:
    """RFC 3339 in the session's zone, to the millisecond."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def game_id(station: Column, ts: Column) -> Column:
    return F.concat(station, F.lit("-"), F.unix_millis(ts).cast("string"))


def part_name(ts: Column, number: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMdd-HHmmss"), F.format_string("_g%03d", number))


def clock_ms(ts: Column, start: Column) -> Column:
    return F.round(F.greatest(ts - start, F.lit(0.0)) * 1000).cast("long")


# Boards and arrays


def flat_field(grid: Column, most: int = 3) -> Column:
    """A board's rows as one array of cells, at most `most` each."""
    return F.transform(F.flatten(grid), lambda c: F.least(c, F.lit(most)))


def grid_of(field: Column, columns: int = 10) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(field) - 1) / columns).cast("int")), lambda r: F.slice(field, r * columns + 1, columns))


def digit_rows(grid: Column) -> Column:
    """Each row of a board as a string of digits."""
    return F.transform(grid, lambda row: F.array_join(F.transform(row, lambda c: F.least(c, F.lit(9)).cast("string")), ""))


def without_cells(field: Column, cells: Column) -> Column:
    """A flat board with the cells at these places emptied."""
    return F.transform(field, lambda c, k: F.when(F.array_contains(cells, k), F.lit(0)).otherwise(c))


def uniform_colour(field: Column, cells: Column) -> Column:
    """A flat board whose cells at these places all take the colour that over half of them have; unchanged without one."""
    colours = F.filter(F.transform(cells, lambda k: F.get(field, k)), lambda c: c > 0)
    votes = lambda id_: F.size(F.filter(colours, lambda c: c == id_))
    major = F.coalesce(*(F.when(2 * votes(k) > F.size(cells), F.lit(k)) for k in (1, 2, 3)))
    return F.when(major.isNull(), field).otherwise(F.transform(field, lambda c, k: F.when(F.array_contains(cells, k), major).otherwise(c)))


def placed(cells: Column) -> Column:
    """A footprint (array of r, c) moved to the corner, its cells in order: equal for equal shapes."""
    low = lambda name: F.array_min(F.transform(cells, lambda p: p[name]))
    return F.array_sort(F.transform(cells, lambda p: F.struct((p["r"] - low("r")).alias("r"), (p["c"] - low("c")).alias("c"))))


def turned(cells: Column) -> Column:
    """A footprint after a quarter turn."""
    return placed(F.transform(cells, lambda p: F.struct(p["c"].alias("r"), (-p["r"]).alias("c"))))


def piece_count(counts: Column, piece: str) -> Column:
    """One piece's number from counts in the order of pieces, or from a map by letter."""
    return F.get(counts, F.lit(PIECES.index(piece)))


def piece_of(counts: Column, piece: Column) -> Column:
    return F.try_element_at(counts, piece)


# JSON


def same_at(a: Column, b: Column, path: str) -> Column:
    """Whether two JSON texts have the same value at a path; both may lack it."""
    return F.get_json_object(a, path).eqNullSafe(F.get_json_object(b, path))


def close(a: Column, b: Column, relative: float = 1e-9) -> Column:
    """Whether two numbers are equal but for rounding; nulls equal nulls."""
    return F.coalesce(F.abs(a - b) <= relative * F.greatest(F.abs(b), F.lit(1.0)), a.isNull() & b.isNull())
