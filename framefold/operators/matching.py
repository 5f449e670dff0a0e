"""Runs checked against expectations, recordings joined to games, and choices of the best candidate with a margin."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framefold.operators.joins import as_of, matches_within

#: Candidates kept, those kept of one place, and how near one place is.
MOST_CANDIDATES, MOST_NEAR, NEAR = 6, 2, 40.0


def verify_runs(got: DataFrame, expected: DataFrame, key: str, order: str, fields: list[str], slack: int = 3) -> DataFrame:
    """Per key and field: rows paired by position, mismatches, and those that `slack` positions either way don't forgive."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    a = got.select(key, place.alias("place"), *(F.col(f).alias(f"a_{f}") for f in fields))
    b = expected.select(key, place.alias("place"), *(F.col(f).alias(f"b_{f}") for f in fields))
    paired, found = a.join(b, [key, "place"]), []
    for f in fields:
        paired = matches_within(paired, f, slack, key, "place").withColumnRenamed("near", f"near_{f}")
        differs = ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))
        found.append(F.struct(F.lit(f).alias("field"), differs.cast("long").alias("differs"), (~F.col(f"near_{f}")).cast("long").alias("wrong")))
    rows = paired.select(key, F.explode(F.array(*found)).alias("r")).select(key, "r.*")
    return rows.groupBy(key, "field").agg(F.count("*").alias("paired"), F.sum("differs").alias("differs"), F.sum("wrong").alias("wrong"))


def recording_games(recordings: DataFrame, games: DataFrame, station: str = "station") -> DataFrame:
    """Each recording (station, started, ended) with the game announced last until it ended.

    That is the last one announced while it ran or, without one, the last before.
    """
    found = as_of(recordings.withColumnRenamed("ended", "__at"), games.select(station, F.col("announced_at").alias("__at"), "game_id"), station, "__at", "game_id")
    return found.withColumnRenamed("__at", "ended")


def best_of_kinds(scored: DataFrame, key: str, kind: str, place: str, score: str) -> DataFrame:
    """(key, kind, score, margin): the best candidate, later ones first among equals, and how far the best of other kinds is; the score itself without others."""
    of_kind = scored.groupBy(key, kind).agg(F.max(F.struct(F.col(score).alias("s"), F.col(place).alias("p"))).alias("top"))
    tops = of_kind.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("top.s").alias("s"), F.col("top.p").alias("p"), F.col(kind).alias("k"))), asc=False).alias("tops"))
    best, other = F.get("tops", F.lit(0)), F.get("tops", F.lit(1))
    return tops.select(key, best["k"].alias(kind), best["s"].alias("score"), F.coalesce(best["s"] - other["s"], best["s"]).alias("margin"))


def first_peak(responses: DataFrame, key: str, y: str, x: str, value: str) -> DataFrame:
    """(key, y, x, value): the greatest response, the first one row by row among equals."""
    best = F.min_by(F.struct(y, x, value), F.struct(-F.col(value), F.col(y), F.col(x)))
    return responses.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def near_candidates(candidates: DataFrame, key: str = "image_id") -> DataFrame:
    """The best candidates (key, x, y, score) of each image: at most MOST_NEAR around one place, MOST_CANDIDATES in all.

    Candidates are taken by falling score, equal ones in order of `nth`; each joins the first place that it is near to,
    or makes a new one. An image has few candidates, so they are chosen on one task.
    """

    def choose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["score"], r["nth"]))
        places: list[list[float]] = []
        kept = []
        for r in rows:
            own = next((p for p in places if abs(r["x"] - p[0]) < NEAR and abs(r["y"] - p[1]) < NEAR), None)
            if own is None:
                own = [r["x"], r["y"], 0]
                places.append(own)
            own[2] += 1
            if own[2] <= MOST_NEAR:
                kept.append(r)
        kept = kept[:MOST_CANDIDATES]
        return pa.Table.from_pylist([r | {"place": k} for k, r in enumerate(kept, 1)], schema=table.schema.append(pa.field("place", pa.int32())))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema)
    return candidates.groupBy(key).applyInArrow(choose, f"{schema}, place int")
