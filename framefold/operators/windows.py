"""Ordered operators that are windows over one stream: votes, clocks, droughts, debouncing, runs, holds and changes.

All take frames keyed by stream_id and ordered by seq (ts in seconds), and shuffle once on the stream. Nulls are
unreadable values and never equal anything but themselves in runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framefold.functions.rules import missing_in_gap

KEY, ORDER = "stream_id", "seq"


def ordered(*more: str) -> Window:
    return Window.partitionBy(KEY, *more).orderBy(ORDER)


def running(*more: str) -> Window:
    return ordered(*more).rowsBetween(Window.unboundedPreceding, 0)


def last_known(value: Column, window: Window | None = None) -> Column:
    return F.last(value, ignorenulls=True).over(window or running())


def weighted_vote(value: Column, weight: Column, rows: int, newest_wins: bool = False) -> tuple[Column, Column]:
    """The value with the greatest weight sum among the last rows, and the mean weight of its votes.

    Nulls don't vote. Ties, to nine digits, go to the value first seen in the window, or to the newest.
    """
    ballots = F.collect_list(F.when(value.isNotNull(), F.struct(value.alias("v"), weight.alias("w")))).over(ordered().rowsBetween(1 - rows, 0))
    cast = F.reverse(ballots) if newest_wins else ballots
    scored = F.transform(F.array_distinct(F.transform(cast, lambda b: b["v"])), lambda v: F.struct(F.round(F.aggregate(F.filter(cast, lambda b: b["v"] == v), F.lit(0.0), lambda s, b: s + b["w"]), 9).alias("sum"), F.size(F.filter(cast, lambda b: b["v"] == v)).alias("n"), v.alias("v")))
    best = F.array_max(F.transform(scored, lambda s: s["sum"]))
    winner = F.element_at(F.filter(scored, lambda s: s["sum"] == best), 1)
    return F.when(F.size(scored) > 0, winner["v"]), F.when(F.size(scored) > 0, winner["sum"] / winner["n"])


def vote_state(frames: DataFrame, rows: int = 5) -> DataFrame:
    """fused_state: the vote of the last readings without `unknown`; where all are unknown, the state before."""
    known = F.when(F.col("state") != "unknown", F.col("state"))
    state, confidence = weighted_vote(known, F.col("conf"), rows)
    voted = frames.withColumn("vote", state).withColumn("vote_confidence", confidence)
    return voted.withColumn("fused_state", F.coalesce(last_known(F.col("vote")), F.lit("unknown")))


def cell_vote(frames: DataFrame, value: str, rows: int = 5) -> DataFrame:
    """cell: the vote of the last readings where ambiguous ones weigh 0.4; ties go to the newest."""
    weight = F.when(F.col("conf") >= 0.5, 1.0).otherwise(0.4)
    cell, _ = weighted_vote(F.col(value), weight, rows, newest_wins=True)
    return frames.withColumn("cell", cell)


def active_clock(frames: DataFrame, cap: float) -> DataFrame:
    """active_seconds: the running sum of steps between frames of play, each at most `cap`."""
    played = frames.where(F.col("state") == "in_game")
    step = F.col("ts") - F.lag("ts").over(ordered())
    return played.withColumn("step", F.when(step > 0, F.least(step, F.lit(cap))).otherwise(0.0)).withColumn("active_seconds", F.sum("step").over(running()))


def spawns(frames: DataFrame) -> DataFrame:
    """A row at each change of the next piece among known pieces: the piece before has come into play."""
    known = frames.where(F.col("piece").isNotNull())
    before = F.lag("piece").over(ordered())
    return known.withColumn("spawned", before).where(F.col("spawned").isNotNull() & (F.col("piece") != F.col("spawned")))


def droughts(spawned: DataFrame, piece: str = "I") -> DataFrame:
    """n, the spawns so far, and drought, the spawns since the last one of the piece."""
    n = F.row_number().over(ordered())
    counted = spawned.withColumn("n", n.cast("long"))
    hit = F.when(F.col("spawned") == piece, F.col("n"))
    return counted.withColumn("drought", F.col("n") - F.coalesce(F.max(hit).over(running()), F.lit(0)))


def ended_droughts(spawned: DataFrame, piece: str = "I", flag: int = 13) -> DataFrame:
    """Per stream: the last ended drought's length, how many ended at `flag` or over, and the longest."""
    d = droughts(spawned, piece).withColumn("before", F.lag("drought", 1, 0).over(ordered()))
    ended = F.when(F.col("spawned") == piece, F.col("before"))
    return d.groupBy(KEY).agg(F.max_by(ended, F.when(ended.isNotNull(), F.col("n"))).alias("last_ended"), F.sum(F.when(ended >= flag, 1).otherwise(0)).alias("ended_flagged"), F.max("drought").alias("max_drought"))


def runs(frames: DataFrame, key: str) -> DataFrame:
    """Runs of equal values: (start_seq, end_seq, start_ts, end_ts, value, n); nulls are equal to nulls."""
    changed = ~F.col(key).eqNullSafe(F.lag(key).over(ordered())) | F.lag(ORDER).over(ordered()).isNull()
    marked = frames.withColumn("run", F.sum(changed.cast("long")).over(running()))
    return marked.groupBy(KEY, "run").agg(F.min(ORDER).alias("start_seq"), F.max(ORDER).alias("end_seq"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.first(key).alias("value"), F.count("*").alias("n"))


def settle(frames: DataFrame, value: str, need: int) -> DataFrame:
    """settled: the last value that was read `need` times in a row; nulls neither count nor break a row."""
    known = frames.where(F.col(value).isNotNull())
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(ordered()))
    run = F.sum(changed.cast("long")).over(running())
    counted = known.withColumn("run", run).withColumn("nth", F.row_number().over(ordered("run")))
    firm = counted.select(KEY, ORDER, F.when(F.col("nth") >= need, F.col(value)).alias("firm"))
    return frames.join(firm, [KEY, ORDER], "left").withColumn("settled", last_known(F.col("firm"))).drop("firm")


def schmitt(frames: DataFrame, signal: str, on: float = 1.0, off: float = 0.7) -> DataFrame:
    """high: on above `on`, off at `off` and below, held between; off before any signal."""
    edge = F.when(F.col(signal) > on, True).when(F.col(signal) <= off, False)
    return frames.withColumn("high", F.coalesce(last_known(edge), F.lit(False)))


def hold_with_decay(frames: DataFrame, value: str, decay: float = 0.9, floor: float = 0.4) -> DataFrame:
    """held and held_confidence: the last reading of confidence `floor` or more, fading by `decay` a frame; null below."""
    fresh = F.col(value).isNotNull() & (F.col("conf") >= floor)
    age = F.col(ORDER) - last_known(F.when(fresh, F.col(ORDER)))
    confidence = last_known(F.when(fresh, F.col("conf"))) * F.pow(F.lit(decay), age)
    held = frames.withColumn("held_confidence", confidence).withColumn("held", last_known(F.when(fresh, F.col(value))))
    return held.withColumn("held", F.when(F.col("held_confidence") >= floor, F.col("held")))


def running_max(frames: DataFrame, value: str) -> DataFrame:
    return frames.withColumn("most", F.max(value).over(running()))


def streak(frames: DataFrame, condition: Column, need: int) -> DataFrame:
    """streak: the rows in a row that meet the condition; confirmed: `need` of them and more."""
    breaks = F.sum(F.when(F.coalesce(condition, F.lit(False)), 0).otherwise(1)).over(running())
    counted = frames.withColumn("part", breaks)
    count = F.sum(F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)).over(running("part"))
    return counted.withColumn("streak", count).drop("part").withColumn("confirmed", F.col("streak") >= need)


def source_gaps(frames: DataFrame, fps: float) -> DataFrame:
    """missing: the frames that the clock gap before a frame lacks."""
    gap = F.col("ts") - F.lag("ts").over(ordered())
    return frames.withColumn("missing", F.when(gap.isNull(), F.lit(0).cast("long")).otherwise(missing_in_gap(gap, F.lit(fps))))


def changes(frames: DataFrame, key: Column) -> DataFrame:
    """The frames whose key differs from the frame before, numbered from 0."""
    changed = frames.withColumn("before_key", F.lag(key).over(ordered())).withColumn("first_row", F.lag(ORDER).over(ordered()).isNull())
    kept = changed.where(F.col("first_row") | ~key.eqNullSafe(F.col("before_key")))
    return kept.drop("before_key", "first_row").withColumn("out_seq", (F.row_number().over(ordered()) - 1).cast("long"))


def first_last(frames: DataFrame, value: str) -> DataFrame:
    """Per stream the first known value and the last known one in play."""
    order = F.struct(F.col(ORDER))
    played = F.when((F.col("state") == "in_game") & F.col(value).isNotNull(), order)
    return frames.groupBy(KEY).agg(F.min_by(value, F.when(F.col(value).isNotNull(), order)).alias("first_value"), F.max_by(value, played).alias("last_value"))


def session_ends(frames: DataFrame, over: str = "level_select") -> DataFrame:
    """A row where play gives way to `over`: with the values of the last frame of play."""
    playing = F.col("state") == "in_game"
    before = F.lag("state").over(ordered())
    held = {c: last_known(F.when(playing, F.col(c))) for c in ("score", "lines", "seq")}
    ended = frames.withColumn("before_state", before).withColumns({f"end_{c}": held[c] for c in held})
    return ended.where(F.col("before_state").isin("in_game", "paused") & (F.col("state") == over))


def line_deltas(frames: DataFrame, most: int = 8) -> DataFrame:
    """Line steps against the last known count: d_lines, d_score, and whether the step counts (1 to `most`)."""
    known = frames.where(F.col("lines").isNotNull() & (F.col("state") == "in_game"))
    stepped = known.withColumn("d_lines", F.col("lines") - F.lag("lines").over(ordered())).withColumn("d_score", F.col("score") - F.lag("score").over(ordered()))
    return stepped.where(F.col("d_lines") > 0).withColumn("counts", F.col("d_lines") <= most)


def stack_commit(frames: DataFrame, occupancy: str) -> DataFrame:
    """stack: at each change of the next piece the occupancy of the frame before is taken as the settled stack."""
    spawn = F.col("piece").isNotNull() & (F.lag("piece").over(ordered()) != F.col("piece")) & (F.col("state") == "in_game")
    return frames.withColumn("taken", F.when(spawn, F.lag(occupancy).over(ordered()))).withColumn("stack", last_known(F.col("taken"))).drop("taken")


def presence(cards: DataFrame) -> DataFrame:
    """Card events (stream_id, seq, kind, uid): the card present after each event, and the last one seen."""
    placed = F.when(F.col("kind") == "present", F.struct("uid")).when(F.col("kind").isin("removed", "disconnect"), F.struct(F.lit(None).cast("string").alias("uid")))
    return cards.withColumn("present_uid", F.last(placed, ignorenulls=True).over(running())["uid"]).withColumn("last_seen", last_known(F.when(F.col("kind") == "present", F.col("uid"))))
