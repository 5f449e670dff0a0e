"""Pairings: runs by position with slack, labelled segments, as-of lookups, templates, footprints and attributions."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framefold.functions.rules import SCORE_SLACK, compositions

#: A segment table of at most so many rows is broadcast; a larger one is joined by its buckets.
BROADCAST_ROWS = 10_000


def pair_runs(a: DataFrame, b: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Rows of run a with the row of run b of the same keys, the last one where b repeats them."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    b = b.withColumn("nth", F.row_number().over(last)).where("nth = 1")
    return a.select(*keys, *(F.col(f).alias(f"a_{f}") for f in fields)).join(b.select(*keys, *(F.col(f).alias(f"b_{f}") for f in fields)), keys)


def matches_within(paired: DataFrame, field: str, slack: int, key: str, order: str) -> DataFrame:
    """near: whether a's value is b's at one of the positions up to `slack` away; nulls equal nulls."""
    around = Window.partitionBy(key).orderBy(order).rowsBetween(-slack, slack)
    return paired.withColumn("near", F.array_contains(F.collect_list(F.struct(F.col(f"b_{field}").alias("v"))).over(around), F.struct(F.col(f"a_{field}").alias("v"))))


def in_segments(rows: DataFrame, segments: DataFrame, at: str, width: float) -> DataFrame:
    """Each row with the first segment [start_s, end_s) that holds it, and whether it lies margin_s inside; null outside all.

    A segment table of at most BROADCAST_ROWS rows is cut into stretches that have one first segment each. These are
    broadcast and joined by buckets of `width` seconds, so a row meets few of them, finds one at most, and is never
    shuffled. Larger tables are joined by bucket, and a window keeps each row's first.
    """
    inside = F.coalesce((F.col(at) >= F.col("start_s") + F.col("margin_s")) & (F.col(at) < F.col("end_s") - F.col("margin_s")), F.lit(False))
    held = segments.select("segment", "start_s", "end_s", "margin_s").limit(BROADCAST_ROWS + 1).collect() if segments.columns[:4] == ["segment", "start_s", "end_s", "margin_s"] else None
    if held is not None and len(held) <= BROADCAST_ROWS:
        spark = rows.sparkSession
        flat = spark.createDataFrame(first_stretches(held), "__from double, __to double, " + ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in segments.columns[:4]))
        cut = flat.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__from") / width), F.floor(F.col("__to") / width))))
        placed = F.broadcast(cut.join(F.broadcast(segments.drop("start_s", "end_s", "margin_s")), "segment") if len(segments.columns) > 4 else cut)
        dealt = rows.withColumn("__at", F.floor(F.col(at) / width))
        hits = dealt.join(placed, (F.col("__at") == F.col("__bucket")) & (F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__to")), "left")
        return hits.drop("__at", "__bucket", "__from", "__to").withColumn("scored", inside)
    rows = rows.withColumn("__row", F.monotonically_increasing_id()) if "__row" not in rows.columns else rows
    cut = segments.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start_s") / width), F.floor(F.col("end_s") / width))))
    dealt = rows.withColumn("__bucket", F.floor(F.col(at) / width))
    hits = dealt.join(cut, (dealt["__bucket"] == cut["__bucket"]) & (F.col(at) >= F.col("start_s")) & (F.col(at) < F.col("end_s")), "left").drop("__bucket")
    first = Window.partitionBy("__row").orderBy("start_s", "segment")
    return hits.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth", "__row").withColumn("scored", inside)


def first_stretches(segments: list) -> list[tuple]:
    """(from, to, segment, start_s, end_s, margin_s): stretches without overlap, each with the segment that starts first there."""
    edges = sorted({x for s in segments if s["end_s"] > s["start_s"] for x in (s["start_s"], s["end_s"])})
    waiting = sorted((s for s in segments if s["end_s"] > s["start_s"]), key=lambda s: (s["start_s"], s["segment"]), reverse=True)
    open_: list[tuple] = []
    out = []
    for begin, end in zip(edges, edges[1:], strict=False):
        while waiting and waiting[-1]["start_s"] <= begin:
            s = waiting.pop()
            heapq.heappush(open_, (s["start_s"], s["segment"], s["end_s"], s["margin_s"]))
        while open_ and open_[0][2] <= begin:
            heapq.heappop(open_)
        if open_:
            start, name, stop, margin = open_[0]
            out.append((float(begin), float(end), name, start, stop, margin))
    return out


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, most_age: float | None = None) -> DataFrame:
    """Each left row with the last right value at or before it, null if older than `most_age`; equal times count.

    A union and one window: no range join, and one shuffle on the key.
    """
    names = [c for c in left.columns if c not in (key, at)]
    both = left.select(key, at, *names, F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.lit(1).alias("__left")).unionByName(
        right.select(key, at, *(F.lit(None).cast(left.schema[n].dataType).alias(n) for n in names), F.col(value).alias("__value"), F.lit(0).alias("__left"))
    )
    w = Window.partitionBy(key).orderBy(at, "__left", F.col("__value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last(F.when(F.col("__left") == 0, F.struct(F.col("__value").alias("v"), F.col(at).alias("t"))), ignorenulls=True).over(w)).where("__left = 1")
    fresh = F.lit(True) if most_age is None else (F.col(at) - F.col("__found.t") <= most_age)
    return found.withColumn(value, F.when(fresh, F.col("__found.v"))).drop("__value", "__left", "__found")


def templates_of(glyphs: DataFrame) -> DataFrame:
    """(label, template): the mean patch of each label; one row a label, so small by its kind."""
    flat = glyphs.select("label", F.posexplode("patch").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("template"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of equal length, in one pass; 0 where one is flat."""
    names = ("n", "x", "y", "xx", "yy", "xy")
    zero = F.struct(*(F.lit(0.0).alias(k) for k in names))

    def add(s: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.struct(*((s[k] + v).alias(k) for k, v in zip(names, (F.lit(1.0), x, y, x * x, y * y, x * y), strict=True)))

    def finish(s: Column) -> Column:
        square = (s["n"] * s["xx"] - s["x"] * s["x"]) * (s["n"] * s["yy"] - s["y"] * s["y"])
        return F.when(square > 0, (s["n"] * s["xy"] - s["x"] * s["y"]) / F.sqrt(square)).otherwise(0.0)

    return F.aggregate(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), zero, add, finish)


def best_template(glyphs: DataFrame, templates: DataFrame, digits: int = 9) -> DataFrame:
    """Each patch's best template, its score (r + 1) / 2, and the margin to the best other one; equal scores go to the later label.

    Templates are one row a label; they travel with each row as one array, in one pass.
    """
    held = templates.groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "template"))).alias("ts"))
    scored = glyphs.join(F.broadcast(held), F.lit(True)).withColumn("s", F.reverse(F.array_sort(F.transform("ts", lambda t: F.struct(F.round((correlation(F.col("patch"), t["template"]) + 1) / 2, digits).alias("score"), t["label"].alias("label"))))))
    best, other = F.element_at("s", 1), F.get("s", F.lit(1))
    return scored.select("vec_id", "label", best["label"].alias("best"), best["score"].alias("score"), F.coalesce(best["score"] - other["score"], best["score"]).alias("margin"))


def trimmed_templates(glyphs: DataFrame, least: float = 0.9, passes: int = 3, most_std: float | None = None) -> DataFrame:
    """Mean patches after dropping, up to `passes` times, patches that correlate with their label's mean below `least`.

    With `most_std`, `mask` tells the pixels that vary by at most so much among the patches kept.
    """
    kept = glyphs
    for _ in range(passes):
        means = templates_of(kept).withColumnRenamed("label", "of")
        kept = kept.join(F.broadcast(means), kept["label"] == means["of"]).where(correlation(F.col("patch"), F.col("template")) >= least).select(*glyphs.columns)
    if most_std is None:
        return templates_of(kept)
    flat = kept.select("label", F.posexplode("patch").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"), (F.stddev_pop("x") <= most_std).alias("ok"))
    held = flat.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m", "ok"))).alias("s"))
    return held.select("label", F.transform("s", lambda s: s["m"]).alias("template"), F.transform("s", lambda s: s["ok"]).alias("mask"))


def attribute(deltas: DataFrame, lines: str, gained: str, level: str) -> DataFrame:
    """parts: the clears that explain a line step, by the smallest residual within 150 points; null on a tie, then greedy.

    The lookup of compositions has 38 rows and is an array of literals.
    """
    ways = F.array(*(F.struct(F.lit(n).alias("n"), F.array(*map(F.lit, c)).alias("parts"), F.lit(sum((40, 100, 300, 1200)[p - 1] for p in c)).alias("base")) for n in range(1, 9) for c in compositions(n)))
    residual = F.transform(F.filter(ways, lambda w: w["n"] == F.col(lines)), lambda w: F.struct((F.col(gained) - w["base"] * (F.col(level) + 1)).cast("long").alias("r"), w["parts"].alias("parts")))
    fits = F.array_sort(F.filter(residual, lambda x: (x["r"] >= 0) & (x["r"] <= SCORE_SLACK)))
    first, second = F.get(fits, F.lit(0)), F.get(fits, F.lit(1))
    found = F.when(F.size(fits) == 0, None).when(second.isNotNull() & (first["r"] == second["r"]), None).otherwise(first["parts"])
    greedy = F.concat(F.array_repeat(F.lit(4), F.floor(F.col(lines) / 4).cast("int")), F.when(F.col(lines) % 4 > 0, F.array((F.col(lines) % 4).cast("int"))).otherwise(F.array().cast("array<int>")))
    return deltas.withColumn("attributed", found.isNotNull()).withColumn("parts", F.coalesce(found, greedy))


def leaderboard(games: DataFrame, n: int, order: str, buckets: list[str] | None = None) -> DataFrame:
    """The n best games by score, earlier ones first among equals; of each bucket if buckets are given."""
    if not buckets:
        return games.orderBy(F.desc("score"), order).limit(n)
    w = Window.partitionBy(*buckets).orderBy(F.desc("score"), order)
    return games.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def retained(files: DataFrame, most_bytes: int, keep_days: int | None = None, today: Column | None = None) -> DataFrame:
    """keep: newest files first while their bytes fit, by day and then in the day, so that no task holds all files; none older than `keep_days`.

    files has (day, made_at, name, bytes).
    """
    fresh = F.lit(True) if keep_days is None else F.col("day") >= F.date_sub(F.current_date() if today is None else today, keep_days)
    every, files = files, files.where(fresh)
    days = files.groupBy("day").agg(F.sum("bytes").alias("in_day"))
    newer = days.withColumn("newer", F.sum("in_day").over(Window.orderBy(F.desc("day"))) - F.col("in_day")).select("day", "newer")
    w = Window.partitionBy("day").orderBy(F.desc("made_at"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    kept = files.join(newer, "day").withColumn("held", F.col("newer") + F.sum("bytes").over(w)).withColumn("keep", F.col("held") <= most_bytes).drop("newer")
    return kept.unionByName(every.where(~fresh).withColumn("held", F.lit(None).cast("long")).withColumn("keep", F.lit(False)))
