"""Aggregates: percentiles, clear statistics, pace, board shape, telemetry, validation and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from framefold.functions.rules import BASE_SCORES, PACE_LINES, clear_base_score, expected_level, infer_start_level
from framefold.operators.windows import KEY, ordered


def nearest_rank(values: Column, q: float, truncate: bool = False) -> Column:
    """The value at round((n - 1) q) of the sorted values, or at the floor; null without values."""
    at = (F.size(values) - 1) * F.lit(q)
    at = F.floor(at) if truncate else F.round(at)
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), (at + 1).cast("int")))


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Per key the named quantiles of the known values: (q, kind), kind being linear, nearest or floor.

    Values are counted before they are ordered, so no row holds a whole group, and a group of few values stays small.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("__end", upto).withColumn("__all", F.sum("__n").over(group))
    at = lambda place: F.min(F.when(F.col("__end") > place, F.col("__v")))  # noqa: E731  the value at a place from 0
    out = []
    for name, (q, kind) in wanted.items():
        place = (F.col("__all") - 1) * F.lit(q)
        if kind == "linear":
            low, high, share = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
            out.append((low + (high - low) * share).alias(name))
        else:
            out.append(at(F.round(place) if kind == "nearest" else F.floor(place)).alias(name))
    return placed.groupBy(*keys).agg(*out)


def argsort(values: Column) -> Column:
    """Positions from 0 in rising order of the values; equal values keep their order."""
    placed = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(placed), lambda p: p["i"])


def clear_stats(clears: DataFrame, key: str = "game_id") -> DataFrame:
    """Per game: counts by size, lines, tetris rate, burn, points by size, efficiency."""
    size, level = F.col("size"), F.col("level")
    count = lambda k: F.sum(F.when(size == k, 1).otherwise(0)).cast("long")
    points = lambda k: F.sum(F.when(size == k, F.lit(BASE_SCORES[k - 1]) * (F.coalesce(level, F.lit(-1)) + 1)).otherwise(0)).cast("long")
    out = clears.groupBy(key).agg(
        *(count(k).alias(n) for k, n in enumerate(("singles", "doubles", "triples", "tetrises"), 1)),
        F.sum("size").cast("long").alias("lines"),
        *(points(k).alias(f"points_{k}") for k in (1, 2, 3, 4)),
        F.sum(clear_base_score(size)).cast("long").alias("base"),
    )
    lines = F.col("lines")
    return out.withColumn("tetris_rate", F.when(lines > 0, 4 * F.col("tetrises") / lines)).withColumn("burn", lines - 4 * F.col("tetrises")).withColumn("efficiency", F.when(lines > 0, F.col("base") / lines)).drop("base")


def with_drops(stats: DataFrame, score: str) -> DataFrame:
    """drops: what of the score no clear explains."""
    return stats.withColumn("drops", F.greatest(F.col(score) - sum(F.col(f"points_{k}") for k in (1, 2, 3, 4)), F.lit(0)))


def trt_trend(clears: DataFrame, order: list[str], key: str = "game_id") -> DataFrame:
    """The lines and the tetris rate after each clear."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lines = F.sum("size").over(w)
    return clears.withColumn("total_lines", lines.cast("long")).withColumn("rate", F.sum(F.when(F.col("size") == 4, 4).otherwise(0)).over(w) / lines)


def project_pace(score: Column, lines: Column, level: Column, per_line: Column) -> Column:
    """The score projected to PACE_LINES: ten-line chunks at the level each has, at `per_line` base points a line; rounded half up."""
    left = F.greatest(F.lit(PACE_LINES) - lines, F.lit(0))
    first = F.least(10 - lines % 10, left)
    chunks = F.sequence(F.lit(0).cast("long"), F.ceil((left - first) / 10).cast("long"))
    gain = F.aggregate(chunks, F.lit(0.0), lambda s, k: s + F.when(k == 0, first).otherwise(F.least(F.lit(10).cast("long"), left - first - 10 * (k - 1))) * per_line * (level + k + 1))
    return F.floor(score + gain + 0.5).cast("long")


def coefficient_of_variation(counts: Column) -> Column:
    """Population deviation over mean of an array; 0 where the sum is 0."""
    n = F.size(counts)
    mean = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(counts, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.when(mean > 0, F.sqrt(square) / mean).otherwise(0.0)


def column_heights(board: Column, rows: int, columns: int) -> Column:
    """Heights of a flat board (row by row, from the top; 0 is empty), column by column."""
    cell = lambda r, c: F.element_at(board, (r * columns + c + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.coalesce(F.array_max(F.transform(F.filter(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: cell(r, c) != 0), lambda r: F.lit(rows) - r)), F.lit(0)))


def board_metrics(boards: DataFrame, board: str, rows: int, columns: int) -> DataFrame:
    """heights, max_height, mean_height, holes, full rows, tetris-ready, double well and clean slope of a flat board."""
    b = F.col(board)
    heights = column_heights(b, rows, columns)
    with_heights = boards.withColumn("heights", heights)
    h = F.col("heights")
    filled = F.size(F.filter(b, lambda x: x != 0))
    total = F.aggregate(h, F.lit(0), lambda s, x: s + x)
    row_of = lambda r: F.slice(b, r * columns + 1, columns)
    in_row = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.size(F.filter(row_of(r), lambda x: x != 0)))
    gap = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.when(F.size(F.filter(row_of(r), lambda x: x != 0)) == columns - 1, F.array_position(F.transform(row_of(r), lambda x: x != 0), False)).otherwise(0))
    ready = F.exists(F.sequence(F.lit(1), F.lit(rows - 3)), lambda r: (F.element_at(F.col("gaps"), r) > 0) & (F.size(F.filter(F.slice(F.col("gaps"), r, 4), lambda g: g == F.element_at(F.col("gaps"), r))) == 4))
    side = lambda c: F.least(F.when(c == 1, F.lit(1 << 20)).otherwise(F.element_at(h, F.greatest(c - 1, F.lit(1)))), F.when(c == columns, F.lit(1 << 20)).otherwise(F.element_at(h, F.least(c + 1, F.lit(columns)))))
    wells = F.size(F.filter(F.sequence(F.lit(1), F.lit(columns)), lambda c: side(c) - F.element_at(h, c) >= 3))
    monotone = F.forall(F.sequence(F.lit(1), F.lit(columns - 1)), lambda c: F.element_at(h, c) >= F.element_at(h, c + 1)) | F.forall(F.sequence(F.lit(1), F.lit(columns - 1)), lambda c: F.element_at(h, c) <= F.element_at(h, c + 1))
    out = with_heights.withColumn("gaps", gap).withColumn("max_height", F.array_max(h)).withColumn("mean_height", total / F.lit(columns)).withColumn("holes", total - filled)
    return out.withColumn("full_rows", F.size(F.filter(in_row, lambda n: n == columns))).withColumn("tetris_ready", ready).withColumn("double_well", wells >= 2).withColumn("clean_slope", (F.col("holes") == 0) & monotone).drop("gaps")


def signal_lost(frames: DataFrame, states: tuple[str, ...] = ("no_signal", "unknown"), cap: float = 5.0) -> DataFrame:
    """Per stream the seconds without a picture: steps before such frames, each at most `cap`."""
    step = F.col("ts") - F.lag("ts").over(ordered())
    stepped = frames.withColumn("step", F.greatest(F.least(F.coalesce(step, F.lit(0.0)), F.lit(cap)), F.lit(0.0)))
    return stepped.groupBy(KEY).agg(F.sum(F.when(F.col("state").isin(*states), F.col("step")).otherwise(0.0)).alias("lost_seconds"))


def telemetry(samples: DataFrame, window_s: int) -> DataFrame:
    """Per tumbling window: frames a second, live messages a second, drop rate, frames missing, p50 and p95 by nearest rank.

    samples has ts, x (milliseconds), live (whether it was sent), and steps of counters: delivered, dropped, missing.
    """
    start = (F.floor(F.col("ts") / window_s) * window_s).cast("long")
    placed = samples.withColumn("window_start", start)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = placed.groupBy("window_start").agg(
        F.count("*").alias("n"),
        F.round(F.count("*") / window_s, 4).alias("rate"),
        F.round(total(F.col("live").cast("int")) / window_s, 4).alias("live_hz"),
        F.round(F.when(total("delivered") > 0, total("dropped") / total("delivered")).otherwise(0.0), 4).alias("drop_rate"),
        total("missing").cast("long").alias("missing"),
    )
    ranks = quantiles(placed, ["window_start"], "x", {"p50": (0.5, "nearest"), "p95": (0.95, "nearest")})
    return sums.join(ranks, "window_start", "left").withColumn("p50", F.round("p50", 2)).withColumn("p95", F.round("p95", 2))


def counter_deltas(samples: DataFrame, counter: str) -> DataFrame:
    """Steps of a counter that may restart from 0: the value itself after a restart."""
    before = F.lag(counter).over(ordered())
    return samples.withColumn("delta", F.when(before.isNull(), F.lit(0)).when(F.col(counter) < before, F.col(counter)).otherwise(F.col(counter) - before))


def busy_percent(samples: DataFrame) -> DataFrame:
    """CPU busy per cent from running totals (total, idle)."""
    total, idle = (F.col(c) - F.lag(c).over(ordered()) for c in ("total", "idle"))
    return samples.withColumn("busy", F.when(total > 0, 100 * (total - idle) / total))


def ema(frames: DataFrame, value: str, alpha: float) -> DataFrame:
    """Per stream the exponential mean of its known values in order, from the first one on.

    A value counts alpha (1 - alpha)^k with k values after it, the first one (1 - alpha)^k: a sum, so partial results combine.
    """
    newest = Window.partitionBy(KEY).orderBy(F.desc("seq"))
    after = frames.where(F.col(value).isNotNull()).withColumn("__after", F.row_number().over(newest) - 1).withColumn("__first", F.lead("seq").over(newest).isNull())
    weight = F.pow(F.lit(1 - alpha), F.col("__after")) * F.when(F.col("__first"), 1.0).otherwise(alpha)
    return after.groupBy(KEY).agg(F.sum(F.col(value) * weight).alias("ema"))


def overall_confidence(score: Column, lines: Column, level: Column, piece: Column, board: Column) -> Column:
    return 0.30 * score + 0.15 * lines + 0.15 * level + 0.10 * piece + 0.30 * board


def otsu(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the first threshold of 0..255 that parts the values with the greatest between-class variance."""
    counts = pixels.groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(key)
    low, moment = F.sum("n").over(up), F.sum(F.col("n") * F.col("v")).over(up)
    total, all_moment = F.sum("n").over(every), F.sum(F.col("n") * F.col("v")).over(every)
    cut = counts.select(key, "v", (low / total).alias("q"), (moment / low).alias("m1"), ((all_moment - moment) / F.nullif(total - low, F.lit(0))).alias("m2"))
    between = F.col("q") * (1 - F.col("q")) * F.pow(F.col("m1") - F.col("m2"), 2)
    scored = cut.withColumn("between", F.round(F.coalesce(between, F.lit(0.0)), 6))
    first = Window.partitionBy(key).orderBy(F.desc("between"), "v")
    return scored.withColumn("r", F.row_number().over(first)).where("r = 1").select(key, F.when(F.col("between") > 0, F.col("v")).otherwise(0).alias("threshold"))


def agreement(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Per field of paired runs (a_*, b_*): pairs scored, agreeing, missing on one side, and the rate.

    A field that is an array counts its cells: scored and agreeing are cells, and `exact` the pairs that agree in all.
    """
    parts = []
    for f in fields:
        a, b = F.col(f"a_{f}"), F.col(f"b_{f}")
        both, same = a.isNotNull() & b.isNotNull(), F.coalesce(a == b, F.lit(False)).cast("long")
        cells = isinstance(pairs.schema[f"a_{f}"].dataType, ArrayType)
        scored = F.when(both, F.greatest(F.size(a), F.size(b)).cast("long") if cells else F.lit(1).cast("long")).otherwise(0)
        agree = F.when(both, F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x)).cast("long")).otherwise(0) if cells else same
        parts.append(F.struct(F.lit(f).alias("field"), scored.alias("scored"), agree.alias("agree"), same.alias("exact"), (a.isNull() != b.isNull()).cast("long").alias("one_side")))
    rows = pairs.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    out = rows.groupBy("field").agg(F.sum("scored").alias("scored"), F.sum("agree").alias("agree"), F.sum("exact").alias("exact"), F.sum("one_side").alias("one_side"))
    return out.withColumn("rate", F.col("agree") / F.greatest(F.col("scored"), F.lit(1)))


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """How often each label met each prediction, with the share of the label, and the accuracy over all."""
    counts = rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    right = counts.agg((F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    every = Window.partitionBy("label")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(every)).withColumn("accuracy", right.scalar())


def label_stats(matched: DataFrame, label: str, score: str, margin: str, best: str) -> DataFrame:
    """Per label: matches, mean and least score, least margin, and how often each template was the best."""
    sums = matched.groupBy(label).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.min(margin).alias("min_margin"))
    kinds = matched.groupBy(label, best).agg(F.count("*").alias("times"))
    return sums.join(kinds.groupBy(label).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(best, "times")))).alias("best_kinds")), label)


def bench_summary(samples: DataFrame, value: str, wall: str) -> DataFrame:
    """One row: frames, mean, greatest, p50 to p99 by nearest rank, and frames a second of wall time."""
    one = samples.withColumn("__group", F.lit(1))
    ranks = quantiles(one, ["__group"], value, {f"p{round(100 * q)}": (q, "nearest") for q in (0.5, 0.9, 0.95, 0.99)})
    sums = one.groupBy("__group").agg(F.count(value).alias("frames"), F.avg(value).alias("mean"), F.max(value).alias("most"), (F.count(value) / (F.max(wall) - F.min(wall))).alias("fps"))
    return sums.join(ranks, "__group").drop("__group")


#: The greatest level, lines and score that a game can show.
RANGES = {"level": 255, "lines": 9999, "score": 16777215}


def out_of_range(frames: DataFrame) -> DataFrame:
    """Per stream its first impossible value, as `field value`; null without one. Within a frame level comes first, then lines, then score."""
    faults = [F.when(~F.col(f).between(0, most), F.concat_ws(" ", F.lit(f), F.col(f).cast("string"))) for f, most in RANGES.items()]
    found = frames.withColumn("fault", F.coalesce(*faults))
    return found.groupBy(KEY).agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("seq"))).alias("out_of_range"))


def region_fractions(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per region: mean and deviation of its pixels, and the shares that are dark (below 64) and bright (above 40)."""
    share = lambda c: F.avg(c.cast("int"))
    return pixels.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), share(F.col(value) < 64).alias("dark"), share(F.col(value) > 40).alias("bright"))


#: The report's limits for lines, points a piece, score, low confidence, seconds without a picture, and rejected readings.
LINES_OFF, DROP_POINTS, SCORE_OFF, SCORE_CAP, LOW_SHARE, LOST, REJECTS = 1, 40, 1000, 999999, (0.10, 0.30), (2.0, 10.0), 20


def validation(games: DataFrame) -> DataFrame:
    """issues (severity:code, in the report's order) and valid of finished games, from their summary columns; an error makes a game invalid.

    Columns: restarts, ingame_frames, start_score, start_lines, start_level, end_score, end_lines, end_level, counted (lines of
    the clears), pieces, clear_points, cheat_points, anomalies, level_offset_steps, low_frames, lost_seconds, rejects,
    out_of_range. A rule over an unknown value finds nothing.
    """
    c = F.col
    over = c("end_score") - c("start_score") - c("clear_points") - c("cheat_points")
    low = F.when(c("ingame_frames") > 0, c("low_frames") / c("ingame_frames")).otherwise(0.0)
    rules = [
        (c("restarts") > 0, "engine_restart", "error"),
        (c("ingame_frames") == 0, "no_gameplay", "error"),
        (F.coalesce(c("start_score") > 0, F.lit(False)) | F.coalesce(c("start_lines") > 0, F.lit(False)), "partial_game", "error"),
        (F.abs(c("counted") - (c("end_lines") - c("start_lines"))) > LINES_OFF, "lines_clears_mismatch", "error"),
        (c("end_level") != expected_level(infer_start_level(c("start_level"), c("start_lines")), c("end_lines")), "level_mismatch", "warning"),
        ((c("end_score") < SCORE_CAP) & ((over < -SCORE_OFF) | (over > DROP_POINTS * F.greatest(c("pieces"), F.lit(0)) + SCORE_OFF)), "score_reconcile", "error"),
        (c("anomalies") > 0, "score_unexplained", "warning"),
        (c("level_offset_steps") > 0, "level_score_mismatch", "warning"),
        (low >= LOW_SHARE[1], "low_confidence", "error"),
        ((low >= LOW_SHARE[0]) & (low < LOW_SHARE[1]), "low_confidence", "warning"),
        (c("lost_seconds") >= LOST[1], "signal_lost", "error"),
        ((c("lost_seconds") >= LOST[0]) & (c("lost_seconds") < LOST[1]), "signal_lost", "warning"),
        (c("rejects") >= REJECTS, "plausibility_corrections", "warning"),
        (c("out_of_range").isNotNull(), "value_range", "error"),
    ]
    found = F.array(*(F.when(F.coalesce(when, F.lit(False)), F.lit(f"{severity}:{code}")) for when, code, severity in rules))
    out = games.withColumn("issues", F.filter(found, lambda x: x.isNotNull()))
    return out.withColumn("valid", ~F.exists("issues", lambda x: x.startswith("error")))
