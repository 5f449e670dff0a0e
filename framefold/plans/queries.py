"""Queries over the test tables for the engine's operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framefold.functions import rules
from framefold.operators import aggregates as A
from framefold.operators import folds as L
from framefold.operators import frames as V
from framefold.operators import joins as J
from framefold.operators import windows as W
from framefold.plans import scalars, station  # noqa: F401  they register their queries
from framefold.plans.registry import CLEARS, FRAMES, GAMES, ORACLE_SQL, QUERIES, query  # noqa: F401
from framefold.sources import recordings as R


@query(
    "replay_stats",
    """
    WITH play AS (SELECT *, coalesce(ts - lag(ts) OVER w, 0) AS d FROM frames WHERE state = 'in_game' WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
    clock AS (SELECT stream_id, round(sum(CASE WHEN d > 0 THEN least(d, 1800) ELSE 0 END), 3) AS active_seconds, max(score) AS score FROM play GROUP BY 1),
    known AS (SELECT *, lag(piece) OVER (PARTITION BY stream_id ORDER BY seq) AS spawned FROM frames WHERE piece IS NOT NULL),
    sp AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM known WHERE spawned IS NOT NULL AND piece <> spawned),
    dr AS (SELECT *, n - coalesce(max(CASE WHEN spawned = 'I' THEN n END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS drought FROM sp),
    pieces AS (SELECT stream_id, count(*) AS pieces, max(drought) AS max_drought FROM dr GROUP BY 1)
    SELECT stream_id, score, active_seconds, coalesce(pieces, 0) AS pieces, coalesce(max_drought, 0) AS max_drought,
        round(CASE WHEN active_seconds > 0 THEN coalesce(pieces, 0) / active_seconds END, 6) AS pps,
        round(CASE WHEN active_seconds > 0 THEN score * 60 / active_seconds END, 4) AS score_per_min
    FROM clock LEFT JOIN pieces USING (stream_id)
    """,
    FRAMES,
)
def replay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir)
    clock = W.active_clock(frames, 1800.0).groupBy("stream_id").agg(F.round(F.sum("step"), 3).alias("active_seconds"), F.max("score").alias("score"))
    pieces = W.droughts(W.spawns(frames)).groupBy("stream_id").agg(F.count("*").alias("pieces"), F.max("drought").alias("max_drought"))
    out = clock.join(pieces, "stream_id", "left").fillna(0, ["pieces", "max_drought"])
    played = F.col("active_seconds") > 0
    return out.select("stream_id", "score", "active_seconds", "pieces", "max_drought", F.round(F.when(played, F.col("pieces") / F.col("active_seconds")), 6).alias("pps"), F.round(F.when(played, F.col("score") * 60 / F.col("active_seconds")), 4).alias("score_per_min"))


VOTE_SQL = """
    WITH ballots AS (
        SELECT f.stream_id, f.seq, b.{value} AS v, {weight} AS w, b.seq AS pos FROM frames f JOIN frames b ON b.stream_id = f.stream_id AND b.seq BETWEEN f.seq - 4 AND f.seq
        WHERE b.{value} IS NOT NULL AND b.{value} <> 'unknown'
    ),
    sums AS (SELECT stream_id, seq, v, sum(w) AS s, count(*) AS n, min(pos) AS first_at, max(pos) AS last_at FROM ballots GROUP BY 1, 2, 3),
    best AS (SELECT *, row_number() OVER (PARTITION BY stream_id, seq ORDER BY round(s, 9) DESC, {tie}) AS r FROM sums)
"""


@query(
    "w1_state_vote",
    VOTE_SQL.format(value="state", weight="b.conf", tie="first_at")
    + """
    SELECT f.stream_id, f.seq, round(s / n, 6) AS vote_confidence,
        coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY f.stream_id ORDER BY f.seq ROWS UNBOUNDED PRECEDING), 'unknown') AS fused_state
    FROM frames f LEFT JOIN best b ON b.stream_id = f.stream_id AND b.seq = f.seq AND r = 1
    """,
    FRAMES,
)
def w1_state_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir)
    return W.vote_state(frames).select("stream_id", "seq", F.round("vote_confidence", 6).alias("vote_confidence"), "fused_state")


@query(
    "a7_cell_vote",
    VOTE_SQL.format(value="piece", weight="CASE WHEN b.conf >= 0.5 THEN 1.0 ELSE 0.4 END", tie="last_at DESC")
    + " SELECT f.stream_id, f.seq, v AS cell FROM frames f LEFT JOIN best b ON b.stream_id = f.stream_id AND b.seq = f.seq AND r = 1",
    FRAMES,
)
def a7_cell_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.cell_vote(V.frames(spark, sf_dir), "piece").select("stream_id", "seq", "cell")


@query(
    "w4_hold_decay",
    """
    WITH marked AS (SELECT *, CASE WHEN conf >= 0.4 THEN seq END AS fresh FROM frames),
    held AS (SELECT *, last_value(fresh IGNORE NULLS) OVER w AS at FROM marked WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT h.stream_id, h.seq, round(f.conf * pow(0.9, h.seq - h.at), 6) AS held_confidence, CASE WHEN f.conf * pow(0.9, h.seq - h.at) >= 0.4 THEN f.raw_score END AS held
    FROM held h LEFT JOIN frames f ON f.stream_id = h.stream_id AND f.seq = h.at
    """,
    FRAMES,
)
def w4_hold_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.hold_with_decay(V.frames(spark, sf_dir), "raw_score").select("stream_id", "seq", F.round("held_confidence", 6).alias("held_confidence"), "held")


@query("w5_running_max", "SELECT stream_id, seq, max(raw_score) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS most FROM frames", FRAMES)
def w5_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.running_max(V.frames(spark, sf_dir), "raw_score").select("stream_id", "seq", "most")


@query(
    "w10_active_clock",
    """
    WITH play AS (SELECT *, ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY seq) AS d FROM frames WHERE state = 'in_game')
    SELECT stream_id, seq, round(sum(CASE WHEN d > 0 THEN least(d, 1800) ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 3) AS active_seconds FROM play
    """,
    FRAMES,
)
def w10_active_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.active_clock(V.frames(spark, sf_dir), 1800.0).select("stream_id", "seq", F.round("active_seconds", 3).alias("active_seconds"))


DROUGHTS = """
    known AS (SELECT *, lag(piece) OVER (PARTITION BY stream_id ORDER BY seq) AS spawned FROM frames WHERE piece IS NOT NULL),
    sp AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM known WHERE spawned IS NOT NULL AND piece <> spawned),
    dr AS (SELECT *, n - coalesce(max(CASE WHEN spawned = 'I' THEN n END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS drought FROM sp)
"""


@query("w13_drought", "SELECT stream_id, seq, spawned, n, drought FROM dr", FRAMES, DROUGHTS)
def w13_drought(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.droughts(W.spawns(V.frames(spark, sf_dir))).select("stream_id", "seq", "spawned", "n", "drought")


@query(
    "w15_ended_droughts",
    """
    WITH e AS (SELECT *, CASE WHEN spawned = 'I' THEN coalesce(lag(drought) OVER (PARTITION BY stream_id ORDER BY seq), 0) END AS ended FROM dr)
    SELECT stream_id, max_by(ended, n) FILTER (ended IS NOT NULL) AS last_ended, CAST(count(*) FILTER (ended >= 5) AS BIGINT) AS ended_flagged, max(drought) AS max_drought FROM e GROUP BY 1
    """,
    FRAMES,
    DROUGHTS,
)
def w15_ended_droughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.ended_droughts(W.spawns(V.frames(spark, sf_dir)), flag=5)


@query(
    "w16_trt_trend",
    """
    SELECT game_id, size, level, quantity, price, CAST(sum(size) OVER w AS BIGINT) AS total_lines, round(sum(CASE WHEN size = 4 THEN 4 ELSE 0 END) OVER w / sum(size) OVER w, 6) AS rate
    FROM clears WINDOW w AS (PARTITION BY game_id ORDER BY quantity, price, size, level ROWS UNBOUNDED PRECEDING)
    """,
    CLEARS,
)
def w16_trt_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.trt_trend(V.clears(spark, sf_dir), ["quantity", "price", "size", "level"])
    return out.withColumn("rate", F.round("rate", 6))


RUNS = """
    marked AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL OR state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS c FROM frames WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
    numbered AS (SELECT *, sum(c) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM marked),
    runs AS (SELECT stream_id, CAST(run AS BIGINT) AS run, min(seq) AS start_seq, max(seq) AS end_seq, any_value(state) AS value, count(*) AS n FROM numbered GROUP BY 1, 2)
"""


@query("w28_runs", "SELECT stream_id, run, start_seq, end_seq, value, n FROM runs", FRAMES, RUNS)
def w28_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.runs(V.frames(spark, sf_dir), "state").select("stream_id", "run", "start_seq", "end_seq", "value", "n")


@query("w29_longest_runs", "SELECT stream_id, start_seq, end_seq, n FROM runs WHERE value = 'unknown' ORDER BY n DESC, stream_id, start_seq LIMIT 20", FRAMES, RUNS)
def w29_longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.runs(V.frames(spark, sf_dir), "state").where("value = 'unknown'").orderBy(F.desc("n"), "stream_id", "start_seq").limit(20).select("stream_id", "start_seq", "end_seq", "n")


@query(
    "w19_settle",
    """
    WITH known AS (SELECT stream_id, seq, piece, CASE WHEN piece IS DISTINCT FROM lag(piece) OVER w THEN 1 ELSE 0 END AS c FROM frames WHERE piece IS NOT NULL WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
    numbered AS (SELECT *, sum(c) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM known),
    firm AS (SELECT stream_id, seq, CASE WHEN row_number() OVER (PARTITION BY stream_id, run ORDER BY seq) >= 2 THEN piece END AS firm FROM numbered)
    SELECT f.stream_id, f.seq, last_value(firm IGNORE NULLS) OVER (PARTITION BY f.stream_id ORDER BY f.seq ROWS UNBOUNDED PRECEDING) AS settled FROM frames f LEFT JOIN firm g ON f.stream_id = g.stream_id AND f.seq = g.seq
    """,
    FRAMES,
)
def w19_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.settle(V.frames(spark, sf_dir), "piece", 2).select("stream_id", "seq", "settled")


@query(
    "w21_schmitt",
    """
    SELECT stream_id, seq, coalesce(last_value(CASE WHEN conf > 0.8 THEN TRUE WHEN conf <= 0.4 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING), FALSE) AS high FROM frames
    """,
    FRAMES,
)
def w21_schmitt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.schmitt(V.frames(spark, sf_dir), "conf", 0.8, 0.4).select("stream_id", "seq", "high")


@query(
    "w26_streak",
    """
    WITH p AS (SELECT *, sum(CASE WHEN state = 'in_game' THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM frames),
    s AS (SELECT stream_id, seq, CAST(sum(CASE WHEN state = 'in_game' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, part ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM p)
    SELECT stream_id, seq, streak, streak >= 4 AS confirmed FROM s
    """,
    FRAMES,
)
def w26_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.streak(V.frames(spark, sf_dir), F.col("state") == "in_game", 4).select("stream_id", "seq", "streak", "confirmed")


@query(
    "w30_first_last",
    """
    SELECT stream_id, min_by(piece, seq) FILTER (piece IS NOT NULL) AS first_value, max_by(piece, seq) FILTER (piece IS NOT NULL AND state = 'in_game') AS last_value FROM frames GROUP BY 1
    """,
    FRAMES,
)
def w30_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_last(V.frames(spark, sf_dir), "piece")


@query(
    "w31_session_end",
    """
    WITH s AS (SELECT *, lag(state) OVER w AS before_state, last_value(CASE WHEN state = 'in_game' THEN score END IGNORE NULLS) OVER r AS end_score, last_value(CASE WHEN state = 'in_game' THEN seq END IGNORE NULLS) OVER r AS end_seq
        FROM frames WINDOW w AS (PARTITION BY stream_id ORDER BY seq), r AS (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT stream_id, seq, before_state, end_score, end_seq FROM s WHERE before_state IN ('in_game', 'paused') AND state = 'level_select'
    """,
    FRAMES,
)
def w31_session_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.session_ends(V.frames(spark, sf_dir)).select("stream_id", "seq", "before_state", "end_score", "end_seq")


@query(
    "w33_stack_commit",
    """
    WITH s AS (SELECT *, CASE WHEN state = 'in_game' AND piece IS NOT NULL AND lag(piece) OVER w <> piece THEN lag(raw_score) OVER w END AS taken FROM frames WINDOW w AS (PARTITION BY stream_id ORDER BY seq))
    SELECT stream_id, seq, last_value(taken IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stack FROM s
    """,
    FRAMES,
)
def w33_stack_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.stack_commit(V.frames(spark, sf_dir), "raw_score").select("stream_id", "seq", "stack")


@query(
    "s6_source_gaps",
    """
    WITH g AS (SELECT stream_id, seq, ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY seq) AS gap FROM frames)
    SELECT stream_id, seq, CAST(CASE WHEN gap IS NULL OR gap * 0.01 < 1.5 THEN 0 ELSE greatest(round(gap * 0.01) - 1, 0) END AS BIGINT) AS missing FROM g
    """,
    FRAMES,
)
def s6_source_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.source_gaps(V.frames(spark, sf_dir), 0.01).select("stream_id", "seq", "missing")


@query(
    "k14_changes",
    """
    WITH c AS (SELECT *, lag(state || coalesce(piece, '-')) OVER w AS b, lag(seq) OVER w AS p FROM frames WINDOW w AS (PARTITION BY stream_id ORDER BY seq))
    SELECT stream_id, seq, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS BIGINT) AS out_seq FROM c WHERE p IS NULL OR (state || coalesce(piece, '-')) IS DISTINCT FROM b
    """,
    FRAMES,
)
def k14_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.changes(V.frames(spark, sf_dir), F.concat("state", F.coalesce("piece", F.lit("-")))).select("stream_id", "seq", "out_seq")


@query(
    "a16_signal_lost",
    """
    WITH s AS (SELECT stream_id, state, greatest(least(coalesce(ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY seq), 0), 900), 0) AS d FROM frames)
    SELECT stream_id, round(sum(CASE WHEN state = 'unknown' THEN d ELSE 0 END), 3) AS lost_seconds FROM s GROUP BY 1
    """,
    FRAMES,
)
def a16_signal_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.signal_lost(V.frames(spark, sf_dir), cap=900.0).withColumn("lost_seconds", F.round("lost_seconds", 3))


@query(
    "w11_attribution",
    """
    WITH k AS (SELECT stream_id, seq, lines - lag(lines) OVER w AS d_lines, score - lag(score) OVER w AS d_score FROM frames WHERE state = 'in_game' WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
    d AS (SELECT *, d_score % 19 AS level FROM k WHERE d_lines > 0 AND d_lines <= 8),
    parts(n, p, b) AS (WITH RECURSIVE r(n, p, b, m) AS (SELECT 0, CAST([] AS INTEGER[]), 0, 4 UNION ALL
        SELECT n + s, list_append(p, s), b + ([40, 100, 300, 1200])[s], s FROM r, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE s <= m AND n + s <= 8) SELECT n, p, b FROM r WHERE n > 0),
    fit AS (SELECT d.*, p, d_score - b * (level + 1) AS res FROM d JOIN parts ON n = d_lines),
    good AS (SELECT *, row_number() OVER (PARTITION BY stream_id, seq ORDER BY res, p) AS r, count(*) FILTER (TRUE) OVER (PARTITION BY stream_id, seq, res) AS same FROM fit WHERE res >= 0 AND res <= 150),
    best AS (SELECT * FROM good WHERE r = 1 AND same = 1)
    SELECT d.stream_id, d.seq, d.d_lines, d.d_score, b.p IS NOT NULL AS attributed,
        array_to_string(coalesce(b.p, list_concat(list_transform(range(CAST(d.d_lines // 4 AS BIGINT)), lambda x: 4), CASE WHEN d.d_lines % 4 > 0 THEN [CAST(d.d_lines % 4 AS INTEGER)] ELSE [] END)), '+') AS parts
    FROM d LEFT JOIN best b ON d.stream_id = b.stream_id AND d.seq = b.seq
    """,
    FRAMES,
)
def w11_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = W.line_deltas(V.frames(spark, sf_dir)).where("counts").withColumn("level_now", F.col("d_score") % 19)
    out = J.attribute(deltas, "d_lines", "d_score", "level_now")
    return out.select("stream_id", "seq", "d_lines", "d_score", "attributed", F.array_join(F.col("parts").cast("array<string>"), "+").alias("parts"))


@query(
    "a8_clear_stats",
    """
    WITH s AS (SELECT game_id, count(*) FILTER (size = 1) AS singles, count(*) FILTER (size = 2) AS doubles, count(*) FILTER (size = 3) AS triples, count(*) FILTER (size = 4) AS tetrises, CAST(sum(size) AS BIGINT) AS lines,
        CAST(coalesce(sum(40 * (level + 1)) FILTER (size = 1), 0) AS BIGINT) AS points_1, CAST(coalesce(sum(100 * (level + 1)) FILTER (size = 2), 0) AS BIGINT) AS points_2,
        CAST(coalesce(sum(300 * (level + 1)) FILTER (size = 3), 0) AS BIGINT) AS points_3, CAST(coalesce(sum(1200 * (level + 1)) FILTER (size = 4), 0) AS BIGINT) AS points_4,
        sum(([40, 100, 300, 1200])[size]) AS base, CAST(floor(sum(price)) AS BIGINT) AS score FROM clears GROUP BY 1)
    SELECT * EXCLUDE (base, score), round(4.0 * tetrises / lines, 6) AS tetris_rate, lines - 4 * tetrises AS burn, round(base / lines, 6) AS efficiency FROM s
    """,
    CLEARS,
)
def a8_clear_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.clear_stats(V.clears(spark, sf_dir)).withColumn("tetris_rate", F.round("tetris_rate", 6)).withColumn("efficiency", F.round("efficiency", 6))


@query(
    "a10_points_drops",
    """
    WITH p AS (SELECT game_id, CAST(sum(([40, 100, 300, 1200])[size] * (level + 1)) AS BIGINT) AS points FROM clears GROUP BY 1)
    SELECT p.game_id, points, CAST(floor(score) AS BIGINT) AS score, greatest(CAST(floor(score) AS BIGINT) - points, 0) AS drops FROM p JOIN games USING (game_id)
    """,
    CLEARS,
    GAMES,
)
def a10_points_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = V.games(spark, sf_dir).select("game_id", F.floor("score").cast("long").alias("score"))
    out = A.with_drops(A.clear_stats(V.clears(spark, sf_dir)).join(scores, "game_id"), "score")
    return out.select("game_id", sum(F.col(f"points_{k}") for k in (1, 2, 3, 4)).alias("points"), "score", F.col("drops").cast("long").alias("drops"))


@query("a1_percentiles", "SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1")
def a1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.read(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_returnflag"))
    ranks = A.quantiles(items, ["flag"], "l_extendedprice", {"p10": (0.1, "linear"), "median": (0.5, "linear"), "p95": (0.95, "linear")})
    return ranks.join(items.groupBy("flag").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("std")), "flag").select("flag", *(F.round(c, 4).alias(c) for c in ("p10", "median", "p95")), "std")


@query(
    "a3_nearest_rank",
    "WITH l AS (SELECT stream_id, list(conf ORDER BY conf) AS v FROM frames GROUP BY 1) SELECT stream_id, v[CAST(round((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95_low FROM l",
    FRAMES,
)
def a3_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.quantiles(V.frames(spark, sf_dir), ["stream_id"], "conf", {"p95": (0.95, "nearest"), "p95_low": (0.95, "floor")})


@query(
    "a5_argsort",
    "SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(64), lambda i: {'v': embedding[i + 1], 'i': i})), lambda p: p.i), ',') AS places FROM embeddings",
)
def a5_argsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(A.argsort(F.col("embedding")).cast("array<string>"), ",").alias("places"))


@query(
    "a12_pace",
    """
    WITH g AS (SELECT game_id, CAST(sum(size) AS BIGINT) AS lines, max(level) AS level, sum(([40, 100, 300, 1200])[size] * (level + 1)) AS score, sum(([40, 100, 300, 1200])[size]) / sum(size) AS per_line FROM clears GROUP BY 1),
    f AS (SELECT *, greatest(230 - lines, 0) AS remaining, least(10 - lines % 10, greatest(230 - lines, 0)) AS head FROM g)
    SELECT game_id, CAST(floor(score + head * per_line * (level + 1) + coalesce(list_sum(list_transform(range(1, CAST(ceil((remaining - head) / 10) AS BIGINT) + 1), lambda k: least(10, remaining - head - 10 * (k - 1)) * per_line * (level + k + 1))), 0) + 0.5) AS BIGINT) AS pace FROM f
    """,
    CLEARS,
)
def a12_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rules.clear_base_score(F.col("size"))
    g = V.clears(spark, sf_dir).groupBy("game_id").agg(F.sum("size").alias("lines"), F.max("level").alias("level"), F.sum(base * (F.col("level") + 1)).alias("score"), (F.sum(base) / F.sum("size")).alias("per_line"))
    return g.select("game_id", A.project_pace(F.col("score"), F.col("lines"), F.col("level"), F.col("per_line")).alias("pace"))


@query(
    "a13_variation",
    "WITH c AS (SELECT game_id, count(*) FILTER (size = 1) AS a, count(*) FILTER (size = 2) AS b, count(*) FILTER (size = 3) AS c, count(*) FILTER (size = 4) AS d FROM clears GROUP BY 1) SELECT game_id, round(list_stddev_pop([a, b, c, d]) / list_avg([a, b, c, d]), 6) AS cv FROM c",
    CLEARS,
)
def a13_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.clear_stats(V.clears(spark, sf_dir))
    return s.select("game_id", F.round(A.coefficient_of_variation(F.array("singles", "doubles", "triples", "tetrises").cast("array<double>")), 6).alias("cv"))


@query(
    "a14_board_metrics",
    """
    WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.05 THEN 1 ELSE 0 END) AS b FROM embeddings),
    h AS (SELECT *, list_transform(range(8), lambda c: coalesce(list_max(list_transform(list_filter(range(8), lambda r: b[r * 8 + c + 1] = 1), lambda r: 8 - r)), 0)) AS h FROM b)
    SELECT vec_id, CAST(list_max(h) AS BIGINT) AS max_height, list_sum(h) / 8 AS mean_height, CAST(list_sum(h) - list_sum(b) AS BIGINT) AS holes, CAST(len(list_filter(range(8), lambda r: list_sum(b[r * 8 + 1:r * 8 + 8]) = 8)) AS BIGINT) AS full_rows,
        len(list_filter(range(0, 5), lambda r: len(list_filter(range(1, 9), lambda c: len(list_filter(range(0, 4), lambda k: list_sum(b[(r + k) * 8 + 1:(r + k) * 8 + 8]) = 7 AND b[(r + k) * 8 + c] = 0)) = 4)) > 0)) > 0 AS tetris_ready,
        list_sum(h) = list_sum(b) AND (h = list_sort(h) OR h = list_reverse_sort(h)) AS clean_slope,
        len(list_filter(range(1, 9), lambda c: least(CASE WHEN c = 1 THEN 1000 ELSE h[c - 1] END, CASE WHEN c = 8 THEN 1000 ELSE h[c + 1] END) - h[c] >= 3)) >= 2 AS double_well
    FROM h
    """,
)
def a14_board_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = V.read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0.05, 1).otherwise(0)).alias("board"))
    out = A.board_metrics(boards, "board", 8, 8)
    return out.select("vec_id", F.col("max_height").cast("long").alias("max_height"), F.col("mean_height").cast("double").alias("mean_height"), F.col("holes").cast("long").alias("holes"), F.col("full_rows").cast("long").alias("full_rows"), "double_well", "tetris_ready", "clean_slope")


@query(
    "a17_agreement",
    """
    WITH p AS (SELECT a.piece AS ap, b.piece AS bp, a.state AS as_, b.state AS bs, [a.lines % 3, a.raw_score % 2, a.seq % 4] AS ac, [b.lines % 3, b.raw_score % 2, b.seq % 4] AS bc FROM frames a JOIN frames b ON a.stream_id = b.stream_id - 1 AND a.seq = b.seq)
    SELECT 'piece' AS field, count(*) FILTER (ap IS NOT NULL AND bp IS NOT NULL) AS scored, count(*) FILTER (ap = bp) AS agree, count(*) FILTER (ap = bp) AS exact, count(*) FILTER ((ap IS NULL) <> (bp IS NULL)) AS one_side, round(count(*) FILTER (ap = bp) / greatest(count(*) FILTER (ap IS NOT NULL AND bp IS NOT NULL), 1), 6) AS rate FROM p
    UNION ALL SELECT 'cells', 3 * count(*), CAST(sum(CAST(ac[1] = bc[1] AS INTEGER) + CAST(ac[2] = bc[2] AS INTEGER) + CAST(ac[3] = bc[3] AS INTEGER)) AS BIGINT), count(*) FILTER (ac = bc), 0, round(sum(CAST(ac[1] = bc[1] AS INTEGER) + CAST(ac[2] = bc[2] AS INTEGER) + CAST(ac[3] = bc[3] AS INTEGER)) / (3 * count(*)), 6) FROM p
    UNION ALL SELECT 'state', count(*), count(*) FILTER (as_ = bs), count(*) FILTER (as_ = bs), 0, round(count(*) FILTER (as_ = bs) / greatest(count(*), 1), 6) FROM p
    """,
    FRAMES,
)
def a17_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.frames(spark, sf_dir).withColumn("cells", F.array(F.col("lines") % 3, F.col("raw_score") % 2, F.col("seq") % 4))
    b = a.withColumn("stream_id", F.col("stream_id") - 1)
    paired = J.pair_runs(a, b.withColumn("o", F.col("seq")), ["stream_id", "seq"], "o", ["piece", "state", "cells"])
    return A.agreement(paired, ["piece", "state", "cells"]).withColumn("rate", F.round("rate", 6))


@query(
    "a18_confusion",
    """
    WITH c AS (SELECT quality AS label, CAST(n_chars > 1500 AS INTEGER) AS predicted, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
    SELECT label, predicted, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share, round(sum(CASE WHEN label = predicted THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS accuracy FROM c
    """,
)
def a18_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("predicted"))
    rows = docs.join(V.read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return A.confusion(rows, "quality", "predicted").withColumn("share", F.round("share", 6)).withColumn("accuracy", F.round("accuracy", 6))


TEMPLATES = """
    flat AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    tmpl AS (SELECT label AS t, i, avg(x) AS m FROM flat GROUP BY 1, 2),
    scored AS (SELECT f.vec_id, f.label, t, round((corr(x, m) + 1) / 2, 9) AS score FROM flat f JOIN tmpl USING (i) GROUP BY 1, 2, 3)
"""


@query(
    "j6_template_match",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, t DESC) AS r, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, t DESC) AS other FROM scored)
    SELECT vec_id, label, t AS best, round(score, 6) AS score, round(coalesce(score - other, score), 6) AS margin FROM r WHERE r = 1
    """,
    TEMPLATES,
)
def j6_template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.glyphs(spark, sf_dir)
    out = J.best_template(g, J.templates_of(g))
    return out.select("vec_id", "label", "best", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query(
    "a19_label_stats",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, t DESC) AS r, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, t DESC) AS other FROM scored),
    m AS (SELECT label, t AS best, round(score, 6) AS score, round(coalesce(score - other, score), 6) AS margin FROM r WHERE r = 1),
    k AS (SELECT label, best, count(*) AS times FROM m GROUP BY 1, 2),
    l AS (SELECT label, array_to_string(list(best || ':' || times ORDER BY best), ',') AS kinds FROM k GROUP BY 1)
    SELECT label, count(*) AS n, round(avg(score), 6) AS mean_score, min(score) AS min_score, min(margin) AS min_margin, any_value(kinds) AS best_kinds FROM m JOIN l USING (label) GROUP BY 1
    """,
    TEMPLATES,
)
def a19_label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.label_stats(j6_template_match(spark, sf_dir), "label", "score", "margin", "best")
    kinds = F.array_join(F.transform(F.map_entries("best_kinds"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return out.select("label", "n", F.round("mean_score", 6).alias("mean_score"), "min_score", "min_margin", kinds.alias("best_kinds"))


@query(
    "j2_match_within",
    """
    WITH p AS (SELECT a.stream_id, a.seq, a.piece AS av, b.piece AS bv FROM frames a JOIN frames b ON a.stream_id = b.stream_id - 1 AND a.seq = b.seq)
    SELECT p.stream_id, p.seq, bool_or(p.av IS NOT DISTINCT FROM q.bv) AS near FROM p JOIN p q ON p.stream_id = q.stream_id AND q.seq BETWEEN p.seq - 3 AND p.seq + 3 GROUP BY 1, 2
    """,
    FRAMES,
)
def j2_match_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.frames(spark, sf_dir)
    b = a.withColumn("stream_id", F.col("stream_id") - 1).withColumn("o", F.col("seq"))
    paired = J.pair_runs(a, b, ["stream_id", "seq"], "o", ["piece"])
    return J.matches_within(paired, "piece", 3, "stream_id", "seq").select("stream_id", "seq", "near")


@query(
    "j4_segments",
    """
    WITH b AS (SELECT min(floor(ts / 86400)) * 86400 AS t0 FROM frames),
    s AS (SELECT row_number() OVER (ORDER BY d) AS segment, t0 + d * 259200.0 AS start_s, t0 + d * 259200.0 + 172800.0 AS end_s, 3600.0 AS margin_s FROM b, range(10) r(d))
    SELECT stream_id, seq, segment, segment IS NOT NULL AND ts >= start_s + margin_s AND ts < end_s - margin_s AS scored FROM frames LEFT JOIN s ON ts >= start_s AND ts < end_s
    """,
    FRAMES,
)
def j4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir)
    begin = frames.agg((F.min(F.floor(F.col("ts") / 86400)) * 86400).alias("t0"))
    d = F.explode(F.sequence(F.lit(0), F.lit(9)))
    segments = begin.select("t0", d.alias("d")).select((F.col("d") + 1).cast("long").alias("segment"), (F.col("t0") + F.col("d") * 259200.0).alias("start_s"), (F.col("t0") + F.col("d") * 259200.0 + 172800.0).alias("end_s"), F.lit(3600.0).alias("margin_s"))
    return J.in_segments(frames, segments, "ts", 86400.0).select("stream_id", "seq", "segment", "scored")


@query(
    "p8_player_as_of",
    """
    WITH cards AS (SELECT stream_id, ts, piece AS card FROM frames WHERE state = 'paused' AND piece IS NOT NULL), starts AS (SELECT stream_id, seq, ts FROM frames WHERE state = 'in_game'),
    j AS (SELECT s.stream_id, s.seq, s.ts, c.card, c.ts AS t, row_number() OVER (PARTITION BY s.stream_id, s.seq ORDER BY c.ts DESC, c.card DESC) AS r FROM starts s LEFT JOIN cards c ON c.stream_id = s.stream_id AND c.ts <= s.ts)
    SELECT stream_id, seq, CASE WHEN ts - t <= 86400 THEN card END AS card FROM j WHERE r = 1
    """,
    FRAMES,
)
def p8_player_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir)
    cards = frames.where("state = 'paused' AND piece IS NOT NULL").select("stream_id", "ts", F.col("piece").alias("card"))
    return J.as_of(frames.where("state = 'in_game'").select("stream_id", "ts", "seq"), cards, "stream_id", "ts", "card", 86400.0).select("stream_id", "seq", "card")


@query("j11_slugs", "SELECT page_id, substring(trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 64) AS slug FROM pages")
def j11_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "pages").select("page_id", rules.slug(F.col("url")).alias("slug"))


@query("t1_leaderboard", "SELECT game_id, score, player, station FROM games WHERE status = 'F' ORDER BY score DESC, game_id LIMIT 50", GAMES)
def t1_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.leaderboard(V.games(spark, sf_dir).where("status = 'F'"), 50, "game_id").select("game_id", "score", "player", "station")


@query("t1_station_leaders", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY station, day ORDER BY score DESC, game_id) AS place FROM games) SELECT station, day, place, game_id, score FROM r WHERE place <= 3", GAMES)
def t1_station_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.leaderboard(V.games(spark, sf_dir), 3, "game_id", ["station", "day"]).select("station", "day", F.col("place").cast("long").alias("place"), "game_id", "score")


@query(
    "a21_telemetry",
    """
    WITH g AS (SELECT CAST(floor(ts / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS n, list(conf ORDER BY conf) AS v, count(*) FILTER (state = 'in_game') AS live, sum(raw_score) AS delivered, sum(seq % 3) AS dropped, CAST(sum(lines % 2) AS BIGINT) AS missing FROM frames GROUP BY 1)
    SELECT window_start, n, round(n / 3600, 4) AS rate, round(live / 3600, 4) AS live_hz, round(CASE WHEN delivered > 0 THEN dropped / delivered ELSE 0 END, 4) AS drop_rate, missing, round(v[CAST(round((len(v) - 1) * 0.5) AS BIGINT) + 1], 2) AS p50, round(v[CAST(round((len(v) - 1) * 0.95) AS BIGINT) + 1], 2) AS p95 FROM g
    """,
    FRAMES,
)
def a21_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir)
    samples = frames.select("ts", F.col("conf").alias("x"), (F.col("state") == "in_game").alias("live"), F.col("raw_score").alias("delivered"), (F.col("seq") % 3).alias("dropped"), (F.col("lines") % 2).alias("missing"))
    return A.telemetry(samples, 3600)


@query(
    "a21_counter_deltas",
    "WITH d AS (SELECT stream_id, seq, raw_score, lag(raw_score) OVER (PARTITION BY stream_id ORDER BY seq) AS b FROM frames) SELECT stream_id, seq, CASE WHEN b IS NULL THEN 0 WHEN raw_score < b THEN raw_score ELSE raw_score - b END AS delta FROM d",
    FRAMES,
)
def a21_counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counter_deltas(V.frames(spark, sf_dir), "raw_score").select("stream_id", "seq", "delta")


@query(
    "a22_busy",
    "WITH d AS (SELECT stream_id, seq, (score + lines) - lag(score + lines) OVER w AS t, lines - lag(lines) OVER w AS i FROM frames WINDOW w AS (PARTITION BY stream_id ORDER BY seq)) SELECT stream_id, seq, round(CASE WHEN t > 0 THEN 100 * (t - i) / t END, 6) AS busy FROM d",
    FRAMES,
)
def a22_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = V.frames(spark, sf_dir).withColumn("total", F.col("score") + F.col("lines")).withColumn("idle", F.col("lines"))
    return A.busy_percent(samples).select("stream_id", "seq", F.round("busy", 6).alias("busy"))


@query(
    "a24_otsu",
    """
    WITH c AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS v, count(*) AS n FROM events GROUP BY 1, 2),
    s AS (SELECT user_id, v, sum(n) OVER w AS low, sum(n * v) OVER w AS mo, sum(n) OVER (PARTITION BY user_id) AS tot, sum(n * v) OVER (PARTITION BY user_id) AS am FROM c WINDOW w AS (PARTITION BY user_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT user_id, v, round(coalesce(low / tot * (1 - low / tot) * pow(mo / low - (am - mo) / nullif(tot - low, 0), 2), 0), 6) AS b FROM s)
    SELECT user_id, CASE WHEN max(b) > 0 THEN arg_max(v, (b, -v)) ELSE 0 END AS threshold FROM b GROUP BY 1
    """,
)
def a24_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = V.read(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("v"))
    return A.otsu(pixels, "user_id", "v")


@query("a28_overall_confidence", "SELECT stream_id, seq, round(0.30 * conf + 0.15 * conf * conf + 0.15 * conf + 0.10 * (1 - conf) + 0.30 * conf, 6) AS overall FROM frames", FRAMES)
def a28_overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conf")
    return V.frames(spark, sf_dir).select("stream_id", "seq", F.round(A.overall_confidence(c, c * c, c, 1 - c, c), 6).alias("overall"))


@query(
    "k12_retention",
    "WITH h AS (SELECT o_orderkey AS name, sum(floor(o_totalprice)) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS held FROM orders WHERE o_orderdate >= DATE '1996-01-01') SELECT o_orderkey AS name, CAST(held AS BIGINT) AS held, coalesce(held <= 100000000, FALSE) AS keep FROM orders LEFT JOIN h ON o_orderkey = name",
)
def k12_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").alias("made_at"), F.col("o_orderkey").alias("name"), F.floor("o_totalprice").alias("bytes"))
    return J.retained(files, 100_000_000, 365, F.lit("1996-12-31").cast("date")).select("name", F.col("held").cast("long").alias("held"), "keep")


@query(
    "f1_level_rules",
    """
    WITH x AS (SELECT DISTINCT l_partkey % 30 AS s, l_suppkey % 300 AS n FROM lineitem),
    t AS (SELECT *, least(10 * s + 10, greatest(100, 10 * s - 50)) AS th FROM x),
    e AS (SELECT *, CASE WHEN n < th THEN s ELSE s + 1 + (n - th) // 10 END AS lv FROM t)
    SELECT s, n, th AS threshold, lv AS expected, coalesce((SELECT max(k) FROM range(0, 60) r(k) WHERE k <= lv AND CASE WHEN n < least(10 * k + 10, greatest(100, 10 * k - 50)) THEN k ELSE k + 1 + (n - least(10 * k + 10, greatest(100, 10 * k - 50))) // 10 END = lv), lv) AS inferred FROM e
    """,
)
def f1_level_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 30).alias("s"), (F.col("l_suppkey") % 300).alias("n")).distinct()
    x = x.withColumn("threshold", rules.first_level_threshold(F.col("s"))).withColumn("expected", rules.expected_level(F.col("s"), F.col("n")).cast("long"))
    return x.withColumn("inferred", rules.infer_start_level(F.col("expected"), F.col("n")).cast("long"))


@query(
    "f6_base_sums",
    """
    WITH RECURSIVE r(n, b) AS (SELECT 0, 0 UNION SELECT n + s, b + ([40, 100, 300, 1200])[s] FROM r, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE n + s <= 16)
    SELECT CAST(n AS BIGINT) AS lines, array_to_string(list(b ORDER BY b), ',') AS sums FROM (SELECT DISTINCT n, b FROM r) GROUP BY 1
    """,
)
def f6_base_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(17).select(F.col("id").alias("lines"), F.array_join(rules.base_sums_expr(F.col("id")).cast("array<string>"), ",").alias("sums"))


@query(
    "w25_ema",
    """
    WITH RECURSIVE e(stream_id, seq, m) AS (SELECT stream_id, seq, conf FROM frames WHERE seq = 0 UNION ALL SELECT f.stream_id, f.seq, e.m + 0.3 * (f.conf - e.m) FROM e JOIN frames f ON f.stream_id = e.stream_id AND f.seq = e.seq + 1)
    SELECT stream_id, round(arg_max(m, seq), 6) AS ema FROM e GROUP BY 1
    """.replace("WITH RECURSIVE", "WITH"),
    "RECURSIVE " + FRAMES.strip(),
)
def w25_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ema(V.frames(spark, sf_dir), "conf", 0.3).withColumn("ema", F.round("ema", 6))


@query(
    "conversation_runs",
    "WITH m AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)), r AS (SELECT conv_id, role, sum(c) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, count(*) AS n FROM r GROUP BY 1, 2",
)
def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = V.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), (F.row_number().over(w) - 1).alias("seq"), F.lit(0.0).alias("ts"), "role")
    return W.runs(turns, "role").select(F.col("stream_id").alias("conv_id"), "run", F.col("value").alias("role"), "n")


# Folds and recordings


def play_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a level, and the noisy score as the reading."""
    return V.frames(spark, sf_dir).select("stream_id", "seq", "ts", "state", "conf", F.col("raw_score").alias("score"), "lines", F.floor(F.col("lines") / 10).alias("level"), "piece")


@query("w2_game_fold", None)
def w2_game_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_batch(play_frames(spark, sf_dir), L.GAME)


@query(
    "w9_plausible_score",
    """
    r(stream_id, seq, held, cand, n, reason, severity) AS (
        SELECT stream_id, seq, raw_score, CAST(NULL AS BIGINT), 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM frames WHERE seq = 0
        UNION ALL
        SELECT x.stream_id, x.seq, CASE WHEN x.ok OR x.k >= 6 THEN x.v ELSE x.held END, CASE WHEN x.ok OR x.k >= 6 THEN NULL ELSE x.v END, CASE WHEN x.ok OR x.k >= 6 THEN 0 ELSE x.k END,
            CASE WHEN x.ok THEN NULL WHEN x.v < x.held THEN 'monotonic' ELSE 'score_jump' END, CASE WHEN x.ok THEN NULL WHEN x.k >= 6 THEN 'correct' ELSE 'reject' END
        FROM (SELECT f.stream_id, f.seq, f.raw_score // 40 AS v, r.held, f.raw_score // 40 BETWEEN r.held AND r.held + 5 AS ok, CASE WHEN f.raw_score // 40 = r.cand THEN r.n + 1 ELSE 1 END AS k FROM r JOIN frames f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1) x
    )
    SELECT stream_id, seq, CASE WHEN seq = 0 THEN held // 40 ELSE held END AS value, reason, severity FROM r
    """.replace("SELECT stream_id, seq, raw_score, CAST", "SELECT stream_id, seq, raw_score // 40, CAST").replace("CASE WHEN seq = 0 THEN held // 40 ELSE held END", "held").replace("r(stream_id", "WITH r(stream_id", 1),
    "RECURSIVE " + FRAMES.strip(),
)
def w9_plausible_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir).withColumn("score", F.floor(F.col("raw_score") / 40))
    return L.run_batch(frames.select("stream_id", "seq", "score"), L.guard_fold("score", 5, "score_jump"))


@query(
    "k14_publish",
    """
    WITH r(stream_id, seq, k, t, n, sent) AS (
        SELECT stream_id, seq, state, ts, CAST(0 AS BIGINT), TRUE FROM frames WHERE seq = 0
        UNION ALL
        SELECT f.stream_id, f.seq, CASE WHEN p THEN f.state ELSE k END, CASE WHEN p THEN f.ts ELSE t END, CASE WHEN p THEN n + 1 ELSE n END, p
        FROM (SELECT r.*, g.seq AS next_seq, g.state <> r.k AND g.ts - r.t >= 20000 - 0.004 AS p FROM r JOIN frames g ON g.stream_id = r.stream_id AND g.seq = r.seq + 1) q JOIN frames f ON f.stream_id = q.stream_id AND f.seq = q.next_seq
    )
    SELECT stream_id, seq, n AS out_seq FROM r WHERE sent
    """,
    "RECURSIVE " + FRAMES.strip(),
)
def k14_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_batch(V.frames(spark, sf_dir).select("stream_id", "seq", "ts", "state"), L.publish_fold(20000.0, ("state",)))


@query(
    "w17_timeline",
    """
    WITH r(stream_id, seq, t, kept) AS (
        SELECT stream_id, seq, ts, TRUE FROM frames WHERE seq = 0
        UNION ALL
        SELECT f.stream_id, f.seq, CASE WHEN f.ts - r.t >= 20000 THEN f.ts ELSE r.t END, f.ts - r.t >= 20000 FROM r JOIN frames f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1
    )
    SELECT r.stream_id, r.seq, round(f.ts, 3) AS ts, CAST(f.raw_score AS DOUBLE) AS height FROM r JOIN frames f ON f.stream_id = r.stream_id AND f.seq = r.seq WHERE kept
    """,
    "RECURSIVE " + FRAMES.strip(),
)
def w17_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir).select("stream_id", "seq", "ts", "raw_score")
    return L.run_batch(frames, L.timeline_fold("raw_score", 20000.0)).withColumn("ts", F.round("ts", 3))


def slow_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as twelve frames of a sixtieth of a second, so that values settle."""
    frames = play_frames(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return frames.withColumn("seq", F.col("seq") * 12 + F.col("k")).withColumn("ts", F.col("seq") / 60).drop("k")


@query("w20_cheats", None)
def w20_cheats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rising = V.frames(spark, sf_dir).select("stream_id", "seq", F.col("score").alias("total"))
    frames = slow_frames(spark, sf_dir).withColumn("event_seq", F.floor(F.col("seq") / 12))
    joined = frames.join(rising.withColumnRenamed("seq", "event_seq"), ["stream_id", "event_seq"]).withColumn("score", F.col("total") * 60)
    return L.run_batch(joined.select("stream_id", "seq", "ts", "state", "score", "lines", "level"), L.CHEAT)


@query("session_games", None)
def session_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_batch(play_frames(spark, sf_dir).select("stream_id", "seq", "ts", "state", "score", "lines", "level"), L.session_fold(3, 2, 7200.0))


@query(
    "w27_base_latch",
    """
    WITH b AS (SELECT stream_id, seq, CASE WHEN conf > 0.4 THEN 'dec' WHEN conf > 0.05 THEN 'hex' END AS base FROM frames),
    r(stream_id, seq, last, n, latched) AS (
        SELECT stream_id, seq, base, CASE WHEN base IS NULL THEN 0 ELSE 1 END, CAST(NULL AS VARCHAR) FROM b WHERE seq = 0
        UNION ALL
        SELECT x.stream_id, x.seq, x.base, x.k, CASE WHEN x.k >= 3 THEN x.base ELSE x.latched END
        FROM (SELECT b.*, r.latched, CASE WHEN b.base IS NULL THEN 0 WHEN b.base = r.last THEN r.n + 1 ELSE 1 END AS k FROM r JOIN b ON b.stream_id = r.stream_id AND b.seq = r.seq + 1) x
    )
    SELECT stream_id, seq, latched FROM r
    """,
    "RECURSIVE " + FRAMES.strip(),
)
def w27_base_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("conf") > 0.05, F.when(F.col("conf") > 0.4, "dec").otherwise("hex"))
    return L.run_batch(V.frames(spark, sf_dir).select("stream_id", "seq", base.alias("base")), L.latch_fold(3))


@query(
    "w23_curtain",
    """
    WITH f AS (SELECT stream_id, seq, lines % 5 AS full_rows FROM frames),
    r(stream_id, seq, held, steps) AS (
        SELECT stream_id, seq, full_rows, CASE WHEN full_rows >= 2 THEN 1 ELSE 0 END FROM f WHERE seq = 0
        UNION ALL
        SELECT f.stream_id, f.seq, f.full_rows, CASE WHEN f.full_rows < r.held THEN 0 WHEN f.full_rows > r.held AND f.full_rows >= 2 THEN r.steps + 1 ELSE r.steps END FROM r JOIN f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1
    )
    SELECT stream_id, seq, steps >= 2 AS falling FROM r
    """,
    "RECURSIVE " + FRAMES.strip(),
)
def w23_curtain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_batch(V.frames(spark, sf_dir).select("stream_id", "seq", (F.col("lines") % 5).alias("full_rows")), L.curtain_fold())


ANIMATION_SQL = """
    WITH f AS (SELECT stream_id, seq, conf * 100 AS luma, [CAST(raw_score % 4 AS BIGINT), CAST(lines % 4 AS BIGINT), CAST((seq // 2) % 4 AS BIGINT)] AS board, state = 'paused' AS suppress FROM frames),
    r(stream_id, seq, mean, on_, age, calm, board, flash) AS (
        SELECT stream_id, seq, luma, FALSE, 0, 0, board, FALSE FROM f WHERE seq = 0
        UNION ALL
        SELECT z.stream_id, z.seq, CASE WHEN z.now THEN z.mean ELSE 0.9 * z.mean + 0.1 * z.luma END, z.now, CASE WHEN z.was THEN z.age2 WHEN z.now THEN 0 ELSE z.age END, CASE WHEN z.was THEN z.calm2 WHEN z.now THEN 0 ELSE z.calm END, z.board, z.fl
        FROM (
            SELECT y.*, CASE WHEN y.was THEN NOT (y.calm2 >= 2 OR y.age2 >= 20) ELSE NOT y.suppress AND (y.fl OR y.retract) END AS now
            FROM (
                SELECT f.stream_id, f.seq, f.luma, f.board, f.suppress, r.mean, r.on_ AS was, r.age, r.calm, r.age + 1 AS age2, CASE WHEN f.board = r.board THEN r.calm + 1 ELSE 0 END AS calm2,
                    r.mean > 20 AND f.luma > 1.5 * r.mean AS fl,
                    (r.board[1] = 3 AND f.board[1] <> 3) OR (r.board[2] = 3 AND f.board[2] <> 3) OR (r.board[3] = 3 AND f.board[3] <> 3) AS retract
                FROM r JOIN f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1
            ) y
        ) z
    )
    SELECT stream_id, seq, on_ AS animating, flash FROM r
    """


@query("w22_animation", ANIMATION_SQL, "RECURSIVE " + FRAMES.strip())
def w22_animation(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = F.array(F.col("raw_score") % 4, F.col("lines") % 4, F.floor(F.col("seq") / 2) % 4)
    rows = V.frames(spark, sf_dir).select("stream_id", "seq", (F.col("conf") * 100).alias("luma"), board.alias("board"), (F.col("state") == "paused").alias("suppress"))
    return L.run_batch(rows, L.animation_fold(2)).select("stream_id", "seq", "animating", "flash")


@query(
    "s8_recordings",
    """
    SELECT stream_id, idx, ctime_ms, lines, level, score, preview, counts_0, cells FROM (
        SELECT stream_id, seq AS idx, seq * 17 AS ctime_ms, CAST(least(lines, 4094) AS INTEGER) AS lines, CAST(least(lines // 10, 255) AS INTEGER) AS level, least(raw_score, 16777214) AS score, piece AS preview,
            CAST(least(lines * 9, 1022) AS INTEGER) AS counts_0, CAST((seq % 4) * 200 AS BIGINT) AS cells FROM frames)
    """,
    FRAMES,
)
def s8_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    records = V.frames(spark, sf_dir).select(
        "stream_id", (seq * 17).alias("ctime_ms"), F.lit(1).alias("game_type"), F.lit(0).alias("player_num"), (F.col("stream_id") % 65535 + 1).cast("int").alias("gameid"), F.col("lines"), F.floor(F.col("lines") / 10).alias("level"),
        F.col("raw_score").alias("score"), F.lit(None).cast("int").alias("instant_das"), F.col("piece").alias("preview"), F.lit(None).cast("int").alias("cur_piece_das"), F.lit(None).cast("string").alias("cur_piece"),
        F.array_repeat((F.col("lines") * 9).cast("int"), 7).alias("counts"), F.array_repeat((seq % 4).cast("int"), 200).alias("field"),
    )
    out = R.decoded_games(R.encoded_games(records, "stream_id"), "stream_id")
    return out.select("stream_id", "idx", "ctime_ms", "lines", "level", "score", "preview", F.col("counts")[0].alias("counts_0"), F.aggregate("field", F.lit(0), lambda s, x: s + x).cast("long").alias("cells"))


@query("a20_trimmed_templates", None)
def a20_trimmed_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.trimmed_templates(V.glyphs(spark, sf_dir), 0.0, most_std=0.13)


@query(
    "a15_validation",
    """
    WITH c AS (SELECT game_id, count(*) AS pieces, CAST(sum(size) AS BIGINT) AS counted, max(level) AS end_level, CAST(sum(([40, 100, 300, 1200])[size] * (level + 1)) AS BIGINT) AS clear_points FROM clears GROUP BY 1),
    g AS (SELECT c.*, CAST(floor(score) AS BIGINT) AS end_score, game_id % 7 AS k, CASE WHEN game_id % 9 > 0 THEN game_id % 4 END AS start_level, counted + game_id % 5 AS end_lines, game_id % 31 = 0 AS absent FROM c JOIN games USING (game_id)),
    e AS (SELECT *, least(10 * start_level + 10, greatest(100, 10 * start_level - 50)) AS threshold, end_score - (CASE WHEN k = 0 THEN 5 ELSE 0 END) - clear_points - 10000 * (CASE WHEN game_id % 11 = 0 THEN 1 ELSE 0 END) AS rest FROM g),
    f AS (SELECT game_id, list_filter([CASE WHEN game_id % 101 = 0 THEN 'error:engine_restart' END, CASE WHEN absent THEN 'error:no_gameplay' END, CASE WHEN k = 0 THEN 'error:partial_game' END,
        CASE WHEN game_id % 5 > 1 THEN 'error:lines_clears_mismatch' END,
        CASE WHEN end_level <> (CASE WHEN end_lines < threshold THEN start_level ELSE start_level + 1 + (end_lines - threshold) // 10 END) THEN 'warning:level_mismatch' END,
        CASE WHEN end_score < 999999 AND (rest < -1000 OR rest > 40 * pieces + 1000) THEN 'error:score_reconcile' END,
        CASE WHEN game_id % 13 = 0 THEN 'warning:score_unexplained' END, CASE WHEN game_id % 17 = 0 THEN 'warning:level_score_mismatch' END,
        CASE WHEN NOT absent AND game_id % 10 >= 3 THEN 'error:low_confidence' END, CASE WHEN NOT absent AND game_id % 10 BETWEEN 1 AND 2 THEN 'warning:low_confidence' END,
        CASE WHEN game_id % 12 >= 10 THEN 'error:signal_lost' END, CASE WHEN game_id % 12 BETWEEN 2 AND 9 THEN 'warning:signal_lost' END,
        CASE WHEN game_id % 25 >= 20 THEN 'warning:plausibility_corrections' END, CASE WHEN game_id % 97 = 0 THEN 'error:value_range' END], lambda x: x IS NOT NULL) AS issues FROM e)
    SELECT game_id, array_to_string(issues, ',') AS issues, len(list_filter(issues, lambda x: starts_with(x, 'error'))) = 0 AS valid FROM f
    """,
    CLEARS,
    GAMES,
)
def a15_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, game, one = rules.clear_base_score(F.col("size")), F.col("game_id"), lambda c: c.cast("int")
    stats = V.clears(spark, sf_dir).groupBy("game_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("counted"), F.max("level").alias("end_level"), F.sum(base * (F.col("level") + 1)).alias("clear_points"))
    absent = game % 31 == 0
    summary = stats.join(V.games(spark, sf_dir).select("game_id", F.floor("score").alias("end_score")), "game_id").select(
        "*", one(game % 101 == 0).alias("restarts"), F.when(absent, 0).otherwise(10).alias("ingame_frames"), F.when(game % 7 == 0, 5).otherwise(0).alias("start_score"), F.lit(0).alias("start_lines"),
        F.when(game % 9 > 0, game % 4).alias("start_level"), (F.col("counted") + game % 5).alias("end_lines"), (10000 * one(game % 11 == 0)).alias("cheat_points"), one(game % 13 == 0).alias("anomalies"),
        one(game % 17 == 0).alias("level_offset_steps"), (game % 10).alias("low_frames"), (game % 12).cast("double").alias("lost_seconds"), (game % 25).alias("rejects"), F.when(game % 97 == 0, F.lit("level 300")).alias("out_of_range"),
    )
    return A.validation(summary).select("game_id", F.array_join("issues", ",").alias("issues"), "valid")


@query(
    "j10_seek",
    """
    SELECT t.stream_id, t.at_ms, coalesce(max(f.seq) FILTER (f.seq * 17 <= t.at_ms), 0) AS idx FROM (SELECT DISTINCT stream_id, lines * 100 - 50 AS at_ms FROM frames) t JOIN frames f ON f.stream_id = t.stream_id GROUP BY 1, 2
    """,
    FRAMES,
)
def j10_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir)
    records = frames.select("stream_id", F.col("seq").alias("idx"), (F.col("seq") * 17).alias("ctime_ms"))
    times = frames.select("stream_id", (F.col("lines") * 100 - 50).alias("at_ms")).distinct()
    return R.replay_seek(records, times, "stream_id")
