"""Queries over a station's life: views, checks, stores, locks, recordings, status and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.operators import aggregates as A
from framefold.operators import folds as L
from framefold.operators import frames as V
from framefold.operators import matching as M
from framefold.operators import states as S
from framefold.plans.registry import FRAMES, GAMES, query
from framefold.plans.scalars import VECTORS, e, vectors
from framefold.sources import stores

DEEP = "RECURSIVE " + FRAMES.strip()


@query(
    "p7_live_view",
    """
    SELECT stream_id, seq, state, round(conf / 7, 4) AS confidence, CASE WHEN state = 'in_game' THEN least(raw_score % 12, 9) || '' || least(lines % 11, 9) || '/' || least(seq % 13, 9) || '0' END AS board FROM frames
    """,
    FRAMES,
)
def p7_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = F.array(F.array(F.col("raw_score") % 12, F.col("lines") % 11), F.array(F.col("seq") % 13, F.lit(0).cast("long")))
    rows = V.frames(spark, sf_dir).select("stream_id", "seq", "state", (F.col("conf") / 7).alias("confidence"), board.alias("board"))
    return S.live_view(rows).withColumn("board", F.array_join("board", "/"))


@query(
    "p9_value_range",
    """
    WITH v AS (SELECT stream_id, seq, raw_score % 300 AS level, lines * 900 AS lines, raw_score * 90000 AS score FROM frames),
    f AS (SELECT *, CASE WHEN level > 255 THEN 'level ' || level WHEN lines > 9999 THEN 'lines ' || lines WHEN score > 16777215 THEN 'score ' || score END AS fault FROM v)
    SELECT stream_id, arg_min(fault, seq) FILTER (fault IS NOT NULL) AS out_of_range FROM f GROUP BY 1
    """,
    FRAMES,
)
def p9_value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.frames(spark, sf_dir).select("stream_id", "seq", (F.col("raw_score") % 300).alias("level"), (F.col("lines") * 900).alias("lines"), (F.col("raw_score") * 90000).alias("score"))
    return A.out_of_range(rows)


@query(
    "j3_verify",
    """
    WITH p AS (SELECT a.stream_id, a.seq, a.piece AS ap, b.piece AS bp, a.state AS as_, b.state AS bs FROM frames a JOIN frames b ON a.stream_id = b.stream_id - 1 AND a.seq = b.seq),
    n AS (SELECT p.stream_id, p.seq, any_value(p.ap IS DISTINCT FROM p.bp) AS dp, any_value(p.as_ IS DISTINCT FROM p.bs) AS ds, bool_or(p.ap IS NOT DISTINCT FROM q.bp) AS np, bool_or(p.as_ IS NOT DISTINCT FROM q.bs) AS ns FROM p JOIN p q ON p.stream_id = q.stream_id AND q.seq BETWEEN p.seq - 3 AND p.seq + 3 GROUP BY 1, 2)
    SELECT stream_id, 'piece' AS field, count(*) AS paired, count(*) FILTER (dp) AS differs, count(*) FILTER (NOT np) AS wrong FROM n GROUP BY 1 UNION ALL SELECT stream_id, 'state', count(*), count(*) FILTER (ds), count(*) FILTER (NOT ns) FROM n GROUP BY 1
    """,
    FRAMES,
)
def j3_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = V.frames(spark, sf_dir)
    return M.verify_runs(got, got.withColumn("stream_id", F.col("stream_id") - 1), "stream_id", "seq", ["piece", "state"])


@query(
    "j9_recording_games",
    """
    WITH r AS (SELECT o_orderkey AS recording, o_custkey % 50 AS station, epoch_us(o_orderdate) // 1000000 AS ended FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT o_orderkey AS game_id, o_custkey % 50 AS station, epoch_us(o_orderdate) // 1000000 AS announced_at FROM orders WHERE o_orderstatus <> 'F')
    SELECT recording, r.station, ended, arg_max(game_id, (announced_at, game_id)) AS game_id FROM r LEFT JOIN g ON r.station = g.station AND announced_at <= ended GROUP BY ALL
    """,
)
def j9_recording_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000000)
    orders = V.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("station"), at.alias("at"), "o_orderstatus")
    recordings = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("recording"), "station", F.col("at").alias("ended"))
    games = orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("game_id"), "station", F.col("at").alias("announced_at"))
    return M.recording_games(recordings, games).select("recording", "station", "ended", "game_id")


@query(
    "t3_best_of_kinds",
    """
    WITH b AS (SELECT l_orderkey, l_returnflag AS kind, max((l_quantity, l_linenumber)) AS top FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY top DESC, kind DESC) AS r, lead(top[1]) OVER (PARTITION BY l_orderkey ORDER BY top DESC, kind DESC) AS other FROM b)
    SELECT l_orderkey, kind, top[1] AS score, coalesce(top[1] - other, top[1]) AS margin FROM r WHERE r = 1
    """,
)
def t3_best_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_of_kinds(V.read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "kind"), "l_orderkey", "kind", "l_linenumber", "l_quantity")


@query(
    "t7_first_peak",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_quantity DESC, l_suppkey, l_linenumber) AS r FROM lineitem) SELECT l_partkey % 50 AS image_id, l_suppkey AS y, l_linenumber AS x, l_quantity AS value FROM r WHERE r = 1",
)
def t7_first_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("image_id"), F.col("l_suppkey").alias("y"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("value"))
    return M.first_peak(rows, "image_id", "y", "x", "value")


@query("t2_near_candidates", None)
def t2_near_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 100).cast("double").alias("y"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("nth"))
    return M.near_candidates(rows).select("image_id", "x", "y", "score", "place")


@query(
    "k8_spool",
    """
    WITH m AS (SELECT o_custkey % 20 AS station, printf('%013d-%06d', epoch_ms(o_orderdate), o_orderkey % 1000000) AS id FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY id DESC) AS r FROM m WHERE TRUE), k AS (SELECT station, id, CAST(row_number() OVER (PARTITION BY station ORDER BY id) AS INTEGER) AS place FROM n WHERE r <= 50)
    SELECT station, id, place, CAST((place - 1) // 32 AS BIGINT) AS batch FROM k
    """,
)
def k8_spool(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.read(spark, sf_dir, "orders")
    messages = orders.select((F.col("o_custkey") % 20).alias("station"), stores.spool_id(F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")).alias("id"))
    return stores.spooled(messages, 50)


@query("k15_store", "SELECT game_id, player, score, day FROM games ORDER BY day DESC, game_id DESC LIMIT 2000", GAMES)
def k15_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.kept_games(V.games(spark, sf_dir).select("game_id", "player", "score", "day"), ["day", "game_id"])


@query(
    "w5_counts_hold",
    """
    WITH c AS (SELECT stream_id, seq, conf, CASE WHEN seq % 4 > 0 THEN raw_score % 50 END AS a, CASE WHEN seq % 4 > 0 THEN lines END AS b FROM frames)
    SELECT stream_id, seq, max(a) OVER w AS t, max(b) OVER w AS j, round(last_value(CASE WHEN a IS NOT NULL AND conf > 0 THEN conf END IGNORE NULLS) OVER w * 0.9 ** (seq - last_value(CASE WHEN a IS NOT NULL AND conf > 0 THEN seq END IGNORE NULLS) OVER w), 6) AS confidence
    FROM c WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING)
    """,
    FRAMES,
)
def w5_counts_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.when(F.col("seq") % 4 > 0, F.array(F.col("raw_score") % 50, F.col("lines")))
    out = S.counts_hold(V.frames(spark, sf_dir).withColumn("counts", counts), "counts", 2)
    return out.select("stream_id", "seq", F.col("held_counts")[0].alias("t"), F.col("held_counts")[1].alias("j"), F.round("counts_confidence", 6).alias("confidence"))


@query(
    "w6_piece_vote",
    """
    WITH read AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM frames WHERE piece IS NOT NULL AND conf > 0),
    sums AS (SELECT a.stream_id, a.seq, b.piece AS v, sum(b.conf) AS s, count(*) AS k, min(b.n) AS first_at FROM read a JOIN read b ON a.stream_id = b.stream_id AND b.n BETWEEN a.n - 4 AND a.n GROUP BY 1, 2, 3),
    best AS (SELECT *, row_number() OVER (PARTITION BY stream_id, seq ORDER BY round(s, 9) DESC, first_at) AS r FROM sums),
    held AS (SELECT f.stream_id, f.seq, last_value(v IGNORE NULLS) OVER w AS v, last_value(round(s, 9) / k IGNORE NULLS) OVER w * 0.9 ** (f.seq - last_value(best.seq IGNORE NULLS) OVER w) AS c, last_value(CASE WHEN v IS NOT NULL THEN f.raw_score END IGNORE NULLS) OVER w AS cells, last_value(CASE WHEN f.seq % 3 = 0 THEN f.lines END IGNORE NULLS) OVER w AS place
        FROM frames f LEFT JOIN best ON f.stream_id = best.stream_id AND f.seq = best.seq AND r = 1 WINDOW w AS (PARTITION BY f.stream_id ORDER BY f.seq ROWS UNBOUNDED PRECEDING))
    SELECT stream_id, seq, round(c, 6) AS piece_confidence, CASE WHEN c >= 0.4 THEN v END AS fused_piece, CASE WHEN c >= 0.4 THEN cells END AS fused_cells, place AS fused_place FROM held
    """,
    FRAMES,
)
def w6_piece_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir).withColumn("place", F.when(F.col("seq") % 3 == 0, F.col("lines")))
    out = S.piece_vote(frames, "piece", "raw_score", "place")
    return out.select("stream_id", "seq", F.round("piece_confidence", 6).alias("piece_confidence"), "fused_piece", "fused_cells", "fused_place")


@query(
    "w14_rail",
    """
    WITH f AS (SELECT stream_id, seq, piece, CASE WHEN seq % 3 <> 1 AND conf * 1.25 >= 0.5 THEN seq // 2 END AS total, CASE WHEN seq % 3 <> 1 AND conf * 1.25 >= 0.5 THEN (seq // 2 + 6) // 7 END AS i FROM frames),
    r(stream_id, seq, nxt, pieces, drought, most, rail, rail_i) AS (
        SELECT stream_id, seq, piece, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), total, i FROM f WHERE seq = 0
        UNION ALL
        SELECT y.stream_id, y.seq, coalesce(y.piece, y.nxt), CASE WHEN y.total IS NOT NULL AND y.total - coalesce(y.rail, 0) BETWEEN 1 AND 8 THEN greatest(y.p, y.total) ELSE y.p END,
            CASE WHEN y.i > y.rail_i THEN 0 ELSE y.d END, greatest(y.most, y.d), coalesce(y.total, y.rail), coalesce(y.i, y.rail_i)
        FROM (
            SELECT f.*, r.nxt, r.rail, r.rail_i, r.most, CASE WHEN f.piece <> r.nxt THEN r.pieces + 1 ELSE r.pieces END AS p, CASE WHEN f.piece <> r.nxt THEN CASE WHEN r.nxt = 'I' THEN 0 ELSE r.drought + 1 END ELSE r.drought END AS d
            FROM r JOIN f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1
        ) y
    )
    SELECT stream_id, seq, pieces, drought, most AS max_drought, rail FROM r
    """,
    DEEP,
)
def w14_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.floor(F.col("seq") / 2)
    counts = F.when(F.col("seq") % 3 != 1, F.array(*(F.floor((total + k) / 7) for k in range(7))))  # these add to total
    rows = V.frames(spark, sf_dir).select("stream_id", "seq", "ts", "piece", counts.alias("counts"), (F.col("conf") * 1.25).alias("rail_conf"))
    return L.run_batch(rows, L.rail_fold())


@query(
    "w32_lock",
    """
    WITH f AS (SELECT stream_id, seq, seq % 2 = 0 AS solved, CASE WHEN conf > 0.2 THEN conf END AS found, conf > 0.8 AS dark, state = 'paused' AS hold FROM frames),
    first AS (SELECT stream_id, min(seq) - 1 AS seq FROM f GROUP BY 1),
    r(stream_id, seq, st, streak, weak, c) AS (
        SELECT stream_id, seq, 'unlocked', 0, 0, CAST(0 AS DOUBLE) FROM first
        UNION ALL
        SELECT z.stream_id, z.seq, z.st, CASE WHEN z.st = 'lost' THEN 0 ELSE z.streak END, CASE WHEN z.st = 'lost' OR (z.open_ AND z.st = 'locked') THEN 0 ELSE z.weak END, CASE WHEN z.st = 'lost' AND NOT z.open_ THEN 0 ELSE z.c END
        FROM (
            SELECT y.stream_id, y.seq, y.open_, CASE WHEN y.open_ THEN y.k ELSE y.streak END AS streak,
                CASE WHEN y.open_ THEN CASE WHEN y.k >= 2 THEN 'locked' ELSE 'acquiring' END WHEN y.better OR y.dark OR y.hold THEN 'locked' WHEN y.weak + 1 >= 12 THEN 'lost' ELSE 'drift' END AS st,
                CASE WHEN y.open_ THEN y.weak WHEN y.better OR y.dark THEN 0 WHEN y.hold THEN y.weak ELSE y.weak + 1 END AS weak,
                CASE WHEN y.open_ THEN coalesce(y.found, 0) WHEN y.better THEN y.found WHEN y.dark OR y.hold THEN y.c WHEN y.tried THEN coalesce(y.found, 0) ELSE y.c END AS c
            FROM (
                SELECT x.*, x.tried AND x.found IS NOT NULL AND x.found >= 0.4 AND x.found > x.c + 0.05 AS better, CASE WHEN x.found >= 0.55 THEN x.streak + 1 ELSE 0 END AS k
                FROM (SELECT f.*, r.streak, r.weak, r.c, r.st IN ('unlocked', 'acquiring', 'lost') AS open_, f.solved AND NOT f.hold AS tried FROM r JOIN f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1) x
            ) y
        ) z
    )
    SELECT stream_id, seq, st AS state, round(c, 6) AS confidence FROM r WHERE st <> 'unlocked'
    """,
    DEEP,
)
def w32_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.col("conf")
    rows = V.frames(spark, sf_dir).select("stream_id", "seq", (F.col("seq") % 2 == 0).alias("solved"), F.when(conf > 0.2, conf).alias("found"), (conf > 0.8).alias("dark_ok"), (F.col("state") == "paused").alias("hold"))
    return L.run_batch(rows, S.lock_fold()).withColumn("confidence", F.round("confidence", 6))


@query(
    "w34_status",
    """
    WITH r(stream_id, seq, k, t, sent, changed) AS (
        SELECT stream_id, seq, state, ts, TRUE, TRUE FROM frames WHERE seq = 0
        UNION ALL
        SELECT q.stream_id, q.seq, CASE WHEN q.p THEN q.state ELSE q.k END, CASE WHEN q.p THEN q.ts ELSE q.t END, q.p, q.state <> q.k
        FROM (SELECT f.*, r.k, r.t, f.ts - r.t >= 40000 OR (f.state <> r.k AND f.ts - r.t >= 5000) AS p FROM r JOIN frames f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1) q
    )
    SELECT stream_id, seq, changed FROM r WHERE sent
    """,
    DEEP,
)
def w34_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_batch(V.frames(spark, sf_dir).select("stream_id", "seq", "ts", F.col("state").alias("key")), S.status_fold(40000.0, 5000.0))


@query(
    "w36_latched_read",
    """
    WITH f AS (SELECT stream_id, seq, CASE WHEN raw_score % 5 > 0 THEN raw_score END AS dec, CASE WHEN raw_score % 3 = 0 THEN raw_score + 1 END AS hex, conf AS dc, CAST(seq % 10 AS DOUBLE) / 10 AS hc FROM frames),
    first AS (SELECT stream_id, min(seq) - 1 AS seq FROM f GROUP BY 1),
    r(stream_id, seq, v, base, last, n, latched) AS (
        SELECT stream_id, seq, CAST(NULL AS BIGINT), '', CAST(NULL AS VARCHAR), 0, CAST(NULL AS VARCHAR) FROM first
        UNION ALL
        SELECT z.stream_id, z.seq, z.v, z.base, z.last, z.n, z.latched
        FROM (
            SELECT y.stream_id, y.seq, CASE WHEN y.base = 'dec' THEN y.dec ELSE y.hex END AS v, y.base,
                CASE WHEN y.latched IS NULL THEN CASE WHEN y.read THEN y.base END WHEN y.base <> y.latched THEN y.base ELSE y.last END AS last,
                CASE WHEN y.latched IS NULL THEN CASE WHEN NOT y.read THEN 0 WHEN y.base = y.last THEN y.n + 1 ELSE 1 END WHEN y.base <> y.latched THEN 3 ELSE y.n END AS n,
                CASE WHEN y.latched IS NULL THEN CASE WHEN y.read AND (CASE WHEN y.base = y.last THEN y.n + 1 ELSE 1 END) >= 3 THEN y.base END ELSE y.base END AS latched
            FROM (
                SELECT x.*, CASE WHEN x.base = 'dec' THEN x.dec IS NOT NULL ELSE x.hex IS NOT NULL END AS read
                FROM (
                    SELECT f.*, r.last, r.n, r.latched, CASE WHEN r.latched IS NULL THEN CASE WHEN f.hex IS NOT NULL AND (f.dec IS NULL OR f.hc > f.dc + 1e-6) THEN 'hex' ELSE 'dec' END
                        WHEN r.latched = 'dec' THEN CASE WHEN f.dec IS NULL AND f.hex IS NOT NULL THEN 'hex' ELSE 'dec' END ELSE CASE WHEN f.hex IS NULL AND f.dec IS NOT NULL THEN 'dec' ELSE 'hex' END END AS base
                    FROM r JOIN f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1
                ) x
            ) y
        ) z
    )
    SELECT stream_id, seq, v AS value, base, latched FROM r WHERE base <> ''
    """,
    DEEP,
)
def w36_latched_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("raw_score")
    rows = V.frames(spark, sf_dir).select("stream_id", "seq", F.when(s % 5 > 0, s).alias("dec"), F.when(s % 3 == 0, s + 1).alias("hex"), F.col("conf").alias("dec_conf"), (F.col("seq") % 10 / 10).alias("hex_conf"))
    return L.run_batch(rows, L.latched_read_fold(3))


@query(
    "w38_backoff",
    """
    WITH first AS (SELECT stream_id, min(seq) - 1 AS seq FROM frames GROUP BY 1),
    r(stream_id, seq, retry_in, wait) AS (
        SELECT stream_id, seq, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM first
        UNION ALL
        SELECT x.stream_id, x.seq, x.w, least(2 * x.w, 30) FROM (SELECT f.stream_id, f.seq, CASE WHEN f.conf * 12 >= 10 THEN 1 ELSE r.wait END AS w FROM r JOIN frames f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1) x
    )
    SELECT stream_id, seq, retry_in FROM r WHERE retry_in > 0
    """,
    DEEP,
)
def w38_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_batch(V.frames(spark, sf_dir).select("stream_id", "seq", (F.col("conf") * 12).alias("lasted")), S.backoff_fold(1.0, 30.0))


@query(
    "w35_cards",
    """
    WITH c AS (SELECT stream_id, seq, CASE state WHEN 'in_game' THEN 'present' WHEN 'paused' THEN 'hello' WHEN 'level_select' THEN 'disconnect' ELSE CASE WHEN seq % 2 = 0 THEN 'removed' ELSE 'status' END END AS kind, piece AS uid, 1 + CASE WHEN lines % 3 > 0 THEN 1 ELSE 0 END AS protocol FROM frames),
    t AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'hello' THEN protocol = 2 WHEN kind = 'disconnect' THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS trusted FROM c WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, CASE WHEN NOT trusted THEN CASE WHEN kind IN ('hello', 'disconnect') THEN '-' END WHEN kind IN ('hello', 'present', 'status') THEN coalesce(uid, '-') WHEN kind = 'removed' THEN '-' END AS told FROM t)
    SELECT stream_id, seq, nullif(last_value(told IGNORE NULLS) OVER w, '-') AS present_uid, last_value(CASE WHEN trusted AND kind IN ('hello', 'present', 'status') THEN uid END IGNORE NULLS) OVER w AS last_seen FROM m WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING)
    """,
    FRAMES,
)
def w35_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("state")
    kind = F.when(state == "in_game", "present").when(state == "paused", "hello").when(state == "level_select", "disconnect").when(F.col("seq") % 2 == 0, "removed").otherwise("status")
    cards = V.frames(spark, sf_dir).select("stream_id", "seq", kind.alias("kind"), F.col("piece").alias("uid"), F.when(F.col("lines") % 3 > 0, 2).otherwise(1).alias("protocol"))
    return S.trusted_cards(cards).select("stream_id", "seq", "present_uid", "last_seen")


@query("st7_recordings", None)
def st7_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.frames(spark, sf_dir).select("stream_id", "seq", "ts", "state", (F.col("seq") % 40 == 5).alias("new_game"), "lines", F.col("raw_score").alias("score"), "piece")
    out = L.run_batch(rows, S.recorder_fold(end_frames=6, least_frames=10))
    return out.select("stream_id", "gameid", "start_seq", "frames", F.length("recording").cast("long").alias("bytes"))


@query("st9_queue", None)
def st9_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.frames(spark, sf_dir).select("stream_id", "seq", F.when(F.col("state") == "paused", "take").otherwise("put").alias("kind"))
    return L.run_batch(rows, S.queue_fold(8))


@query("st8_epochs", "SELECT stream_id, seq, CAST(sum(CASE WHEN state = 'level_select' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM frames", FRAMES)
def st8_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.epochs(V.frames(spark, sf_dir).withColumn("cut", F.col("state") == "level_select"), "cut").select("stream_id", "seq", "epoch")


@query(
    "k13_report",
    "SELECT state, count(*) FILTER (piece = 'T') AS \"T\", count(*) FILTER (piece = 'I') AS \"I\", count(*) FILTER (piece IS NULL) AS missing FROM frames GROUP BY 1",
    FRAMES,
)
def k13_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.frames(spark, sf_dir).select("state", F.coalesce("piece", F.lit("missing")).alias("piece"))
    return rows.groupBy("state").pivot("piece", ["T", "I", "missing"]).count().fillna(0)


@query(
    "a23_bench",
    "WITH v AS (SELECT list(conf ORDER BY conf) AS v, count(*) AS n, avg(conf) AS m, max(conf) AS x, count(*) / (max(ts) - min(ts)) AS f FROM frames) SELECT n AS frames, round(m, 6) AS mean, x AS most, round(f, 6) AS fps, v[CAST(round((n - 1) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(round((n - 1) * 0.9) AS BIGINT) + 1] AS p90, v[CAST(round((n - 1) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(round((n - 1) * 0.99) AS BIGINT) + 1] AS p99 FROM v",
    FRAMES,
)
def a23_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bench_summary(V.frames(spark, sf_dir), "conf", "ts").withColumn("mean", F.round("mean", 6)).withColumn("fps", F.round("fps", 6))


@query(
    "a26_regions",
    """
    WITH p AS (SELECT vec_id, unnest(range(64)) AS i, unnest(e) * 500 + 60 AS v FROM e)
    SELECT vec_id, CAST(i // 32 * 2 + i % 8 // 4 AS BIGINT) AS region, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(avg(CASE WHEN v < 64 THEN 1 ELSE 0 END), 6) AS dark, round(avg(CASE WHEN v > 40 THEN 1 ELSE 0 END), 6) AS bright FROM p GROUP BY 1, 2
    """,
    VECTORS,
)
def a26_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = vectors(spark, sf_dir).select("vec_id", F.posexplode("e").alias("i", "x"))
    region = (F.floor(F.col("i") / 32) * 2 + F.floor(F.col("i") % 8 / 4)).cast("long")
    out = A.region_fractions(pixels.select("vec_id", region.alias("region"), (F.col("x") * 500 + 60).alias("v")), ["vec_id", "region"], "v")
    return out.select("vec_id", "region", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "dark", "bright")))


@query(
    "v21_menu_screen",
    """
    WITH s AS (SELECT vec_id, abs(e[1]) AS logo, abs(e[2]) * 4 AS chrome, abs(e[3]) * 300 AS mean, abs(e[4]) * 6 AS dark, e[5] > 0.1 AS well, vec_id % 3 = 0 AS after FROM e)
    SELECT vec_id, CASE WHEN logo > 0.18 AND chrome < 0.32 THEN 'title' WHEN mean < 28 AND chrome < 0.32 THEN 'title' WHEN well THEN NULL WHEN chrome >= 0.32 THEN CASE WHEN after THEN 'highscore_entry' ELSE 'type_select' END WHEN dark > 0.5 THEN 'level_select' END AS screen FROM s
    """,
    VECTORS,
)
def v21_menu_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.when(F.col("vec_id") % 3 == 0, "game_over")
    return vectors(spark, sf_dir).select("vec_id", S.menu_screen(F.abs(e(1)), F.abs(e(2)) * 4, F.abs(e(3)) * 300, F.abs(e(4)) * 6, e(5) > 0.1, before).alias("screen"))


@query(
    "p12_requests",
    """
    WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'station' WHEN 1 THEN 'reader' ELSE 'other' END AS target, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE 'v1.' || p_size END AS release, replace(p_brand, '#', CASE WHEN p_partkey % 7 = 0 THEN '#' ELSE '-' END) AS version, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'app' WHEN 2 THEN 'factory' ELSE 'odd' END AS mode FROM part)
    SELECT p_partkey, target, release, version, coalesce(mode = 'factory', FALSE) AS factory FROM c
    WHERE target <> 'other' AND regexp_full_match(release, '[A-Za-z0-9+_-][A-Za-z0-9.+_-]{0,39}') AND regexp_full_match(version, '[A-Za-z0-9+_-][A-Za-z0-9.+_-]{0,39}') AND coalesce(mode, '') IN ('', 'app', 'factory')
    """,
)
def p12_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    target = F.get(F.array(*map(F.lit, ("station", "reader", "other"))), (key % 3).cast("int"))
    release = F.when(key % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("v1."), F.col("p_size").cast("string")))
    version = F.when(key % 7 == 0, F.col("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("-")))
    mode = F.get(F.array(F.lit(None).cast("string"), F.lit("app"), F.lit("factory"), F.lit("odd")), (key % 4).cast("int"))
    command = F.struct(target.alias("target"), release.alias("release"), version.alias("version"), mode.alias("mode"))
    rows = V.read(spark, sf_dir, "part").select("p_partkey", command.alias("command")).withColumn("r", stores.update_request(F.col("command")))
    return rows.where("r IS NOT NULL").select("p_partkey", "r.*")
