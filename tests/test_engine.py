"""Folds, recordings, text sources and streams, on made-up cases."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from framefold.functions import rules
from framefold.operators import aggregates as A
from framefold.operators import folds as L
from framefold.operators import joins as J
from framefold.operators import windows as W
from framefold.sources import recordings as R
from framefold.sources import text as T
from framefold.streaming import live


def cheat_feed(*holds):
    """Runs of (score, lines, level, frames) at sixty frames a second."""
    seq, rows = 0, []
    for score, lines, level, frames in holds:
        for _ in range(frames):
            rows.append({"seq": seq, "ts": seq / 60, "state": "in_game", "score": score, "lines": lines, "level": level})
            seq += 1
    return rows


@pytest.mark.parametrize(
    "holds, kinds",
    [
        ([(0, 0, 18, 30), (10000, 0, 18, 200)], ["cheat"]),
        ([(5000, 20, 18, 30), (37800, 20, 18, 5), (37800, 24, 18, 200)], ["cheat"]),
        ([(5000, 20, 18, 30), (27800, 20, 18, 5), (27800, 24, 18, 200)], []),
        ([(0, 0, 18, 30), (20000, 0, 18, 200)], ["cheat"]),
        ([(0, 0, 18, 30), (150, 0, 18, 200)], []),
        ([(0, 0, 18, 30), (5000, 0, 18, 200)], ["score_anomaly"]),
        ([(0, 0, 18, 30), (10000, 0, 18, 30), (100, 0, 18, 200)], []),
        ([(0, 0, 18, 30), (10000, 0, 18, 5), (0, 0, 18, 200)], []),
        ([(0, 0, 18, 30), (10000, 0, 18, 20)], ["cheat"]),
        ([(0, 0, 5, 30), (8400, 4, 5, 200)], []),
    ],
)
def test_cheats(holds, kinds):
    assert [e["kind"] for e in L.CHEAT.run(iter(cheat_feed(*holds)))] == kinds


def test_two_cheats_count_two():
    (event,) = L.CHEAT.run(iter(cheat_feed((0, 0, 18, 30), (20000, 0, 18, 200))))
    assert event["count"] == 2 and event["points"] == 20000


def frames_of(*parts, **values):
    seq = 0
    for state, n in parts:
        for _ in range(n):
            yield {"seq": seq, "ts": seq / 60, "state": state, "conf": 0.9, "score": None, "lines": None, "level": None, "piece": None} | values
            seq += 1


def test_new_game_needs_play_in_a_row():
    out = L.GAME.run(frames_of(("level_select", 20), ("in_game", 3), ("type_select", 20), ("in_game", 40)))
    starts = [r["seq"] for r in out if r["new_game"]]
    assert len(starts) == 1 and starts[0] >= 43


def test_menus_alone_start_nothing():
    assert not any(r["new_game"] for r in L.GAME.run(frames_of(("title", 5), ("in_game", 40))))


def test_lower_score_must_insist():
    rows = [{"seq": k, "ts": k / 60, "state": "in_game", "conf": 0.9, "score": s, "lines": 9, "level": 0, "piece": None} for k, s in enumerate([500] * 5 + [20] * 5 + [500] + [20] * 6)]
    shown = [r["score"] for r in L.GAME.run(iter(rows))]
    assert shown[:16] == [500] * 16 and L.Tracked(value=500).read(20, 0.9) is None
    tracked = L.Tracked()
    assert [tracked.read(r["score"], 0.9) for r in rows] == [500] * 11 + [500] * 5 + [20]


def test_held_number_fades_away():
    rows = [{"seq": k, "ts": k / 60, "state": "in_game", "conf": 0.9, "score": 500 if k == 0 else None, "lines": None, "level": None, "piece": None} for k in range(20)]
    tracked = L.Tracked()
    shown = [tracked.read(r["score"], r["conf"]) for r in rows]
    assert L.Tracked().read(None, 0.0) is None and shown[7] == 500 and shown[8] is None


def test_plausibility_rejects_then_corrects():
    fold = L.guard_fold("score", 60000, "score_jump")
    out = fold.run({"seq": k, "score": s} for k, s in enumerate([100, 100000, 200, *[100000] * 6, 100001]))
    assert [r["value"] for r in out] == [100, 100, 200, 200, 200, 200, 200, 200, 100000, 100001]
    assert [r["severity"] for r in out].count("reject") == 6 and out[8]["severity"] == "correct"


def test_null_neither_advances_nor_resets_a_challenge():
    fold = L.guard_fold("score", 10, "score_jump")
    out = fold.run({"seq": k, "score": s} for k, s in enumerate([0, 99, 99, 99, None, 99, 99, 99]))
    assert out[-1]["value"] == 99 and out[-2]["value"] == 0 and out[4]["value"] is None


def test_clears_and_droughts():
    rows = []
    for k in range(60):
        lines = 0 if k < 30 else 4
        rows.append({"seq": k, "ts": k / 60, "state": "in_game", "conf": 1.0, "score": 0 if lines == 0 else 1200, "lines": lines, "level": 0, "piece": "TJ"[k // 10 % 2]})
    last = L.GAME.run(iter(rows))[-1]
    assert (last["tetrises"], last["tetris_rate"], last["pieces"], last["drought"]) == (1, 1.0, 5, 5)


def test_lower_lines_leave_the_baseline():
    """Lines 10, 9, 10 count no clear; a jump is told as a warning; an uncertain step too."""

    def events_of(lines):
        state, events = L.fresh_stats(), []
        for k, n in enumerate(lines):
            L.observe(state, {"ts": k / 60}, {"lines": n, "score": None, "level": 0}, None, events, 0.5)
        return state["clears"], [(e["reason"], e["severity"]) for e in events]

    assert events_of([10, 9, 10]) == ([0, 0, 0, 0], [])
    assert events_of([10, 19, 11]) == ([1, 0, 0, 0], [("lines_jump_ignored", "warn"), ("single", "info")])
    assert events_of([10, None, 12]) == ([0, 1, 0, 0], [("lines_attribution_uncertain", "warn"), ("double", "info")])
    assert rules.attribute_clears(2, 350, 0) is None and rules.attribute_clears(2, 230, 0) == (2,) and rules.attribute_clears(2, 85, 0) == (1, 1)


def test_cheat_totals():
    (row,) = L.CHEAT_TOTALS.run(iter(cheat_feed((0, 0, 18, 30), (10000, 0, 18, 200))))
    assert (row["cheats"], row["cheat_points"], row["anomalies"], row["level_offset_steps"]) == (1, 10000, 0, 0)
    (row,) = L.CHEAT_TOTALS.run(iter(cheat_feed((0, 0, 5, 30), (8400, 4, 5, 200))))
    assert (row["clear_points"], row["level_offset_steps"]) == (8400, 1)


def test_session_ends():
    fold = L.session_fold(5, 3, 2.0)
    game = [("in_game", 6), ("paused", 50), ("in_game", 2), ("game_over", 3), ("title", 9)]
    (row,) = fold.run(frames_of(*game, score=7))
    assert (row["end_reason"], row["play_frames"], row["score"]) == ("game_over", 8, 7)
    assert fold.run(frames_of(("in_game", 4), ("title", 9), score=7)) == []
    assert fold.run(frames_of(("in_game", 9), ("title", 9))) == []
    assert [r["end_reason"] for r in fold.run(frames_of(("in_game", 9), ("unknown", 130), score=7))] == ["signal_lost"]
    assert [r["end_reason"] for r in fold.run(frames_of(("in_game", 9), score=7))] == ["shutdown"]
    assert [r["end_reason"] for r in fold.run(frames_of(("in_game", 9), ("title", 3), score=7))] == ["reset"]


def test_timeline_thins_at_its_cap():
    out = L.timeline_fold("h", 1.0, 4).run({"seq": k, "ts": float(k), "h": k} for k in range(9))
    assert [r["ts"] for r in out] == [0.0, 4.0, 8.0]


def test_publish_waits_and_skips_equals():
    out = L.publish_fold(1.0, ("k",)).run({"seq": n, "ts": t, "k": k} for n, (t, k) in enumerate([(0, 1), (0.5, 2), (1.0, 2), (2.0, 2), (3.0, 3)]))
    assert [(r["seq"], r["out_seq"]) for r in out] == [(0, 0), (2, 1), (4, 2)]


def test_latch_curtain_and_animation():
    latched = L.latch_fold(3).run({"seq": k, "base": b} for k, b in enumerate(["dec"] * 3 + [None, "hex"]))
    assert [r["latched"] for r in latched] == [None, None, "dec", "dec", "dec"]
    reads = [(7, None), (7, None), (7, None), (None, None), (None, 0xA0), (5, 6)]
    out = L.latched_read_fold(3).run({"seq": k, "dec": d, "hex": h, "dec_conf": 0.9, "hex_conf": 0.9} for k, (d, h) in enumerate(reads))
    assert [(r["value"], r["latched"]) for r in out] == [(7, None), (7, None), (7, "dec"), (None, "dec"), (0xA0, "hex"), (6, "hex")]
    falling = L.curtain_fold().run({"seq": k, "full_rows": n} for k, n in enumerate([0, 2, 4, 1, 2]))
    assert [r["falling"] for r in falling] == [False, False, True, False, False]
    still = lambda lumas, boards, held=(): L.animation_fold(2).run({"seq": k, "luma": x, "board": b, "suppress": k in held} for k, (x, b) in enumerate(zip(lumas, boards, strict=True)))
    flashed = still([40, 40, 90, 40, 40, 40], [[0, 1]] * 6)
    assert [r["animating"] for r in flashed] == [False, False, True, True, False, False]
    cleared = still([40] * 6, [[1, 3], [1, 2], [1, 0], [0, 1], [0, 1], [0, 1]])
    assert [r["animating"] for r in cleared] == [False, True, True, True, True, False] and cleared[-1]["expected"] == [0, 1]
    assert not any(r["animating"] for r in still([40] * 3, [[1, 3], [1, 2], [1, 0]], held=(1,)))
    assert L.settle_against([0, 1], [0, 1]) and not L.settle_against([0, 0], [3, 3])
    assert L.after_clear([[0, 1], [1, 1], [1, 0]]) == [[0, 0], [0, 1], [1, 0]] and L.mismatches([[0, 1]], [[1, 2]]) == 1


def noisy_frames(spark, streams=3, n=120):
    rng = random.Random(1)
    rows = []
    for s in range(streams):
        score = 0
        for k in range(n):
            score += rng.choice([0, 0, 40])
            rows.append((s, k, k / 60, rng.choice(["in_game"] * 8 + ["paused", "unknown", "title"]), rng.random(), rng.choice([score, score, None, 3]), k // 9, k // 90, rng.choice([*rules.PIECES, None])))
    rng.shuffle(rows)
    return rows, "stream_id long, seq long, ts double, state string, conf double, score long, lines long, level long, piece string"


@pytest.mark.parametrize("fold", [L.GAME, L.SESSION, L.publish_fold(0.1, ("state",))], ids=["game", "session", "publish"])
def test_batch_is_the_plain_loop(spark, fold):
    rows, schema = noisy_frames(spark)
    got = L.run_batch(spark.createDataFrame(rows, schema), fold).toPandas()
    names = [c.split()[0] for c in schema.split(", ")]
    for s in range(3):
        plain = fold.run(dict(zip(names, r, strict=True)) for r in sorted(rows) if r[0] == s)
        own = got[got.stream_id == s].sort_values(got.columns[1])
        assert [L.plain(r) for r in own.drop(columns="stream_id").to_dict("records")] == plain


def test_stream_is_the_batch(spark, tmp_path):
    rows, schema = noisy_frames(spark)
    for n, (low, high) in enumerate([(0, 40), (40, 80), (30, 120)]):  # the last batch repeats rows
        spark.createDataFrame([r for r in rows if low <= r[1] < high], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = live.run_stream(stream, L.GAME).writeStream.format("memory").queryName("live_game").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    batch = L.run_batch(spark.createDataFrame(rows, schema), L.GAME)
    live_rows = spark.table("live_game")
    assert live_rows.count() == batch.count() and live_rows.exceptAll(batch).count() == 0


def test_fan_out_leaves_other_sinks_alone(spark, tmp_path):
    spark.range(6).withColumn("game_id", F.col("id") % 3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, game_id long").parquet(f"{tmp_path}/in")
    told = []

    def broken(batch, number):
        raise OSError("gone")

    query = live.fan_out(stream, {"broken": broken, "games": live.upsert_games(f"{tmp_path}/out")}, f"{tmp_path}/cp", lambda name, e: told.append(name))
    query.processAllAvailable()
    query.stop()
    assert told == ["broken"] and spark.read.parquet(f"{tmp_path}/out").count() == 3


def record(**values):
    return {"game_type": 1, "player_num": 2, "gameid": 42, "ctime_ms": 123456, "lines": 65, "level": 10, "score": 114535, "instant_das": None, "preview": "S", "cur_piece_das": 3, "cur_piece": "I", "counts": [24, 30, 18, 26, 22, 21, 24], "field": [2] + [0] * 189 + [c % 3 + 1 for c in range(10)]} | values


def test_records_round_trip():
    rows = [record(), record(score=None, lines=None, level=None, preview=None, counts=[None] * 7)]
    assert [{k: r[k] for k in rows[0]} for r in R.decode(R.encode(rows))] == rows
    assert R.decode(gzip.compress(R.encode(rows))) == R.decode(R.encode(rows))
    (big,) = R.decode(R.encode([record(score=1 << 30, lines=99999, ctime_ms=1 << 40, counts=[5000] * 7)]))
    assert (big["score"], big["lines"], big["ctime_ms"], big["counts"]) == (0xFFFFFE, 0xFFE, (1 << 28) - 1, [0x3FE] * 7)


def test_older_records():
    assert R.SIZES == {1: 71, 2: 72, 3: 73}
    two = bytearray(72)
    two[0], two[7], two[8], two[11] = 2 << 5 | 1 << 3, 12, 9, 200
    one = bytearray(71)
    one[0], one[10], one[11] = 1 << 5, 0x80 | 1, 2 << 6 | 7
    (a, b) = R.decode(bytes(two + one))
    assert (a["version"], a["game_type"], a["lines"], a["level"], a["score"]) == (2, 1, 12, 9, 200)
    assert (b["version"], b["score"], b["lines"], b["level"]) == (1, 1, 6, 7)


@pytest.mark.parametrize("data", [b"\x00" * 73, b"\xe0" * 80, b"\x60" * 70])
def test_bad_records_fail(data):
    with pytest.raises(R.BadRecording):
        R.decode(data)


def test_recordings_on_files(spark, tmp_path):
    rows = [("a", record(ctime_ms=k * 17)) for k in range(70)] + [("b", record())]
    frames = spark.createDataFrame([(k, *(r[c] for c in R.COLUMNS[1:])) for k, r in rows], "game_key string, " + R.RECORD.split(", ", 1)[1])
    R.write_recordings(R.encoded_games(frames), str(tmp_path / "games"))
    assert [p.name for p in (tmp_path / "games").iterdir()] == ["a.ngf.gz"]
    back = R.read_recordings(spark, str(tmp_path / "games"))
    assert back.count() == 70 and back.agg(F.max("ctime_ms")).first()[0] == 69 * 17
    (seek,) = R.replay_seek(back, back.select("path", F.lit(40).cast("long").alias("at_ms")).distinct()).collect()
    assert seek["idx"] == 2


def test_json_lines_keep_nulls_and_order(spark, tmp_path):
    frame = spark.createDataFrame([(1, None, "x")], "b long, a long, c string")
    T.write_json_lines(frame, f"{tmp_path}/o")
    (line,) = [r.value for r in spark.read.text(f"{tmp_path}/o").collect()]
    assert line == '{"b":1,"a":null,"c":"x"}'
    assert T.read_json_lines(spark, f"{tmp_path}/o", "b long, a long, c string").collect() == frame.collect()


def test_labels(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("# head\n0 10.5 title\n10.5\t20 in_game|paused 0.5 # note\n\n20 30 *\n")
    got = T.read_labels(spark, str(tmp_path / "l.tsv")).orderBy("segment").collect()
    assert [(r.start_s, r.end_s, list(r.states), r.margin_s) for r in got] == [(0, 10.5, ["title"], 0.3), (10.5, 20, ["in_game", "paused"], 0.5), (20, 30, ["*"], 0.3)]


def test_reader_messages(spark):
    lines = ['{"type":"present","uid":" ab12 ","name":" "}', "noise", '{"type":"other"}', '{"type":"hello","protocol":2}']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(T.reader_message(F.col("line"))).collect()]
    assert got[0]["uid"] == "AB12" and got[0]["name"] is None and got[1] is None and got[2] is None and got[3]["protocol"] == 2


def test_layers():
    base = {"a": {"b": 1, "c": [1]}, "d": "x"}
    assert T.layered(base, {"a": {"b": 2}}, {"a.c": [3]}) == {"a": {"b": 2, "c": [3]}, "d": "x"}
    with pytest.raises(T.UnknownSetting):
        T.layered(base, {"a.x": 1})
    assert T.environment_layer({"GAME_A__B": "7", "GAME_D": "y", "OTHER": "1"}, "GAME") == {"a.b": 7, "d": "y"}


def test_rules():
    assert rules.compositions(3) == ((3,), (2, 1), (1, 1, 1)) and rules.clear_base_sums(2) == (80, 100)
    assert rules.clear_point_candidates(0, (3,)) == (0,) and rules.clear_point_candidates(17, (3,)) == ()
    assert rules.attribute_clears(4, 1200, 0) == (4,) and rules.attribute_clears(4, None, 0) is None and rules.greedy_clears(6) == (4, 2)
    assert [rules.expected_level_of(18, n) for n in (0, 129, 130, 140)] == [18, 18, 19, 20]
    assert rules.infer_start_level_of(19, 131) == 19 and rules.infer_start_level_of(20, 151) == 14


def test_segments_by_bucket_are_those_by_broadcast(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id"), (F.col("id") * 0.7).alias("ts"))
    segments = spark.createDataFrame([(k, k * 10.0, k * 10.0 + 8, 1.0) for k in range(12)], "segment long, start_s double, end_s double, margin_s double")
    small = J.in_segments(rows, segments, "ts", 15.0).select("id", "segment", "scored").collect()
    monkeypatch.setattr(J, "BROADCAST_ROWS", 3)
    assert sorted(J.in_segments(rows, segments, "ts", 15.0).select("id", "segment", "scored").collect()) == sorted(small)


def test_board_shapes(spark):
    def board(*heights):
        return [1 if 8 - r <= heights[c] else 0 for r in range(8) for c in range(8)]

    rows = [(1, board(5, 5, 5, 5, 5, 5, 5, 1)), (2, board(0, 4, 0, 4, 4, 4, 4, 4)), (3, board(*[0] * 8)), (4, board(1, 2, 3, 4, 5, 6, 7, 8))]
    got = {r["id"]: r for r in A.board_metrics(spark.createDataFrame(rows, "id int, board array<int>"), "board", 8, 8).collect()}
    assert got[1]["tetris_ready"] and got[1]["max_height"] == 5 and got[1]["holes"] == 0
    assert got[2]["double_well"] and not got[2]["tetris_ready"]
    assert got[3]["clean_slope"] and got[4]["clean_slope"] and not got[2]["clean_slope"]


def test_presence_and_streaks(spark):
    cards = spark.createDataFrame([(1, 0, "present", "A"), (1, 1, "status", None), (1, 2, "removed", None)], "stream_id long, seq long, kind string, uid string")
    assert [(r["present_uid"], r["last_seen"]) for r in W.presence(cards).orderBy("seq").collect()] == [("A", "A"), ("A", "A"), (None, "A")]


def test_event_rows(spark):
    frames = spark.createDataFrame([(1, 5, 65.25, json.dumps([{"field": "clear", "reason": "tetris", "severity": "info", "old": 0, "new": 4}]))], "stream_id long, seq long, ts double, events string")
    (row,) = T.event_rows(frames).collect()
    assert row["line"] == "1:05.3 clear tetris -> 4" and row["gold"]
