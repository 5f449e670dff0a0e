"""Station folds, matching, readers, stores, formats and windows over streams, on made-up cases."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framefold.functions import formats as T
from framefold.operators import folds as L
from framefold.operators import joins as J
from framefold.operators import matching as M
from framefold.operators import readers as V
from framefold.operators import states as S
from framefold.sources import recordings as R
from framefold.sources import stores
from framefold.streaming import live


def numbered(rows):
    return ({"seq": k, **r} for k, r in enumerate(rows))


def test_lock_life():
    solve = lambda found, dark=False, hold=False: {"solved": True, "found": found, "dark_ok": dark, "hold": hold}
    rows = [solve(0.6), solve(0.5), solve(0.6), solve(0.7), solve(0.72, True), solve(0.9), *[solve(None)] * 2, solve(None, hold=True), *[solve(0.1)] * 10, solve(0.6)]
    out = S.lock_fold().run(numbered(rows))
    assert [r["state"] for r in out] == ["acquiring", "acquiring", "acquiring", "locked", "locked", "locked", "drift", "drift", "locked", *["drift"] * 9, "lost", "acquiring"]
    assert [r["confidence"] for r in out][3:7] == [0.7, 0.7, 0.9, 0.0]


def test_status_is_prompt_but_rare():
    times = [(0.0, "a"), (0.2, "b"), (0.6, "b"), (0.7, "c"), (1.2, "c"), (6.5, "c")]
    out = S.status_fold(5.0).run(numbered({"ts": t, "key": k} for t, k in times))
    assert [(r["seq"], r["changed"]) for r in out] == [(0, True), (2, True), (4, True), (5, False)]


def test_backoff_and_queue():
    out = S.backoff_fold(1.0, 8.0).run(numbered({"lasted": x} for x in (0, 0, 0, 0, 0, 12, 0)))
    assert [r["retry_in"] for r in out] == [1, 2, 4, 8, 8, 1, 2]
    kinds = ["put"] * 4 + ["take", "take", "put"]
    fates = lambda oldest: {r["seq"]: r["fate"] for r in S.queue_fold(2, oldest).run(numbered({"kind": k} for k in kinds))}
    assert fates(True) == {0: "dropped", 1: "dropped", 2: "delivered", 3: "delivered", 6: "waiting"}
    assert fates(False) == {2: "dropped", 3: "dropped", 0: "delivered", 1: "delivered", 6: "waiting"}


def play(*parts):
    rows = []
    for state, n in parts:
        rows += [{"state": state, "score": 10, "lines": 3, "level": 0, "piece": "T"} for _ in range(n)]
    return [r | {"ts": k / 60} for k, r in enumerate(rows)]


def test_recordings_hold_their_end_and_drop_short_games():
    rows = play(("in_game", 5), ("paused", 2), ("game_over", 9), ("title", 9), ("in_game", 3))
    rows[1]["new_game"] = rows[25]["new_game"] = True
    rows[2]["field"] = [5] * 200
    (out,) = S.recorder_fold(end_frames=4, least_frames=6).run(numbered(rows))
    assert (out["gameid"], out["start_seq"], out["frames"]) == (1, 1, 10)
    frames = R.decode(out["recording"])
    assert [f["ctime_ms"] for f in frames][:3] == [0, 17, 33] and frames[0]["field"] == [0] * 200 and frames[-1]["field"] == [3] * 200 and frames[0]["preview"] == "T"
    assert [r["frames"] for r in S.recorder_fold(partial=True, end_frames=4, least_frames=3).run(numbered(play(("title", 3), ("in_game", 5), ("title", 2), ("in_game", 2))))] == [7]


def test_session_events():
    rows = play(("in_game", 8), ("game_over", 3), ("in_game", 6), ("title", 1))
    rows[1]["cheat"], rows[6]["cheat"], rows[2]["player"], rows[4]["player"], rows[16]["gap"] = 1, 2, "ann", "bob", 40.0
    out = S.session_events_fold(4, 3).run(numbered(rows))
    assert [(r["kind"], r["start_seq"], r["seq"], r["player"], r["end_reason"], r["count"]) for r in out] == [
        ("start", 0, 3, "ann", None, None), ("cheat", 0, 1, "ann", None, 1), ("cheat", 0, 6, "ann", None, 2), ("end", 0, 10, "ann", "game_over", None),
        ("start", 11, 14, None, None, None), ("end", 11, 16, None, "signal_lost", None),
    ]


def test_rail_mends_pieces():
    counts = lambda n: [(n + k) // 7 for k in range(7)]
    rows = [{"ts": 0.0, "piece": p, "counts": c, "rail_conf": x} for p, c, x in [("T", counts(3), 0.9), ("J", None, 0.9), ("S", counts(6), 0.4), ("S", counts(6), 0.9), ("S", counts(30), 0.9), ("L", [1, None, 1, 1, 1, 1, 1], 1.0)]]
    out = L.rail_fold().run(numbered(rows))
    assert [r["pieces"] for r in out] == [3, 4, 5, 6, 6, 7] and [r["rail"] for r in out][-1] == 30 and out[4]["drought"] == 0


def test_candidates_of_one_place(spark):
    rows = [(1, 0.0, 0.0, 9.0, 0), (1, 39.0, 39.0, 8.0, 1), (1, 5.0, 5.0, 7.0, 2), (1, 41.0, 0.0, 9.0, 3), *((1, 1000.0 * k, 0.0, 1.0, 3 + k) for k in range(1, 8)), (2, 0.0, 0.0, 1.0, 0)]
    got = M.near_candidates(spark.createDataFrame(rows, "image_id long, x double, y double, score double, nth long")).collect()
    assert sorted((r["image_id"], r["place"], r["nth"]) for r in got) == [(1, 1, 0), (1, 2, 3), (1, 3, 1), (1, 4, 4), (1, 5, 5), (1, 6, 6), (2, 1, 0)]


GLYPHS = {t: np.random.default_rng(int(t, 16)).integers(0, 255, (8, 8)).astype(np.uint8) for t in "0123456789ABCDEF"}


def strip(text, at=2):
    luma = np.zeros((12, 8 * len(text) + 8), dtype=np.uint8)
    for k, c in enumerate(text):
        if c != " ":
            luma[at : at + 8, 3 + 8 * k : 11 + 8 * k] = GLYPHS[c]
    return luma


def test_digit_fields():
    assert V.read_digits(strip("0042"), (3, 2, 32, 8), 4, GLYPHS, 10)[0] == 42
    assert V.read_digits(strip("0042"), (2, 3, 32, 8), 4, GLYPHS, 10)[0] == 42  # a pixel off
    assert V.read_digits(strip("    "), (3, 2, 32, 8), 4, GLYPHS, 10) == (None, 0.0)
    assert V.read_digits(strip("  42"), (3, 2, 32, 8), 4, GLYPHS, 10)[0] == 42
    veiled = strip("0042")
    veiled[:, 9:21] = 90
    assert V.read_digits(veiled, (3, 2, 32, 8), 4, GLYPHS, 10) == (None, 0.0)
    assert V.read_number(strip("00A2"), (3, 2, 32, 8), 4, GLYPHS)[::2] == (0xA2, 16) and V.read_number(strip("0012"), (3, 2, 32, 8), 4, GLYPHS)[::2] == (12, 10)
    assert V.read_counts(strip("007123"), [(3, 2, 24, 8), (27, 2, 24, 8)], GLYPHS)[0] == [7, 123]


def test_boards_are_read():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 4, (20, 10))
    targets = np.array([[255.0, 128, 128], [120, 150, 60], [180, 60, 170]])
    luma, lab = np.full((160, 80), 5, dtype=np.uint8), np.zeros((160, 80, 3))
    lab[:] = (5, 128, 128)
    for (r, c), v in np.ndenumerate(cells):
        if v:
            luma[8 * r + 1 : 8 * r + 7, 8 * c + 1 : 8 * c + 7] = 200
            lab[8 * r + 1 : 8 * r + 7, 8 * c + 1 : 8 * c + 7] = targets[v - 1]
    got, strength, unsure = V.read_board(luma, lab, (0, 0, 80, 160), targets)
    assert np.array_equal(got, cells) and ((strength > 1) == (cells > 0)).all() and not unsure.any()
    assert V.contrast(np.ones((2, 9))) is None and V.fill_margin(np.array([])) == 40 and V.full_rows_from_top(np.array([[1, 1], [1, 0]])) == 1


def board(*cells):
    out = np.zeros((20, 10), dtype=int)
    for r, c in cells:
        out[r, c] = 1
    return out


def test_falling_pieces():
    stack = [(19, c) for c in range(9)]
    piece = [(3, 4), (4, 3), (4, 4), (4, 5)]
    assert V.falling_piece(board(*stack, *piece), board(*stack)) == ("T", sorted(piece), 0.9)
    assert V.falling_piece(board(*stack, *piece), board())[0] == "T"
    assert V.falling_piece(board(*stack), board()) == (None, [], 0.0)
    assert V.falling_piece(board(*stack, (2, 2)), board(*stack)) == (None, [(2, 2)], 0.3)
    assert V.falling_piece(board(*stack, *((5, c) for c in range(9))), board(*stack)) == (None, [], 0.0)


def test_screens_need_a_margin():
    rng = np.random.default_rng(2)
    a, b, mask = rng.random((30, 32)), rng.random((30, 32)), np.ones((30, 32), dtype=bool)
    assert V.screen_of(a, [("title", a, mask), ("pause", b, mask)])[0] == "title"
    assert V.screen_of(a, [("title", a, mask), ("pause", a, mask)])[0] is None and V.screen_of(a, [("title", a, mask), ("title", b, mask)])[0] == "title"
    assert V.screen_of(rng.random((30, 32)), [("title", a, mask)])[0] is None and V.screen_of(a, []) == (None, 0.0, 0.0)
    assert V.from_rgba(bytes([1, 2, 3, 255]), 1, 1).tolist() == [[[3, 2, 1]]]


def test_stores(spark, tmp_path):
    games = spark.createDataFrame([(str(k), None, k, 0, 0, datetime.date(2024, 1, 1 + k % 3), datetime.datetime(2024, 1, 1, 0, 0, k % 60)) for k in range(30)], stores.GAME)
    assert stores.load_games(spark, str(tmp_path / "none")).count() == 0
    stores.save_games(games, str(tmp_path / "g"), ["day", "game_id"], 5)
    kept = stores.load_games(spark, str(tmp_path / "g"))
    assert kept.count() == 5 and {r["day"] for r in kept.collect()} == {datetime.date(2024, 1, 3)}
    (tmp_path / "refs.json").write_text(json.dumps({"a.mp4": [{"kind": "title", "ranges": [[0, 1.5], [3, 4]]}]}))
    assert [tuple(r) for r in stores.reference_ranges(spark, str(tmp_path / "refs.json")).collect()] == [("a.mp4", "title", 0.0, 1.5), ("a.mp4", "title", 3.0, 4.0)]


def test_commands_arrive_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"target":"station","release":"v1","version":"1.0"}\nnoise\n{"target":"reader","release":"../x","version":"1"}\n')
    commands = stores.command_stream(spark, str(tmp_path / "in")).select(stores.update_request(F.col("command")).alias("r")).where("r IS NOT NULL")
    query = commands.writeStream.format("memory").queryName("commands").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r["r"]) for r in spark.table("commands").collect()] == [("station", "v1", "1.0", False)]


def test_formats(spark):
    sums = "A" * 64 + "  *a.bin\nshort b.bin\n" + "b" * 64 + " c d.bin\n" + "c" * 64 + " a.bin"
    got = T.checksums(spark.createDataFrame([(sums,)], "t string"), "t").collect()
    assert {r["name"]: r["sha256"] for r in got} == {"a.bin": "c" * 64, "c d.bin": "b" * 64}
    cells = spark.createDataFrame([([(3, 4), (3, 5), (3, 6), (4, 5)],)], "c array<struct<r:int,c:int>>")
    (row,) = cells.select(T.placed(F.col("c")).alias("p"), T.turned(T.turned(T.turned(T.turned(F.col("c"))))).alias("q"), T.turned(F.col("c")).alias("t")).collect()
    assert row["p"] == row["q"] and [tuple(x) for x in row["t"]] == [(0, 1), (1, 0), (1, 1), (2, 1)]
    keys = spark.createDataFrame([("a.b",), ("a.",), ("c",), ("cd",), (None,)], "k string").select(T.allowed(F.col("k"), ("a.", "c"))).collect()
    assert [r[0] for r in keys] == [True, False, True, False, False]


def test_overlapping_segments_give_the_first(spark):
    segments = spark.createDataFrame([(0, 0.0, 10.0, 1.0), (1, 5.0, 20.0, 1.0), (2, 5.0, 6.0, 0.0), (3, 30.0, 30.0, 0.0)], "segment long, start_s double, end_s double, margin_s double")
    rows = spark.createDataFrame([(t,) for t in (-1.0, 0.0, 5.5, 9.5, 10.0, 19.5, 20.0, 30.0)], "ts double")
    got = J.in_segments(rows, segments, "ts", 7.0).orderBy("ts").collect()
    assert [(r["segment"], r["scored"]) for r in got] == [(None, False), (0, False), (0, True), (0, False), (1, True), (1, False), (None, False), (None, False)]


@pytest.mark.parametrize("kind", ["windows", "sessions", "once"])
def test_windows_over_streams(spark, tmp_path, kind):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    batches = [[(1, at(0), 1.0), (1, at(1), 3.0), (1, at(3), 5.0)], [(1, at(3), 5.0), (1, at(100), 7.0)], [(1, at(2), 99.0), (1, at(300), 1.0)], [(1, at(600), 1.0)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("stream_id long, at timestamp, x double").parquet(f"{tmp_path}/in")
    made = {"windows": lambda: live.telemetry_stream(stream, "at", "x"), "sessions": lambda: live.gap_sessions(stream, "at", "10 seconds", "10 seconds"), "once": lambda: live.once(stream, "at", "10 seconds", ["stream_id", "at"])}[kind]()
    query = made.writeStream.format("memory").queryName(f"live_{kind}").option("checkpointLocation", f"{tmp_path}/cp").start()
    for rows in batches:
        spark.createDataFrame(rows, "stream_id long, at timestamp, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
    query.stop()
    rows = spark.table(f"live_{kind}").collect()
    if kind == "windows":  # the late row of the third batch is dropped; the last windows are still open
        assert sorted((r["window_start"], r["n"], r["mean"], r["most"]) for r in rows)[:3] == [(at(0), 2, 2.0, 3.0), (at(2), 2, 5.0, 5.0), (at(100), 1, 7.0, 7.0)]
    elif kind == "sessions":
        assert sorted((r["started"], r["ended"], r["n"]) for r in rows)[:2] == [(at(0), at(13), 4), (at(100), at(110), 1)]
    else:
        assert sorted(r["at"] for r in rows) == [at(s) for s in (0, 1, 3, 100, 300, 600)]
