"""Order-dependent operators as folds: one pure step per operator, run over batches and over streams alike.

A fold has `start()`, which makes a state of plain values, and `step(state, row)`, which changes it and gives output rows.
`end(state)` gives what is left when a stream ends. `run_batch` runs a fold over whole streams with one shuffle on the
stream; `framefold.streaming.live` runs the same step over micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from framefold.functions import rules

Row = dict[str, Any]


@dataclass
class Fold:
    """A named fold: columns of its output, and its step."""

    schema: str
    start: Callable[[], Any]
    step: Callable[[Any, Row], list[Row]]
    end: Callable[[Any], list[Row]] = field(default=lambda state: [])

    def run(self, rows: Iterator[Row]) -> list[Row]:
        """All output rows of one stream's rows in order."""
        state, out = self.start(), []
        for row in rows:
            out += self.step(state, row)
        return out + self.end(state)


def plain(row: Row) -> Row:
    """Missing values of pandas as None."""
    return {k: None if v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else v for k, v in row.items()}


def as_rows(frame: pd.DataFrame, order: str) -> Iterator[Row]:
    for row in frame.sort_values(order, kind="stable").to_dict("records"):
        yield plain(row)


def as_frame(rows: list[Row], schema: str) -> pd.DataFrame:
    """Output rows as the schema's columns, with nullable whole numbers."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {c.split()[0]: c.split()[1] for c in schema.split(", ")}
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    for name, kind in kinds.items():
        if kind in ("long", "int"):
            frame[name] = frame[name].astype("Int64")
        elif kind == "double":
            frame[name] = frame[name].astype("Float64")
        elif kind == "boolean":
            frame[name] = frame[name].astype("boolean")
    return frame


#: Arrow types of output columns.
KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def run_batch(frames: DataFrame, fold: Fold, key: str = "stream_id", order: str = "seq") -> DataFrame:
    """The fold over each stream. A stream's rows are taken in order on one task, as the fold needs; streams run in parallel.

    Columns go through Arrow as plain lists, so no row is boxed by pandas.
    """
    columns = [c.split() for c in fold.schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        names, values = table.column_names, [c.to_pylist() for c in table.columns]
        at = values[names.index(order)]
        places = sorted(range(len(at)), key=at.__getitem__)
        ordered = zip(*([v[k] for k in places] for v in values), strict=True)
        out = fold.run(dict(zip(names, row, strict=True)) for row in ordered)
        arrays = [pa.array([r[name] for r in out], KINDS[kind]) for name, kind in columns]
        return pa.Table.from_arrays([pa.array([table.column(key)[0].as_py()] * len(out), pa.int64()), *arrays], [key, *(name for name, _ in columns)])

    return frames.groupBy(key).applyInArrow(run, f"{key} long, {fold.schema}")


# The fusion's window, fading and report floor; frames for overrides, holds, restarts and new games.
WINDOW, FADE, FLOOR = 5, 0.9, 0.4
OVERRIDE, PIECE_HOLD, RESTART_LINES = 6, 120, 4
MENU_FRAMES, CONFIRM_FRAMES = 10, 5
# Limits of the plausibility rules.
SCORE_JUMP, LINES_STEP, LINES_SKIP, LEVEL_TOLERANCE, CONFIRM = 60000, 4, 8, 1, 6


def vote(ballots: list[tuple[Any, float]]) -> tuple[Any, float] | None:
    """The value of the greatest weight, first come first among equals, and its ballots' mean weight."""
    sums: dict[Any, list[float]] = {}
    for value, weight in ballots:
        sums.setdefault(value, []).append(weight)
    if not sums:
        return None
    winner = max(sums, key=lambda v: sum(sums[v]))
    return winner, sum(sums[winner]) / len(sums[winner])


@dataclass
class Challenge:
    """A value that must come some times in a row to replace the one held."""

    value: Any = None
    count: int = 0

    def met(self, value: Any, need: int) -> bool:
        self.count = self.count + 1 if value == self.value else 1
        self.value = value
        return self.count >= need

    def would_meet(self, value: Any, need: int) -> bool:
        return value == self.value and self.count + 1 >= need

    def clear(self) -> None:
        self.value, self.count = None, 0


@dataclass
class Tracked:
    """A number that only rises, unless a lower one insists."""

    ballots: list[tuple[int, float]] = field(default_factory=list)
    value: int | None = None
    confidence: float = 0.0
    challenge: Challenge = field(default_factory=Challenge)

    def shown(self) -> int | None:
        return self.value if self.confidence >= FLOOR else None

    def about_to_yield(self, value: int | None) -> bool:
        """Whether a lower value would be taken now."""
        return value is not None and self.value is not None and value < self.value and self.challenge.would_meet(value, OVERRIDE)

    def read(self, value: int | None, confidence: float) -> int | None:
        """Take a reading; unread values fade what is held and leave a challenge as it is."""
        heard = value is not None and confidence > 0
        if heard and self.value is not None and value < self.value:
            heard = self.challenge.met(value, OVERRIDE)
            if heard:
                self.ballots = []
        if heard:
            self.challenge.clear()
            self.ballots = [*self.ballots, (value, confidence)][-WINDOW:]
            self.value, self.confidence = vote(self.ballots)
        else:
            self.confidence *= FADE
        return self.shown()


@dataclass
class Guard:
    """A plausible value, and the challenge to it."""

    value: int | None = None
    challenge: Challenge = field(default_factory=Challenge)

    def judge(self, value: int, fault: str | None, name: str, events: list[Row]) -> int | None:
        """The value to go on with: a faulty one only after CONFIRM frames; each fault leaves an event."""
        if fault is None:
            self.value = value
            self.challenge.clear()
            return value
        old, won = self.value, self.challenge.met(value, CONFIRM)
        events.append({"field": name, "reason": fault, "severity": "correct" if won else "reject", "old": old, "new": value})
        if won:
            self.value = value
            self.challenge.clear()
        return self.value


@dataclass
class GameState:
    """All that a stream's frames leave behind: fusion, plausibility and statistics."""

    states: list[tuple[str, float] | None] = field(default_factory=list)
    fused: str = "unknown"
    numbers: dict[str, Tracked] = field(default_factory=lambda: {n: Tracked() for n in ("score", "lines", "level")})
    pieces: list[tuple[str, float]] = field(default_factory=list)
    piece: str | None = None
    missed: int = 0
    menus: int = 0
    armed: bool = False
    played_armed: int = 0
    guards: dict[str, Guard] = field(default_factory=lambda: {n: Guard() for n in ("score", "lines", "level")})
    start_level: int | None = None
    lines_fresh: bool = False
    stats: dict[str, Any] = field(default_factory=dict)

    def forget_game(self) -> None:
        """A new game clears all but the last states and what was fused from them."""
        fresh = GameState(states=self.states, fused=self.fused)
        self.__dict__.update(fresh.__dict__)


#: Fixed value: the least confidence of piece counts that are taken over.
SURE_RAIL = 0.5


def fresh_stats() -> dict[str, Any]:
    return {"last_ts": None, "active": 0.0, "pieces": 0, "next": None, "drought": 0, "max_drought": 0, "lines": None, "fresh": False, "score_at": None, "level": None, "rail": None, "rail_i": None, "clears": [0, 0, 0, 0]}


def new_game(state: GameState, row: Row) -> bool:
    """Menus arm a start, and play in a row after them fires it; a zero score that insists restarts at once."""
    menu, playing = rules_menu(state.fused), state.fused == "in_game"
    # counters: menus in a row (unread screens leave them), and frames of play since a start was armed (a menu sets them back)
    state.menus = state.menus + 1 if menu else 0 if state.fused in rules.PLAY_STATES else state.menus
    state.armed = state.armed or (menu and state.menus >= MENU_FRAMES)
    state.played_armed = 0 if menu else state.played_armed + (playing and state.armed)
    if state.armed or not playing:
        return playing and state.played_armed > CONFIRM_FRAMES
    restart = row["score"] == 0 and (row["lines"] or 0) <= RESTART_LINES and row["conf"] > 0
    return restart and all(state.numbers[n].about_to_yield(row[n]) for n in ("score", "lines"))


def rules_menu(state: str) -> bool:
    return state in rules.MENU_STATES


def plausible(state: GameState, values: dict[str, int | None], events: list[Row]) -> dict[str, int | None]:
    """Values that follow the rules of the game; others wait until they insist."""
    if state.fused == "paused":
        return {n: g.value for n, g in state.guards.items()}
    out: dict[str, int | None] = {}
    for name in ("lines", "score", "level"):
        guard, value = state.guards[name], values[name]
        was_fresh = state.lines_fresh
        if name == "lines":
            state.lines_fresh = value is not None
        if value is None or guard.value is None:
            guard.value = value if value is not None else guard.value
            out[name] = value
            continue
        step, fault = value - guard.value, None
        if step < 0:
            fault = "monotonic"
        elif name == "lines" and step > (LINES_STEP if was_fresh else LINES_SKIP):
            fault = "lines_step"
        elif name == "score" and step > SCORE_JUMP:
            fault = "score_jump"
        elif name == "level" and state.start_level is not None and out["lines"] is not None and abs(value - rules.expected_level_of(state.start_level, out["lines"])) > LEVEL_TOLERANCE:
            fault = "level_lines_mismatch"
        out[name] = guard.judge(value, fault, name, events)
        if name == "level" and fault and out[name] == value and out["lines"] is not None:
            state.start_level = rules.infer_start_level_of(value, out["lines"])
    if state.start_level is None and out["level"] is not None and out["lines"] is not None:
        state.start_level = rules.infer_start_level_of(out["level"], out["lines"])
    return out


def observe(stats: dict[str, Any], row: Row, values: dict[str, int | None], piece: str | None, events: list[Row], cap: float) -> None:
    """Statistics of a frame of play: clock, spawns and droughts, and clears from line steps."""
    if stats["last_ts"] is not None and row["ts"] > stats["last_ts"]:
        stats["active"] += min(row["ts"] - stats["last_ts"], cap)
    stats["last_ts"] = row["ts"]
    if piece is not None:
        if stats["next"] is not None and piece != stats["next"]:
            stats["pieces"] += 1
            stats["drought"] = 0 if stats["next"] == "I" else stats["drought"] + 1
            stats["max_drought"] = max(stats["max_drought"], stats["drought"])
        stats["next"] = piece
    stats["level"] = stats["level"] if values["level"] is None else values["level"]
    lines, score, held, fresh = values["lines"], values["score"], stats["lines"], stats["fresh"]
    stats["fresh"] = lines is not None
    if lines is None or (held is not None and lines < held):
        return  # a lower count doesn't move what steps are measured from
    step = 0 if held is None else lines - held
    if step > rules.MOST_LINES:
        events.append({"field": "lines", "reason": "lines_jump_ignored", "severity": "warn", "old": held, "new": lines})
        return
    if step:
        gained = None if score is None or stats["score_at"] is None else score - stats["score_at"]
        sizes = rules.attribute_clears(step, gained, stats["level"])
        if sizes is None and (step > 4 or (step > 1 and not fresh)):
            events.append({"field": "lines", "reason": "lines_attribution_uncertain", "severity": "warn", "old": held, "new": lines})
        for size in sizes or rules.greedy_clears(step):
            stats["clears"][size - 1] += 1
            events.append({"field": "clear", "reason": rules.CLEAR_NAMES[size - 1], "severity": "info", "old": held, "new": lines})
    stats["lines"] = lines
    if score is not None and (score or step or held is None):
        stats["score_at"] = score


def rail_step(stats: dict[str, Any], counts: list[int | None] | None, confidence: float) -> None:
    """Piece counts that were read whole and surely: they mend the number of pieces by small steps, and a new I ends a drought.

    counts follow the order of `rules.PIECES`.
    """
    if counts is None or confidence < SURE_RAIL or len(counts) != 7 or any(c is None for c in counts):
        return
    total, held, i = sum(counts), stats["rail"], counts[rules.PIECES.index("I")]
    step = total if held is None else total - held
    if 0 < step <= rules.MOST_RAIL:
        stats["pieces"] = max(stats["pieces"], total)
    if stats["rail_i"] is not None and i > stats["rail_i"]:
        stats["drought"] = 0
    stats["rail"], stats["rail_i"] = total, i


def rail_fold() -> Fold:
    """Spawns and droughts by the next piece, mended by whole reads of the piece counts (rows: seq, ts, piece, counts, rail_conf)."""

    def step(stats: dict[str, Any], row: Row) -> list[Row]:
        observe(stats, row, dict.fromkeys(("score", "lines", "level")), row["piece"], [], 0.5)
        rail_step(stats, row["counts"], row["rail_conf"] or 0.0)
        return [{"seq": row["seq"], "pieces": stats["pieces"], "drought": stats["drought"], "max_drought": stats["max_drought"], "rail": stats["rail"]}]

    return Fold("seq long, pieces long, drought long, max_drought long, rail long", fresh_stats, step)


def game_step(state: GameState, row: Row, cap: float = 0.5) -> list[Row]:
    """Fusion, plausibility and statistics of one frame, in this order; a new game clears before the frame counts."""
    seen = row["state"]
    state.states = [*state.states, None if seen is None or seen == "unknown" else (seen, row["conf"] or 0.0)][-WINDOW:]
    voted = vote([b for b in state.states if b])
    state.fused = voted[0] if voted else state.fused
    row = row | {"conf": row["conf"] or 0.0}
    begins = new_game(state, row)
    if begins:
        state.forget_game()
    if not state.stats:
        state.stats = fresh_stats()
    events: list[Row] = [{"field": "game", "reason": "new_game", "severity": "info", "old": None, "new": None}] if begins else []
    if state.fused == "paused":
        for tracked in state.numbers.values():
            tracked.challenge.clear()
        values = {n: t.shown() for n, t in state.numbers.items()}
    else:
        values = {n: t.read(row[n], row["conf"]) for n, t in state.numbers.items()}
        if row["piece"] is not None and row["conf"] > 0:
            state.pieces = [*state.pieces, (row["piece"], row["conf"])][-WINDOW:]
            state.piece, state.missed = vote(state.pieces)[0], 0
        else:
            state.missed += 1
            state.piece = state.piece if state.missed <= PIECE_HOLD else None
    judged: list[Row] = []
    values = plausible(state, values, judged)
    cleared: list[Row] = []
    if state.fused == "in_game":
        observe(state.stats, row, values, state.piece, cleared, cap)
    s = state.stats
    single, double, triple, tetris = s["clears"]
    total = single + 2 * double + 3 * triple + 4 * tetris
    return [
        {
            "seq": row["seq"], "ts": row["ts"], "game_state": state.fused, "new_game": begins, **values, "next_piece": state.piece,
            "pieces": s["pieces"], "drought": s["drought"], "max_drought": s["max_drought"], "active_seconds": s["active"],
            "singles": single, "doubles": double, "triples": triple, "tetrises": tetris, "tetris_rate": 4 * tetris / total if total else None,
            "events": json.dumps(judged + cleared + events) if judged or cleared or events else "[]",
        }
    ]


GAME_SCHEMA = "seq long, ts double, game_state string, new_game boolean, score long, lines long, level long, next_piece string, pieces long, drought long, max_drought long, active_seconds double, singles long, doubles long, triples long, tetrises long, tetris_rate double, events string"
GAME = Fold(GAME_SCHEMA, GameState, game_step)


# The detector's frames, points and slacks.
SETTLE, PAIR_FRAMES, HOLD_FRAMES = 10, 30, 90
CHEAT_POINTS, CHEAT_SLACK, DROP_SLACK, ANOMALY, MOST_CHEATS = 10000, 250, 200, 2000, 2


@dataclass
class Settled:
    value: int | None = None
    challenge: Challenge = field(default_factory=Challenge)

    def feed(self, value: int | None) -> bool:
        """Whether the value has just settled."""
        if value is None:
            return False
        if value == self.value:
            self.challenge.clear()
            return False
        if self.challenge.met(value, SETTLE):
            self.value = value
            self.challenge.clear()
            return True
        return False


@dataclass
class CheatState:
    now: dict[str, Settled] = field(default_factory=lambda: {n: Settled() for n in ("score", "lines", "level")})
    base: dict[str, int | None] = field(default_factory=lambda: dict.fromkeys(("score", "lines", "level")))
    waiting: int | None = None
    suspect: Row | None = None
    at: Row = field(default_factory=dict)
    cheats: int = 0
    clear_points: int = 0
    unexplained: int = 0
    anomalies: int = 0
    off_level: int = 0


def confirm(state: CheatState) -> list[Row]:
    found, state.suspect = state.suspect, None
    if found is None:
        return []
    state.cheats += found["count"]
    return [{"seq": found["seq"], "ts": found["ts"], "kind": "cheat", "count": found["count"], "points": found["count"] * CHEAT_POINTS, "score_before": found["before"], "score_after": found["after"], "lines_delta": found["lines"]}]


def fit(totals: tuple[int, ...], gain: int, low: int, high: int) -> int | None:
    """The clear total with the least residual in the band; the lowest among equals."""
    fits = [(abs(gain - p), p) for p in totals if low <= gain - p <= high]
    return min(fits)[1] if fits else None


def evaluate(state: CheatState) -> list[Row]:
    """Judge the score gain since the last time against what lines and levels allow."""
    state.waiting = None
    before, after = state.base["score"], state.now["score"].value
    if before is None or after is None:
        return []
    lines = max(state.now["lines"].value - state.base["lines"], 0) if None not in (state.base["lines"], state.now["lines"].value) else 0
    levels = tuple(dict.fromkeys(x for x in (state.base["level"], state.now["level"].value) if x is not None))
    state.base = {n: after if n == "score" else state.now[n].value if state.now[n].value is not None else state.base[n] for n in state.base}
    gain = after - before
    if gain <= 0 or (lines and not levels):
        return []
    near = rules.clear_point_candidates(lines, levels)
    wide = rules.clear_point_candidates(lines, tuple(x for level in levels for x in (level - 1, level, level + 1) if x >= 0))
    # what may explain a gain, the likeliest first: cheats, clear totals, and the band that the rest must lie in
    ways = [(0, near, 0, DROP_SLACK), (0, wide, 0, DROP_SLACK), *((n, wide, -CHEAT_SLACK, DROP_SLACK + CHEAT_SLACK) for n in range(1, MOST_CHEATS + 1))]
    fits = ((count, totals, fit(totals, gain - count * CHEAT_POINTS, low, high)) for count, totals, low, high in ways)
    count, totals, points = next((x for x in fits if x[2] is not None), (None, near, max((p for p in near if p <= gain), default=0)))
    state.clear_points += points
    if count == 0:
        state.off_level += totals is wide and points not in near
        return []
    if count:
        out = confirm(state)
        state.suspect = {"seq": state.at["seq"], "ts": state.at["ts"], "count": count, "before": before, "after": after, "lines": lines, "age": 0}
        return out
    amount = gain - points - min(DROP_SLACK, gain - points)
    state.unexplained += amount
    if amount <= ANOMALY:
        return []
    state.anomalies += 1
    return [{"seq": state.at["seq"], "ts": state.at["ts"], "kind": "score_anomaly", "count": None, "points": amount, "score_before": before, "score_after": after, "lines_delta": lines}]


def cheat_step(state: CheatState, row: Row) -> list[Row]:
    """Score gains wait for their lines; suspects are confirmed after a hold, unless the score falls back."""
    if row["state"] != "in_game":
        return []
    state.at = {"seq": row["seq"], "ts": row["ts"]}
    if state.now["level"].feed(row["level"]) and state.base["level"] is None:
        state.base["level"] = state.now["level"].value
    lines_moved, score_moved = state.now["lines"].feed(row["lines"]), state.now["score"].feed(row["score"])
    out: list[Row] = []
    score, lines = state.now["score"].value, state.now["lines"].value
    if score_moved:
        if state.suspect and score < state.suspect["after"]:
            state.suspect = None
        if state.base["score"] is None:
            state.base = {n: state.now[n].value for n in state.base}
        elif score < state.base["score"]:
            state.base["score"], state.waiting = score, None
        elif score > state.base["score"]:
            state.waiting = state.waiting or 0
            if lines is not None and lines != state.base["lines"]:
                out += evaluate(state)
    if lines_moved:
        if state.base["lines"] is None or lines < state.base["lines"]:
            state.base["lines"] = lines
        elif state.waiting is not None and not score_moved:
            out += evaluate(state)
    if state.waiting is not None:
        state.waiting += 1
        if state.waiting >= PAIR_FRAMES:
            out += evaluate(state)
    if state.suspect:
        state.suspect["age"] += 1
        if state.suspect["age"] >= HOLD_FRAMES:
            out += confirm(state)
    return out


def cheat_end(state: CheatState) -> list[Row]:
    return (evaluate(state) if state.waiting is not None else []) + confirm(state)


def cheat_totals(state: CheatState) -> list[Row]:
    cheat_end(state)
    return [{"cheats": state.cheats, "cheat_points": state.cheats * CHEAT_POINTS, "clear_points": state.clear_points, "unexplained": state.unexplained, "anomalies": state.anomalies, "level_offset_steps": state.off_level}]


#: What the detector has counted over a stream, for the validation report.
CHEAT_TOTALS = Fold("cheats long, cheat_points long, clear_points long, unexplained long, anomalies long, level_offset_steps long", CheatState, lambda state, row: cheat_step(state, row) and [], cheat_totals)
CHEAT = Fold("seq long, ts double, kind string, count long, points long, score_before long, score_after long, lines_delta long", CheatState, cheat_step, cheat_end)


# Frames of play before a game is announced, frames that end one, seconds without a picture that end one.
LEAST_FRAMES, END_FRAMES, LOST_SECONDS = 120, 30, 30.0


def session_fold(least_frames: int = LEAST_FRAMES, end_frames: int = END_FRAMES, lost_seconds: float = LOST_SECONDS) -> Fold:
    """Games of a stream: a row when one ends that was announced, in event time.

    A game starts at a new game or the first frame of play, is announced after enough frames of play with a score, and
    ends by menus in a row, a new game, no picture, or the stream's end. Pauses touch neither count.
    """

    def fresh(row: Row) -> Row:
        return {"started": row["ts"], "start_seq": row["seq"], "frames": 0, "ends": 0, "over": False, "lost": None, "score": None, "lines": None, "level": None, "announced": False, "last_ts": row["ts"]}

    def close(state: Row, reason: str) -> list[Row]:
        game, state["game"] = state["game"], None
        if not game or not game["announced"]:
            return []
        return [{"start_seq": game["start_seq"], "started_at": game["started"], "ended_at": game["last_ts"], "end_reason": reason, "play_frames": game["frames"], "score": game["score"], "lines": game["lines"], "level": game["level"]}]

    def step(state: Row, row: Row) -> list[Row]:
        out: list[Row] = []
        if row.get("new_game"):
            out += close(state, "reset")
            state["game"] = fresh(row)
        elif state["game"] is None and row["state"] == "in_game":
            state["game"] = fresh(row)
        game = state["game"]
        if game is None:
            return out
        game["last_ts"] = row["ts"]
        if row["state"] == "in_game":
            game.update(frames=game["frames"] + 1, ends=0, over=False, lost=None)
            for name in ("score", "lines", "level"):
                game[name] = row.get(name) if row.get(name) is not None else game[name]
            game["announced"] |= game["frames"] >= least_frames and game["score"] is not None
        elif row["state"] in ("no_signal", "unknown"):
            game["lost"] = row["ts"] if game["lost"] is None else game["lost"]
            if row["ts"] - game["lost"] >= lost_seconds:
                out += close(state, "signal_lost")
        elif row["state"] != "paused":
            game.update(lost=None, ends=game["ends"] + 1, over=game["over"] or row["state"] in ("game_over", "highscore_entry"))
            if game["ends"] >= end_frames:
                out += close(state, "game_over" if game["over"] else "reset")
        return out

    return Fold("start_seq long, started_at double, ended_at double, end_reason string, play_frames long, score long, lines long, level long", lambda: {"game": None}, step, lambda state: close(state, "shutdown"))


SESSION = session_fold()


def publish_fold(interval: float, keys: tuple[str, ...]) -> Fold:
    """Frames to publish: the key differs from the one published last, and a quarter less than the interval has passed (4 ms at most)."""
    wait = interval - min(interval * 0.25, 0.004)

    def step(state: Row, row: Row) -> list[Row]:
        key = [row[k] for k in keys]
        if state["seq"] >= 0 and (key == state["key"] or row["ts"] - state["ts"] < wait):
            return []
        state.update(seq=state["seq"] + 1, key=key, ts=row["ts"])
        return [{"seq": row["seq"], "out_seq": state["seq"]}]

    return Fold("seq long, out_seq long", lambda: {"seq": -1, "key": None, "ts": 0.0}, step)


def timeline_fold(value: str, gap: float = 0.25, cap: int = 2048) -> Fold:
    """Samples at least a gap apart; at the cap every other one is dropped and the gap doubles. One row a sample kept at the end."""

    def step(state: Row, row: Row) -> list[Row]:
        if row[value] is None or (state["kept"] and row["ts"] - state["kept"][-1][1] < state["gap"]):
            return []
        if len(state["kept"]) >= cap:
            state["kept"], state["gap"] = state["kept"][::2], state["gap"] * 2
        state["kept"].append((row["seq"], row["ts"], row[value]))
        return []

    return Fold("seq long, ts double, height double", lambda: {"kept": [], "gap": gap}, step, lambda state: [{"seq": s, "ts": t, "height": float(v)} for s, t, v in state["kept"]])


def guard_fold(name: str, most_step: int, fault: str) -> Fold:
    """One value under the plausibility rules by itself: it must not fall, nor rise by over `most_step`, unless it insists."""

    def step(guard: Guard, row: Row) -> list[Row]:
        value, events = row[name], []
        if value is not None:
            why = None if guard.value is None or 0 <= value - guard.value <= most_step else "monotonic" if value < guard.value else fault
            guard.judge(value, why, name, events)
        return [{"seq": row["seq"], "value": guard.value if value is not None else None, "reason": events[0]["reason"] if events else None, "severity": events[0]["severity"] if events else None}]

    return Fold("seq long, value long, reason string, severity string", Guard, step)


def latch_fold(need: int = 60) -> Fold:
    """The base that readings have settled on: `need` equal ones in a row latch it; a failed read breaks the row and leaves the latch."""

    def step(state: Row, row: Row) -> list[Row]:
        observe_base(state, row["base"], need)
        return [{"seq": row["seq"], "latched": state["latched"]}]

    return Fold("seq long, latched string", unlatched, step)


def unlatched() -> Row:
    return {"latched": None, "count": 0, "last": None}


def observe_base(state: Row, base: str | None, need: int) -> None:
    state["count"] = 0 if base is None else state["count"] + 1 if base == state["last"] else 1
    state["last"] = base
    if base is not None and state["count"] >= need > 0:
        state["latched"] = base


def latched_read_fold(need: int = 60) -> Fold:
    """A field read in two bases (dec, dec_conf, hex, hex_conf): the latched base first; the other, where that fails, is latched at once.

    Unlatched, hex wins only if it is read alone or more surely; such reads feed the latch.
    """

    def step(state: Row, row: Row) -> list[Row]:
        if state["latched"]:
            other = "hex" if state["latched"] == "dec" else "dec"
            base = other if row[state["latched"]] is None and row[other] is not None else state["latched"]
            if base == other:
                state.update(latched=other, last=other, count=need)
        else:
            base = "hex" if row["hex"] is not None and (row["dec"] is None or row["hex_conf"] > row["dec_conf"] + 1e-6) else "dec"
            observe_base(state, base if row[base] is not None else None, need)
        return [{"seq": row["seq"], "value": row[base], "base": base, "latched": state["latched"]}]

    return Fold("seq long, value long, base string, latched string", unlatched, step)


def curtain_fold(need: int = 2) -> Fold:
    """Whether a curtain falls: the prefix of full rows has grown, to two and more, in `need` steps; shrinking starts anew."""

    def step(state: Row, row: Row) -> list[Row]:
        full = row["full_rows"] or 0
        if full < state["full"]:
            state["steps"] = 0
        elif full > state["full"] and full >= 2:
            state["steps"] += 1
        state["full"] = full
        return [{"seq": row["seq"], "falling": state["steps"] >= need}]

    return Fold("seq long, falling boolean", lambda: {"full": 0, "steps": 0}, step)


def animation_fold(columns: int = 10, factor: float = 1.5, dark: float = 20.0, alpha: float = 0.1, calm: int = 2, most: int = 20) -> Fold:
    """Whether a clear animation runs, over rows of luma, board (a bit mask for each row of cells, from the top) and suppress.

    A flash, or a row that was full and no longer is, starts one unless suppressed; a board that stands still for `calm`
    frames, or the limit, ends it. The mean luma stands still meanwhile. `expected` is the board that an animation must
    leave, given out where it ends: the board before it without its full rows; null if it had none.
    """
    full = (1 << columns) - 1

    def step(state: Row, row: Row) -> list[Row]:
        luma, board, before, mean = row["luma"], row["board"], state["board"], state["mean"]
        flash = mean is not None and mean > dark and luma > factor * mean
        expected = None
        if state["on"]:
            state["age"] += 1
            state["calm"] = state["calm"] + 1 if board == before else 0
            if state["calm"] >= calm or state["age"] >= most:
                expected = state["expected"]
                state.update(on=False, expected=None)
        elif not row["suppress"] and (flash or (before is not None and any(a == full and b != full for a, b in zip(before, board, strict=True)))):
            kept = [x for x in before or [] if x != full]
            state.update(on=True, age=0, calm=0, expected=[0] * (len(before) - len(kept)) + kept if before and len(kept) < len(before) else None)
        if not state["on"]:
            state["mean"] = luma if mean is None else (1 - alpha) * mean + alpha * luma
        state["board"] = board
        return [{"seq": row["seq"], "animating": state["on"], "flash": flash, "expected": expected}]

    return Fold("seq long, animating boolean, flash boolean, expected array<long>", lambda: {"mean": None, "on": False, "age": 0, "calm": 0, "board": None, "expected": None}, step)


def settle_against(expected: list[int] | None, board: list[int], most: int = 3) -> bool:
    """Whether a board is what an animation was expected to leave, but for `most` cells."""
    return expected is None or sum((a ^ b).bit_count() for a, b in zip(expected, board, strict=True)) <= most


def after_clear(board: list[list[int]]) -> list[list[int]]:
    """The board once its full rows are gone and the rest has come down."""
    rest = [row for row in board if not all(row)]
    return [[0] * len(board[0]) for _ in range(len(board) - len(rest))] + rest


def mismatches(a: list[list[int]], b: list[list[int]]) -> int:
    return sum(bool(x) != bool(y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))
