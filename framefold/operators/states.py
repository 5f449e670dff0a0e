"""Folds over a station's life: locks, recordings, status, retries and queues; and holds that are windows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefold.operators.folds import FADE, FLOOR, Fold, Row, session_fold
from framefold.operators.windows import KEY, ORDER, last_known, ordered, running, weighted_vote

#: A lock's thresholds and streaks.
ACQUIRE, KEEP, BETTER, ACQUIRE_FRAMES, LOST_FRAMES = 0.55, 0.40, 0.05, 2, 12
#: Frames that end a recording, frames that one must have, and the largest game number.
END_FRAMES, LEAST_FRAMES, MOST_GAMES = 30, 60, 65535
#: Seconds between status messages at least, and a session's length that counts as healthy.
STATUS_GAP, HEALTHY = 0.5, 10.0
#: Fixed value: the card reader protocol that is understood.
PROTOCOL = 2


def lock_fold() -> Fold:
    """The lock on a picture, over rows of solved (whether a solve was run), found (its confidence, null if it failed), dark_ok and hold.

    Not locked: solves of ACQUIRE and more in a row lock. Locked: a better solve is adopted, else a dark well keeps the lock,
    and what is left weakens it; held frames never weaken it. Weak frames in a row lose it.
    """

    def step(s: dict[str, Any], row: Row) -> list[Row]:
        found, hold = row["found"], bool(row["hold"])
        if s["state"] in ("unlocked", "acquiring", "lost"):
            good = found is not None and found >= ACQUIRE
            s["streak"] = s["streak"] + 1 if good else 0
            s["confidence"] = found or 0.0
            s["state"] = "locked" if s["streak"] >= ACQUIRE_FRAMES else "acquiring"
            s["weak"] = 0 if s["state"] == "locked" else s["weak"]
        else:
            tried = row["solved"] and not hold
            better = tried and found is not None and found >= KEEP and found > s["confidence"] + BETTER
            if better or row["dark_ok"] or hold:
                s["state"] = "locked"
                s["weak"] = s["weak"] if hold and not (better or row["dark_ok"]) else 0
                s["confidence"] = found if better else s["confidence"]
            else:
                s["confidence"] = (found or 0.0) if tried else s["confidence"]
                s["weak"] += 1
                s["state"] = "drift"
                if s["weak"] >= LOST_FRAMES:
                    s.update(state="lost", streak=0, weak=0, confidence=0.0)
        return [{"seq": row["seq"], "state": s["state"], "confidence": s["confidence"]}]

    return Fold("seq long, state string, confidence double", lambda: {"state": "unlocked", "streak": 0, "weak": 0, "confidence": 0.0}, step)


def status_fold(interval: float, gap: float = STATUS_GAP) -> Fold:
    """Status messages to send (rows: seq, ts, key): a changed key, but `gap` seconds apart, or one every `interval` seconds."""

    def step(s: dict[str, Any], row: Row) -> list[Row]:
        since = None if s["ts"] is None else row["ts"] - s["ts"]
        changed = row["key"] != s["key"]
        if since is not None and not (since >= interval or (changed and since >= gap)):
            return []
        s.update(ts=row["ts"], key=row["key"])
        return [{"seq": row["seq"], "changed": changed}]

    return Fold("seq long, changed boolean", lambda: {"ts": None, "key": None}, step)


def backoff_fold(least: float, most: float, healthy: float = HEALTHY) -> Fold:
    """Seconds until the next try after each failure (rows: seq, lasted): doubling up to `most`, from `least` again after a healthy session."""

    def step(s: dict[str, Any], row: Row) -> list[Row]:
        wait = least if row["lasted"] >= healthy else s["wait"]
        s["wait"] = min(2 * wait, most)
        return [{"seq": row["seq"], "retry_in": wait}]

    return Fold("seq long, retry_in double", lambda: {"wait": least}, step)


def queue_fold(size: int, drop_oldest: bool = True) -> Fold:
    """A bounded queue between a source and a slow reader (rows: seq, kind `put` or `take`): what became of each item put.

    A full queue drops its oldest item, or the one put; a take from an empty queue gives nothing. Items left are `waiting`.
    """

    def fate(seq: int, what: str) -> Row:
        return {"seq": seq, "fate": what}

    def step(held: list[int], row: Row) -> list[Row]:
        if row["kind"] == "take":
            return [fate(held.pop(0), "delivered")] if held else []
        if len(held) < size:
            held.append(row["seq"])
            return []
        if not drop_oldest:
            return [fate(row["seq"], "dropped")]
        held.append(row["seq"])
        return [fate(held.pop(0), "dropped")]

    return Fold("seq long, fate string", list, step, lambda held: [fate(seq, "waiting") for seq in held])


def recorder_fold(partial: bool = False, end_frames: int = END_FRAMES, least_frames: int = LEAST_FRAMES) -> Fold:
    """Recordings of a stream's games, a row when one is finished.

    One starts at a new game, or with `partial` at any frame of play. Play, pauses and the first frames of a game's end are
    recorded; `end_frames` frames without play in a row, a new game or the stream's end finish it; short ones are dropped.
    Rows: seq, ts, state, new_game, and lines, level, score, piece, counts, field, which may be null or missing. The field is
    held while it is unknown.
    """
    from framefold.sources.recordings import encode

    def begin(s: dict[str, Any], row: Row) -> None:
        s["game"] = {"gameid": s["next"], "start_seq": row["seq"], "start": row["ts"], "records": [], "away": 0, "field": [0] * 200}
        s["next"] = s["next"] % MOST_GAMES + 1

    def finish(s: dict[str, Any]) -> list[Row]:
        game, s["game"] = s["game"], None
        if game is None or len(game["records"]) < least_frames:
            return []
        return [{"gameid": game["gameid"], "start_seq": game["start_seq"], "frames": len(game["records"]), "recording": encode(game["records"])}]

    def record(game: dict[str, Any], row: Row) -> None:
        if row.get("field") is not None:
            game["field"] = [min(c, 3) for c in row["field"]]
        value = lambda name, most: None if row.get(name) is None else min(max(row[name], 0), most)
        counts = row.get("counts") or [None] * 7
        game["records"].append(
            {"game_type": 1, "player_num": 0, "gameid": game["gameid"], "ctime_ms": int(max(row["ts"] - game["start"], 0.0) * 1000 + 0.5), "lines": value("lines", 0xFFE), "level": value("level", 254), "score": value("score", 0xFFFFFE),
             "instant_das": None, "preview": row.get("piece"), "cur_piece_das": None, "cur_piece": None, "counts": [None if c is None else min(max(c, 0), 0x3FE) for c in counts], "field": game["field"]}
        )

    def step(s: dict[str, Any], row: Row) -> list[Row]:
        out: list[Row] = []
        if row.get("new_game"):
            out += finish(s)
            begin(s, row)
        elif s["game"] is None and partial and row["state"] == "in_game":
            begin(s, row)
        game = s["game"]
        if game is None:
            return out
        playing = row["state"] in ("in_game", "paused")
        game["away"] = 0 if playing else game["away"] + 1
        if playing or (row["state"] == "game_over" and game["away"] <= end_frames):
            record(game, row)
        return out + (finish(s) if game["away"] >= end_frames else [])

    return Fold("gameid long, start_seq long, frames long, recording binary", lambda: {"game": None, "next": 1}, step, finish)


def session_events_fold(least_frames: int = 120, end_frames: int = 30, lost_seconds: float = 30.0) -> Fold:
    """What a station tells of its games: start, cheat and end rows, by the rules of `session_fold`.

    Rows have besides that fold's columns player (whose card is known then), cheat (how many were found with this frame) and
    gap (seconds without capture before it). A game starts when it is announced; cheats found before are told right after.
    The first player known during a game is its player. A long gap ends a game before its row counts.
    """
    inner = session_fold(least_frames, end_frames, lost_seconds)

    def tell(kind: str, game: Row, seq: int, s: dict[str, Any], **more: Any) -> Row:
        return {"kind": kind, "start_seq": game["start_seq"], "seq": seq, "player": s["player"], "end_reason": None, "count": None} | more

    def advance(s: dict[str, Any], row: Row) -> list[Row]:
        before = s["inner"]["game"]
        out = [tell("end", r, row["seq"], s, end_reason=r["end_reason"]) for r in inner.step(s["inner"], row)]
        if s["inner"]["game"] is not before:
            s.update(player=None, announced=False, early=[])
        return out

    def step(s: dict[str, Any], row: Row) -> list[Row]:
        out: list[Row] = []
        game = s["inner"]["game"]
        if game is not None and (row.get("gap") or 0.0) >= lost_seconds:
            game["lost"] = row["ts"] - row["gap"]
            out += advance(s, {"seq": row["seq"], "ts": row["ts"], "state": "no_signal"})
        out += advance(s, row)
        game = s["inner"]["game"]
        if game is None:
            return out
        s["player"] = s["player"] or row.get("player")
        if row.get("cheat"):
            s["early"].append((row["seq"], row["cheat"]))
        if game["announced"]:
            out += [] if s["announced"] else [tell("start", game, row["seq"], s)]
            out += [tell("cheat", game, seq, s, count=n) for seq, n in s["early"]]
            s.update(announced=True, early=[])
        return out

    def end(s: dict[str, Any]) -> list[Row]:
        return [tell("end", r, r["start_seq"], s, end_reason=r["end_reason"]) for r in inner.end(s["inner"])]

    return Fold("kind string, start_seq long, seq long, player string, end_reason string, count long", lambda: {"inner": inner.start(), "player": None, "announced": False, "early": []}, step, end)


# Holds that are windows


def counts_hold(frames: DataFrame, counts: str, pieces: int = 7) -> DataFrame:
    """held_counts: the greatest read so far of each piece's count; counts_confidence: that of the last read, fading by frame."""
    held = F.array(*(F.max(F.get(F.col(counts), F.lit(k))).over(running()) for k in range(pieces)))
    read = F.col(counts).isNotNull() & (F.col("conf") > 0)
    age = F.col(ORDER) - last_known(F.when(read, F.col(ORDER)))
    return frames.withColumn("held_counts", held).withColumn("counts_confidence", last_known(F.when(read, F.col("conf"))) * F.pow(F.lit(FADE), age))


def piece_vote(frames: DataFrame, value: str, cells: str, place: str, rows: int = 5) -> DataFrame:
    """fused_piece: the vote of the last reads; its confidence fades by frame and it is null below the floor. Cells are those of the last read, the place the last known."""
    read = frames.where(F.col(value).isNotNull() & (F.col("conf") > 0))
    winner, confidence = weighted_vote(F.col(value), F.col("conf"), rows)
    voted = read.select(KEY, ORDER, winner.alias("__piece"), confidence.alias("__confidence"), F.col(cells).alias("__cells"), F.col(ORDER).alias("__at"))
    joined = frames.join(voted, [KEY, ORDER], "left")
    faded = last_known(F.col("__confidence")) * F.pow(F.lit(FADE), F.col(ORDER) - last_known(F.col("__at")))
    out = joined.withColumn("piece_confidence", faded).withColumn("fused_piece", F.when(F.col("piece_confidence") >= FLOOR, last_known(F.col("__piece"))))
    out = out.withColumn("fused_cells", F.when(F.col("fused_piece").isNotNull(), last_known(F.col("__cells")))).withColumn("fused_place", last_known(F.col(place)))
    return out.drop("__piece", "__confidence", "__cells", "__at")


def epochs(frames: DataFrame, flag: str) -> DataFrame:
    """epoch: how often a stream was cut (a seek, another source) up to a frame. Folds keyed by it forget what was before a cut."""
    return frames.withColumn("epoch", F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("long")).over(running()))


def trusted_cards(cards: DataFrame) -> DataFrame:
    """Card events of a reader (kind, uid, protocol): the card present after each and the last one seen.

    A hello of the right protocol makes the reader trusted and tells its card; another one, or a disconnect, ends trust and
    takes the card away. Events of a reader that isn't trusted change nothing; a status tells the card as it is.
    """
    hello = F.when(F.col("kind") == "hello", F.col("protocol") == PROTOCOL).when(F.col("kind") == "disconnect", False)
    trusted = cards.withColumn("trusted", F.coalesce(F.last(hello, ignorenulls=True).over(running()), F.lit(False)))
    none = F.lit(None).cast("string")
    told = F.when(~F.col("trusted"), F.when(F.col("kind").isin("hello", "disconnect"), F.struct(none.alias("uid")))).when(F.col("kind").isin("hello", "present", "status"), F.struct(F.col("uid").alias("uid"))).when(F.col("kind") == "removed", F.struct(none.alias("uid")))
    seen = F.when(F.col("trusted") & F.col("kind").isin("hello", "present", "status"), F.col("uid"))
    return trusted.withColumn("present_uid", F.last(told, ignorenulls=True).over(running())["uid"]).withColumn("last_seen", last_known(seen))


def menu_screen(logo: Column, chrome: Column, mean: Column, lower_dark: Column, well: Column, before: Column) -> Column:
    """The menu that four signals of a frame speak for, the first rule that fits; null without one."""
    # The signals' limits.
    entry = F.coalesce(before.isin("game_over", "highscore_entry"), F.lit(False))
    return (
        F.when((logo > 0.18) & (chrome < 0.32), "title")
        .when((mean < 28) & (chrome < 0.32), "title")
        .when(well, F.lit(None).cast("string"))
        .when(chrome >= 0.32, F.when(entry, "highscore_entry").otherwise("type_select"))
        .when(lower_dark > 0.5, "level_select")
    )


def live_view(frames: DataFrame) -> DataFrame:
    """What is shown live of a frame: rates to four digits, and the board as strings of digits only during play."""
    from framefold.functions.formats import digit_rows

    return frames.withColumn("confidence", F.round("confidence", 4)).withColumn("board", F.when(F.col("state") == "in_game", digit_rows(F.col("board"))))


def before_state(frames: DataFrame) -> DataFrame:
    return frames.withColumn("before", F.lag("state").over(ordered()))
