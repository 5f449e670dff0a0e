"""Scalar rules of the game as column expressions and as plain functions that folds share."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of pieces, the base score of one to four lines, and names of clears.
PIECES = ("T", "J", "Z", "O", "S", "L", "I")
BASE_SCORES = (40, 100, 300, 1200)
CLEAR_NAMES = ("single", "double", "triple", "tetris")
#: States that count as play, and as menus.
PLAY_STATES = ("in_game", "paused")
MENU_STATES = ("title", "type_select", "level_select", "game_over", "highscore_entry")
#: Score slack of an attribution, largest line step, largest rail step, and lines of a possible total.
SCORE_SLACK, MOST_LINES, MOST_RAIL, MOST_TOTAL = 150, 8, 8, 16
DROUGHT = 13
PACE_LINES = 230


def is_gameplay(state: Column) -> Column:
    return state.isin(*PLAY_STATES)


def is_lock_hold(state: Column) -> Column:
    """States in which a lost lock is waited out."""
    return F.coalesce(state.isin("paused", "game_over", "title", "type_select", "level_select", "highscore_entry", "no_signal"), F.lit(False))


def may_pause(before: Column) -> Column:
    """States that a pause may follow."""
    return F.coalesce(before.isin(*PLAY_STATES), F.lit(False))


def may_fall(before: Column) -> Column:
    """States that a falling curtain may follow."""
    return F.coalesce(before.isin(*PLAY_STATES, "game_over"), F.lit(False))


def is_sampled(seq: Column, every: int = 6) -> Column:
    """Frames on which the piece counts are read."""
    return F.pmod(seq, F.lit(every)) == 0


def is_menu(state: Column) -> Column:
    return state.isin(*MENU_STATES)


def first_level_threshold(start: Column) -> Column:
    """Lines at which the level first rises from a start level."""
    return F.least(10 * start + 10, F.greatest(F.lit(100), 10 * start - 50))


def expected_level(start: Column, lines: Column) -> Column:
    """The level that a start level and a line count imply."""
    threshold = first_level_threshold(start)
    return F.when(lines < threshold, start).otherwise(start + 1 + F.floor((lines - threshold) / 10))


def infer_start_level(level: Column, lines: Column) -> Column:
    """The largest start level from which the lines give the level; else the level itself."""
    fits = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(level, F.lit(0)).cast("long")), lambda s: expected_level(s, lines) == level)
    return F.coalesce(F.array_max(fits), level)


def clear_base_score(lines: Column) -> Column:
    """The base score of a clear; null for other line counts."""
    return F.element_at(F.array(*map(F.lit, BASE_SCORES)), F.when(lines.between(1, 4), lines).cast("int"))


def clear_reason(lines: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLEAR_NAMES)), F.when(lines.between(1, 4), lines).cast("int"))


def clear_points(lines: Column, level: Column) -> Column:
    return clear_base_score(lines) * (level + 1)


def missing_in_gap(gap: Column, fps: Column) -> Column:
    """Frames that a clock gap lacks: none below one and a half frames."""
    return F.when((fps <= 0) | (gap * fps < 1.5), F.lit(0)).otherwise(F.greatest(F.round(gap * fps) - 1, F.lit(0))).cast("long")


def slug(text: Column) -> Column:
    """Letters and digits with single underscores between, at most 64 long."""
    return F.substring(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")), 1, 64)


@cache
def compositions(lines: int, most: int = 4) -> tuple[tuple[int, ...], ...]:
    """The ways to clear so many lines in clears of one to four lines, larger ones first."""
    if not lines:
        return ((),)
    return tuple((part, *rest) for part in range(min(most, lines), 0, -1) for rest in compositions(lines - part, part))


@cache
def clear_base_sums(lines: int) -> tuple[int, ...]:
    """The distinct sums of base scores that so many lines can make, rising."""
    return tuple(sorted({sum(BASE_SCORES[p - 1] for p in c) for c in compositions(lines)}))


def clear_point_candidates(lines: int, levels: tuple[int | None, ...]) -> tuple[int, ...]:
    """The points that so many lines can make on one of the levels; none over MOST_TOTAL lines."""
    if lines > MOST_TOTAL:
        return ()
    if lines <= 0:
        return (0,)
    return tuple(sorted({s * (level + 1) for level in levels if level is not None for s in clear_base_sums(lines)}))


def base_sums_expr(lines: Column) -> Column:
    """The array of `clear_base_sums`, as a lookup by line count up to MOST_TOTAL."""
    table = F.array(*(F.array(*(F.lit(x).cast("long") for x in clear_base_sums(n))) for n in range(MOST_TOTAL + 1)))
    return F.when(lines.between(0, MOST_TOTAL), F.element_at(table, F.when(lines.between(0, MOST_TOTAL), lines + 1).otherwise(1).cast("int")))


def point_candidates_expr(lines: Column, level: Column) -> Column:
    return F.transform(base_sums_expr(lines), lambda s: s * (level + 1))


def expected_level_of(start: int, lines: int) -> int:
    threshold = min(10 * start + 10, max(100, 10 * start - 50))
    return start if lines < threshold else start + 1 + (lines - threshold) // 10


def infer_start_level_of(level: int, lines: int) -> int:
    return next((s for s in range(level, -1, -1) if expected_level_of(s, lines) == level), level)


def attribute_clears(lines: int, gained: int | None, level: int | None) -> tuple[int, ...] | None:
    """The composition whose points come nearest to the gain within the slack of drops, over all its clears; null on a tie or without one."""
    if gained is None or level is None or not 0 < lines <= MOST_LINES:
        return None
    scored = [(gained - sum(BASE_SCORES[p - 1] for p in c) * (level + 1), c) for c in compositions(lines)]
    fits = sorted((r, k, c) for k, (r, c) in enumerate(scored) if 0 <= r <= SCORE_SLACK)
    if not fits or (len(fits) > 1 and fits[0][0] == fits[1][0]):
        return None
    return fits[0][2]


def greedy_clears(lines: int) -> tuple[int, ...]:
    """Clears of four, and one of the rest."""
    return (4,) * (lines // 4) + ((lines % 4,) if lines % 4 else ())


def round_half_up(x: float) -> int:
    return math.floor(x + 0.5)
