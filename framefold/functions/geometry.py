"""Geometry and colour as column expressions: matrices, quads, rectangles, Lab colours and cell colours.

Points, rectangles (x, y, width, height), Lab colours and row-major 3 x 3 matrices are arrays of doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The neutral point of a and b, chroma below which a colour has no hue, and what half a turn of hue costs.
NEUTRAL, LEAST_CHROMA, HUE_COST = 128.0, 30.0, 120.0
#: Where the score of a quad's height over width rises from 0, is 1, and falls to 0 again.
ASPECT_RISE, ASPECT_FALL = (1.0, 1.1), (2.2, 2.6)
#: The two accent colours of each level modulo 10, without a level, and white.
ACCENTS = (
    ("#0058F8", "#3CBCFC"),
    ("#00A800", "#B8F818"),
    ("#D800CC", "#F878F8"),
    ("#0058F8", "#58D854"),
    ("#E40058", "#58F898"),
    ("#58F898", "#6888FC"),
    ("#F83800", "#7C7C7C"),
    ("#6844FC", "#A80020"),
    ("#0058F8", "#F83800"),
    ("#F83800", "#FC9838"),
)
NO_LEVEL_ACCENTS, WHITE = ("#3CBCFC", "#F83800"), "#FCFCFC"
#: The colours of falling pieces, and of none.
PIECE_COLOURS = {"I": "#00F0F0", "O": "#F0F000", "T": "#A000F0", "S": "#00F000", "Z": "#F00000", "J": "#0000F0", "L": "#F0A000"}
NO_PIECE_COLOUR = "#808080"


def at(values: Column, k: int) -> Column:
    return F.get(values, F.lit(k))


def lab_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def hue_angle(lab: Column) -> Column:
    return F.atan2(at(lab, 2) - NEUTRAL, at(lab, 1) - NEUTRAL)


def chroma(lab: Column) -> Column:
    return F.hypot(at(lab, 1) - NEUTRAL, at(lab, 2) - NEUTRAL)


def assign_cost(lab: Column, target: Column, hue_weight: float) -> Column:
    """What it costs to take a colour for the target: the distance, and where both have a hue a share of the turn between them."""
    turn = F.abs(hue_angle(lab) - hue_angle(target))
    turn = F.least(turn, 2 * math.pi - turn)
    hued = (chroma(lab) >= LEAST_CHROMA) & (chroma(target) >= LEAST_CHROMA) & F.lit(hue_weight > 0)
    distance = lab_distance(lab, target)
    return F.when(hued, (1 - hue_weight) * distance + hue_weight * turn / math.pi * HUE_COST).otherwise(distance)


def cell_colour(level: Column, cell: Column) -> Column:
    """The colour of a settled cell: 2 and 3 are the level's accents, others white."""
    accents = F.array(*(F.array(*map(F.lit, pair)) for pair in ACCENTS))
    own = F.when(level.isNull(), F.array(*map(F.lit, NO_LEVEL_ACCENTS))).otherwise(F.get(accents, F.pmod(level, F.lit(10)).cast("int")))
    return F.when(cell.isin(2, 3), F.get(own, (cell - 2).cast("int"))).otherwise(WHITE)


def piece_colour(piece: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PIECE_COLOURS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.coalesce(piece, F.lit("-"))), F.lit(NO_PIECE_COLOUR))


def matrix_product(a: Column, b: Column) -> Column:
    return F.array(*(sum((at(a, 3 * r + k) * at(b, 3 * k + c) for k in range(3)), F.lit(0.0)) for r in range(3) for c in range(3)))


def matrix_inverse(m: Column) -> Column:
    """The inverse by cofactors; null for a singular matrix."""

    def minor(r: int, c: int) -> Column:
        rows, columns = [k for k in range(3) if k != r], [k for k in range(3) if k != c]
        return at(m, 3 * rows[0] + columns[0]) * at(m, 3 * rows[1] + columns[1]) - at(m, 3 * rows[0] + columns[1]) * at(m, 3 * rows[1] + columns[0])

    size = at(m, 0) * minor(0, 0) - at(m, 1) * minor(0, 1) + at(m, 2) * minor(0, 2)
    return F.when(size != 0, F.array(*(minor(c, r) * (-1 if (r + c) % 2 else 1) / size for r in range(3) for c in range(3))))


def project(m: Column, x: Column, y: Column) -> Column:
    """The image (x, y) of a point."""
    low = at(m, 6) * x + at(m, 7) * y + at(m, 8)
    return F.array((at(m, 0) * x + at(m, 1) * y + at(m, 2)) / low, (at(m, 3) * x + at(m, 4) * y + at(m, 5)) / low)


def quad_sides(quad: Column) -> tuple[Column, Column]:
    """Mean width and height of a quad, its corners being points clockwise from the top left."""
    corner = [F.get(quad, F.lit(k)) for k in range(4)]
    far = lambda a, b: F.hypot(at(corner[a], 0) - at(corner[b], 0), at(corner[a], 1) - at(corner[b], 1))
    return (far(1, 0) + far(2, 3)) / 2, (far(3, 0) + far(2, 1)) / 2


def quad_aspect(quad: Column) -> Column:
    width, height = quad_sides(quad)
    return height / F.greatest(width, F.lit(1e-6))


def aspect_score(aspect: Column) -> Column:
    (a, b), (c, d) = ASPECT_RISE, ASPECT_FALL
    return F.greatest(F.least((aspect - a) / (b - a), (d - aspect) / (d - c), F.lit(1.0)), F.lit(0.0))


def quad_centre(quad: Column) -> Column:
    mean = lambda k: F.aggregate(F.transform(quad, lambda p: at(p, k)), F.lit(0.0), lambda s, x: s + x) / 4
    return F.array(mean(0), mean(1))


def scaled(rect: Column, sx: Column, sy: Column) -> Column:
    return F.array(at(rect, 0) * sx, at(rect, 1) * sy, at(rect, 2) * sx, at(rect, 3) * sy)


def bounds(rect: Column) -> Column:
    """Whole pixel bounds (x0, y0, x1, y1): halves go to the even side, nothing is below zero or ends before it begins."""
    low = [F.greatest(F.bround(at(rect, k)), F.lit(0.0)) for k in (0, 1)]
    high = [F.greatest(F.bround(at(rect, k) + at(rect, k + 2)), low[k]) for k in (0, 1)]
    return F.transform(F.array(*low, *high), lambda x: x.cast("long"))


def box_distance(a: Column, b: Column) -> Column:
    """The farthest that any side of one rectangle is from the other's."""
    return F.greatest(*(F.abs(at(a, k) - at(b, k)) for k in (0, 1)), *(F.abs(at(a, k) + at(a, k + 2) - at(b, k) - at(b, k + 2)) for k in (0, 1)))
