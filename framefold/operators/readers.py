"""Readers of a rectified picture, in numpy; templates and layouts are parameters.

Luma images are arrays of bytes, rows first. A rectangle is (x, y, width, height). Boards are arrays of 20 x 10.
"""

from __future__ import annotations

import numpy as np

from framefold.operators.kernels import components, footprint_name, masked_pearson

#: A blank cell's luma, the least score and margin of a digit, and the pixels that a cell is moved by.
BLANK, LEAST_SCORE, LEAST_MARGIN, MOVE = 12.0, 0.62, 0.02, 2
#: Share of the bright contrast and limits of the fill margin; share and limits of the chroma margin; least contrast that lets chroma count.
FILL_SHARE, FILL, CHROMA_SHARE, CHROMA, CHROMA_FROM = 0.18, (14.0, 40.0), 0.5, (10.0, 20.0), 6.0
#: The nearest colour is unsure from this share of the next one's distance on; cells fresh at most; screens' least score and margin.
UNSURE, MOST_FRESH, SCREEN = 0.75, 6, (0.8, 0.05)


def cell_bounds(x: float, y: float, w: float, h: float) -> tuple[int, int, int, int]:
    """Whole bounds (x0, y0, x1, y1), halves to the even side."""
    return round(x), round(y), round(x + w), round(y + h)


def best_template(patches: list[np.ndarray], templates: dict[str, np.ndarray]) -> tuple[str | None, float, float]:
    """(label, score, margin): of the patch that fits any template best, the first among equals, its best template, the last among equals."""
    if not patches or not templates:
        return None, 0.0, 0.0
    labels = list(templates)

    def unit(x: np.ndarray) -> np.ndarray:
        v = x.astype(np.float64).ravel() - x.mean()
        return v / max(np.linalg.norm(v), 1e-12)

    scores = np.stack([unit(p) for p in patches]) @ np.stack([unit(templates[t]) for t in labels]).T
    own = scores[int(scores.max(axis=1).argmax())]
    best = len(own) - 1 - int(own[::-1].argmax())
    other = np.delete(own, best).max(initial=-1.0)
    score, second = (own[best] + 1) / 2, (other + 1) / 2 if other > -1 else 0.0
    return labels[best], float(score), float(max(score - second, 0.0))


def read_digits(luma: np.ndarray, field: tuple[float, float, float, float], digits: int, templates: dict[str, np.ndarray], base: int) -> tuple[int | None, float]:
    """(value, confidence) of a field of even cells. Blank cells are skipped; one cell that isn't sure, or none with ink, leaves it unread."""
    x, y, w, h = field
    wide, allowed = w / digits, {t: p for t, p in templates.items() if int(t, 16) < base}
    value, scores = 0, []
    for k in range(digits):
        x0, y0, x1, y1 = cell_bounds(x + k * wide, y, wide, h)
        cell = luma[max(y0, 0) : y1, max(x0, 0) : x1]
        if not cell.size or cell.mean() < BLANK:
            continue
        patches = []
        for dy in range(-MOVE, MOVE + 1):
            for dx in range(-MOVE, MOVE + 1):
                a, b, c, d = cell_bounds(x + k * wide + dx, y + dy, wide, h)
                if a >= 0 and b >= 0 and c <= luma.shape[1] and d <= luma.shape[0]:
                    patches.append(luma[b:d, a:c])
        label, score, margin = best_template(patches or [cell], allowed)
        if label is None or score < LEAST_SCORE or margin < LEAST_MARGIN:
            return None, 0.0
        value = value * base + int(label, 16)
        scores.append(score)
    return (value, float(np.mean(scores))) if scores else (None, 0.0)


def read_number(luma: np.ndarray, field: tuple[float, float, float, float], digits: int, templates: dict[str, np.ndarray]) -> tuple[int | None, float, int]:
    """(value, confidence, base): decimal, or hexadecimal where only that is read or it is surer."""
    (dec, dec_sure), (hexa, hex_sure) = (read_digits(luma, field, digits, templates, b) for b in (10, 16))
    if hexa is not None and (dec is None or hex_sure > dec_sure + 1e-6):
        return hexa, hex_sure, 16
    return dec, dec_sure, 10


def read_counts(luma: np.ndarray, fields: list[tuple[float, float, float, float]], templates: dict[str, np.ndarray], digits: int = 3) -> tuple[list[int | None], float]:
    """The piece counts, a field each, and the mean confidence of those read."""
    read = [read_digits(luma, f, digits, templates, 10) for f in fields]
    sure = [c for v, c in read if v is not None]
    return [v for v, _ in read], float(np.mean(sure)) if sure else 0.0


def contrast(cell: np.ndarray) -> float | None:
    """Mean of a cell's middle over the median of eight places on its border; null for cells under three pixels."""
    h, w = cell.shape
    if h < 3 or w < 3:
        return None
    middle = cell[h // 4 : h - h // 4, w // 4 : w - w // 4].mean()
    edge = [cell[y, x] for y, x in ((0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1), (0, w // 2), (h - 1, w // 2), (h // 2, 0), (h // 2, w - 1))]
    return float(middle - np.median(edge))


def fill_margin(contrasts: np.ndarray) -> float:
    """The contrast from which a cell is filled: a share of the board's bright ones."""
    known = np.maximum(contrasts[np.isfinite(contrasts)], 0)
    return float(np.clip(FILL_SHARE * np.percentile(known, 90), *FILL)) if len(known) else FILL[1]


def bright_lab(lab: np.ndarray, luma: np.ndarray) -> np.ndarray:
    """The mean colour of a cell's brighter half; neutral black without pixels."""
    if not luma.size:
        return np.array([0.0, 128.0, 128.0])
    return lab.reshape(-1, 3)[luma.ravel() >= np.percentile(luma, 50)].mean(axis=0)


def read_board(luma: np.ndarray, lab: np.ndarray, field: tuple[float, float, float, float], targets: np.ndarray, rows: int = 20, columns: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, strength, unsure): 0 is empty, 1 to 3 the nearest of the target colours; strength over 1 is filled; unsure tells colours that two targets may be."""
    x, y, w, h = field
    light, colour = np.zeros((rows, columns)), np.zeros((rows, columns, 3))
    chroma = np.zeros((rows, columns))
    for r in range(rows):
        for c in range(columns):
            x0, y0, x1, y1 = cell_bounds(x + c * w / columns, y + r * h / rows, w / columns, h / rows)
            cell, hues = luma[y0:y1, x0:x1].astype(np.float64), lab[y0:y1, x0:x1].astype(np.float64)
            light[r, c] = contrast(cell) or 0.0
            colour[r, c] = bright_lab(hues, cell)
            if cell.size:
                inner, rim = hues[cell.shape[0] // 4 : -(cell.shape[0] // 4) or None, cell.shape[1] // 4 : -(cell.shape[1] // 4) or None].reshape(-1, 3).mean(axis=0), hues[0, 0]
                chroma[r, c] = np.hypot(*(inner - rim)[1:])
    margin = fill_margin(light.ravel())
    strength = np.maximum(light / margin, np.where(light > CHROMA_FROM, chroma / np.clip(CHROMA_SHARE * margin, *CHROMA), 0.0))
    away = np.sort(np.linalg.norm(colour[:, :, None] - targets, axis=-1), axis=-1)
    nearest = np.linalg.norm(colour[:, :, None] - targets, axis=-1).argmin(axis=-1) + 1
    filled = strength > 1
    return np.where(filled, nearest, 0), strength, filled & (away[..., 0] > UNSURE * away[..., 1])


def falling_piece(board: np.ndarray, settled: np.ndarray) -> tuple[str | None, list[tuple[int, int]], float]:
    """(piece, cells, confidence) of the piece in the air.

    Few cells that the settled stack doesn't have: the topmost group of at most four. Else cells above the lowest run of
    their column: the topmost group, the largest among equals. A group of no piece's shape has confidence 0.3.
    """
    now, held = np.asarray(board) != 0, np.asarray(settled) != 0

    def groups(mask: np.ndarray) -> list[list[tuple[int, int]]]:
        labels, found = components(mask.astype(np.uint8), diagonal=False)
        every = [[(int(r), int(c)) for r, c in np.argwhere(labels == k)] for k in range(1, len(found) + 1)]
        return [g for g in every if len(g) <= 4]

    fresh = now & ~held
    choice: list[tuple[int, int]] = []
    if held.any() and 0 < fresh.sum() <= MOST_FRESH:
        choice = min(groups(fresh), key=lambda g: min(r for r, _ in g), default=[])
    if not choice:
        floating = np.zeros_like(now)
        for c in range(now.shape[1]):
            rows = np.flatnonzero(now[:, c])
            if len(rows):
                broken = np.flatnonzero(np.diff(rows) > 1)
                top = rows[broken[-1] + 1] if len(broken) else rows[0]
                floating[rows[rows < top], c] = True
        choice = min(groups(floating), key=lambda g: (min(r for r, _ in g), -len(g)), default=[])
    if not choice:
        return None, [], 0.0
    piece = footprint_name(choice)
    return piece, sorted(choice), 0.9 if piece else 0.3


def screen_of(tiles: np.ndarray, references: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[str | None, float, float]:
    """(screen, score, margin) of a grid of tile means by the references' masked correlation; no screen where it isn't sure.

    The margin is to the best reference of another screen, or the score itself without one.
    """
    scores = [(masked_pearson(tiles, reference, mask), kind) for kind, reference, mask in references]
    if not scores:
        return None, 0.0, 0.0
    best = max(range(len(scores)), key=lambda k: (scores[k][0], k))
    score, kind = scores[best]
    other = max((s for s, k in scores if k != kind), default=None)
    margin = score if other is None else score - other
    return (kind if score >= SCREEN[0] and margin >= SCREEN[1] else None), score, margin


def from_rgba(data: bytes, width: int, height: int) -> np.ndarray:
    """Blue, green and red of pixels that come as red, green, blue and alpha."""
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4)[..., 2::-1]


def full_rows_from_top(board: np.ndarray) -> int:
    full = (np.asarray(board) != 0).all(axis=1)
    return int(full.argmin()) if not full.all() else len(full)
