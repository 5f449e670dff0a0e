"""Pixel and point kernels in numpy, and how to run one over a column of images.

Images are arrays of bytes, rows first; colour images hold blue, green and red. `over_images` runs a kernel in Arrow
batches over (data, width, height, channels) columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Gray weights of blue, green and red in 15 bits.
GRAY_WEIGHTS, GRAY_BITS = (3735, 19235, 9798), 15


def over_images(frames: DataFrame, key: str, kernel: Callable[[np.ndarray], list], schema: str) -> DataFrame:
    """(key, kernel's values) of each image; null where the bytes don't fit the size."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, w, h, c in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                fits = data is not None and w and h and c and len(data) == w * h * c
                rows.append(kernel(np.frombuffer(data, dtype=np.uint8).reshape((h, w, c) if c > 1 else (h, w))) if fits else [None] * len(names))
            columns = [pa.array(list(values)) for values in zip(*rows, strict=True)] or [pa.nulls(0) for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *names])

    return frames.select(key, "data", "width", "height", "channels").mapInArrow(run, f"{key} {kind}, {schema}")


def gray(image: np.ndarray) -> np.ndarray:
    weighted = image.astype(np.int64) @ np.array(GRAY_WEIGHTS) + (1 << (GRAY_BITS - 1))
    return (weighted >> GRAY_BITS).astype(np.uint8)


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue in half degrees, saturation and value of 0..255, rounded."""
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    v, low = image.max(axis=-1).astype(np.float64), image.min(axis=-1).astype(np.float64)
    d = v - low
    safe = np.where(d > 0, d, 1)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    s = np.where(v > 0, 255 * d / np.where(v > 0, v, 1), 0)
    return np.stack([np.rint(np.where(d > 0, h, 0)) % 180, np.rint(s), v], axis=-1).astype(np.uint8)


def lab(image: np.ndarray) -> np.ndarray:
    """CIE Lab (D65) of 8-bit colour: lightness scaled to 255, a and b moved by 128."""
    x = image[..., ::-1].astype(np.float64) / 255
    x = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    xyz = x @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    out = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def otsu_threshold(image: np.ndarray) -> int:
    """The first threshold with the greatest between-class variance."""
    counts = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    share, moment = np.cumsum(counts) / counts.sum(), np.cumsum(counts * np.arange(256)) / counts.sum()
    low, high = share, 1 - share
    usable = np.minimum(low, high) >= np.finfo(np.float32).eps
    between = np.where(usable, (moment[-1] * low - moment) ** 2 / np.where(usable, low * high, 1), 0)
    return int(between.argmax())


def binary(image: np.ndarray, below: int) -> np.ndarray:
    return np.where(image < below, 255, 0).astype(np.uint8)


def ellipse(size: int) -> np.ndarray:
    """The filled ellipse of an odd size as zeros and ones."""
    r = size // 2
    reach = np.rint(r * np.sqrt(np.maximum(r * r - np.arange(-r, r + 1) ** 2, 0) / (r * r))).astype(int)
    return (np.abs(np.arange(-r, r + 1))[None, :] <= reach[:, None]).astype(int)


def extreme(image: np.ndarray, kernel: np.ndarray, times: int, pick: Callable, outside: int) -> np.ndarray:
    r = kernel.shape[0] // 2
    for _ in range(times):
        wide = np.pad(image, r, constant_values=outside)
        image = pick([wide[y : y + image.shape[0], x : x + image.shape[1]] for y, x in zip(*np.nonzero(kernel), strict=True)], axis=0)
    return image


def erode(image: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    """The least value under the kernel; what is outside never wins."""
    return extreme(image, kernel, times, np.min, 255)


def dilate(image: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    return extreme(image, kernel, times, np.max, 0)


def opened(image: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    return dilate(erode(image, kernel, times), kernel, times)


def closed(image: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    return erode(dilate(image, kernel, times), kernel, times)


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, list[dict[str, float]]]:
    """Labels from 1 in order of first pixels, and each one's area, box and centre. Labels sink to the least in their part."""
    on = mask != 0
    labels = np.where(on, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    big = mask.size + 1
    while True:
        wide = np.pad(np.where(on, labels, big), 1, constant_values=big)
        least = np.minimum.reduce([wide[1:-1, 1:-1], *(wide[1 + y : 1 + y + mask.shape[0], 1 + x : 1 + x + mask.shape[1]] for y, x in steps)])
        least = np.where(on, least, 0)
        flat = np.concatenate(([0], least.ravel()))
        least = np.where(on, flat[least], 0)  # each label takes its own pixel's label
        if np.array_equal(least, labels):
            break
        labels = least
    names, labels = np.unique(labels, return_inverse=True)
    labels = labels.reshape(mask.shape) + (0 if len(names) and names[0] == 0 else 1)
    found = []
    for k in range(1, int(labels.max(initial=0)) + 1):
        y, x = np.nonzero(labels == k)
        found.append({"area": len(y), "x": int(x.min()), "y": int(y.min()), "w": int(np.ptp(x)) + 1, "h": int(np.ptp(y)) + 1, "cx": float(x.mean()), "cy": float(y.mean())})
    return labels, found


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull's corners, in order around."""
    points = np.unique(np.asarray(points, dtype=np.float64), axis=0)
    if len(points) < 3:
        return points

    def side(row: np.ndarray) -> list[np.ndarray]:
        kept: list[np.ndarray] = []
        for p in row:
            while len(kept) > 1:
                u, v = kept[-1] - kept[-2], p - kept[-2]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(side(points) + side(points[::-1]))


def min_area_rect(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, (long, short) sides and four corners of the smallest rectangle; one of its sides lies along a hull side."""
    corners = hull(points)
    sides = np.roll(corners, -1, axis=0) - corners
    along = sides / np.maximum(np.linalg.norm(sides, axis=1, keepdims=True), 1e-12)
    across = np.stack([-along[:, 1], along[:, 0]], axis=1)
    u, v = along @ corners.T, across @ corners.T
    area = np.ptp(u, axis=1) * np.ptp(v, axis=1)
    k = int(area.argmin())
    box = np.array([a * along[k] + b * across[k] for a, b in ((u[k].min(), v[k].min()), (u[k].max(), v[k].min()), (u[k].max(), v[k].max()), (u[k].min(), v[k].max()))])
    return box.mean(axis=0), np.array(sorted((np.ptp(u[k]), np.ptp(v[k])), reverse=True)), box


def match_template(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """The normalised correlation of the template at each place; 0 where either is flat."""
    windows = np.lib.stride_tricks.sliding_window_view(image.astype(np.float64), template.shape)
    t = template - template.mean()
    centred = windows - windows.mean(axis=(-2, -1), keepdims=True)
    norm = np.sqrt((centred**2).sum(axis=(-2, -1)) * (t**2).sum())
    return np.where(norm > 1e-9, (centred * t).sum(axis=(-2, -1)) / np.where(norm > 1e-9, norm, 1), 0)


def masked_pearson(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> float:
    x, y = a[mask] - a[mask].mean(), b[mask] - b[mask].mean()
    norm = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / norm) if norm > 0 else 0.0


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target pixel is the mean of the area it covers, rounded; for smaller targets."""

    def weights(n: int, m: int) -> np.ndarray:
        edge, cell = np.arange(m + 1) * n / m, np.arange(n)
        return np.maximum(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0) * m / n

    return np.clip(np.rint(weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T), 0, 255).astype(np.uint8)


def tile_means(image: np.ndarray, rows: int = 30, columns: int = 32) -> np.ndarray:
    """Mean of each tile of an even grid; the last ones take what is left."""
    ys, xs = (np.arange(n) * size // n for n, size in ((rows, image.shape[0]), (columns, image.shape[1])))
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.float64), ys, axis=0), xs, axis=1)
    return sums / (np.diff(np.append(ys, image.shape[0]))[:, None] * np.diff(np.append(xs, image.shape[1])))


def content_box(image: np.ndarray, bright: int = 40, share: float = 0.03, least: float = 0.5, step: int = 4) -> tuple[int, int, int, int] | None:
    """x, y, width and height of the rows and columns with enough bright samples, every fourth pixel being one; null where either side is under half of the frame's."""
    on = image[::step, ::step] > bright
    sides = []
    for axis, size in ((0, image.shape[1]), (1, image.shape[0])):
        found = np.flatnonzero(on.sum(axis=axis) >= max(int(np.ceil(on.shape[axis] * share)), 1))
        if not len(found):
            return None
        begin, end = int(found[0]) * step, min((int(found[-1]) + 1) * step, size)
        if end - begin < least * size:
            return None
        sides.append((begin, end - begin))
    (x, w), (y, h) = sides
    return x, y, w, h


def two_means(points: np.ndarray, apart: float = 34.0, rounds: int = 8) -> np.ndarray | None:
    """Two centres: the point farthest from the first one, and the farthest from that (the last among equals), then means; null if they coincide or stay close."""
    if len(points) < 2:
        return None

    def farthest(origin: np.ndarray) -> int:
        away = np.linalg.norm(points - origin, axis=1)
        return len(away) - 1 - int(away[::-1].argmax())

    i = farthest(points[0])
    j = farthest(points[i])
    if i == j:
        return None
    centres = np.array([points[i], points[j]], dtype=np.float64)
    for _ in range(rounds):
        own = np.linalg.norm(points[:, None] - centres[None], axis=2).argmin(axis=1)
        moved = np.array([points[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in (0, 1)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres if np.linalg.norm(centres[0] - centres[1]) >= apart else None


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    ends = np.column_stack([points, np.ones(len(points))]) @ np.asarray(h).reshape(3, 3).T
    return ends[:, :2] / ends[:, 2:]


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The map of four or more points by least squares over normalised points; its last entry is 1."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = p.mean(axis=0)
        scale = np.sqrt(2) / max(np.linalg.norm(p - centre, axis=1).mean(), 1e-12)
        t = np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])
        return project(t, p), t

    (a, ta), (b, tb) = normal(np.asarray(src, dtype=np.float64)), normal(np.asarray(dst, dtype=np.float64))
    zero, one = np.zeros(len(a)), np.ones(len(a))
    rows = np.concatenate([np.column_stack([a, one, zero, zero, zero, -b[:, 0] * a[:, 0], -b[:, 0] * a[:, 1], -b[:, 0]]), np.column_stack([zero, zero, zero, a, one, -b[:, 1] * a[:, 0], -b[:, 1] * a[:, 1], -b[:, 1]])])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return (h / h[2, 2]).ravel()


def refined(h: np.ndarray, src: np.ndarray, dst: np.ndarray, rounds: int = 10) -> np.ndarray:
    """The map with the least squared distance, by Gauss-Newton steps from h."""
    for _ in range(rounds):
        base = project(h, src)
        steps = np.eye(9)[:8] * 1e-7 * np.maximum(np.abs(h[:8]), 1e-3)[:, None]
        slope = np.stack([(project(h + s, src) - base).ravel() / s[k] for k, s in enumerate(steps)], axis=1)
        move = np.linalg.lstsq(slope, (dst - base).ravel(), rcond=None)[0]
        h = h + np.append(move, 0)
    return h


def ransac_homography(src: np.ndarray, dst: np.ndarray, near: float = 3.0, rounds: int = 2000, sure: float = 0.995, seed: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """The map that most points agree on, and which do; then refined on those."""
    src, dst = np.asarray(src, dtype=np.float64), np.asarray(dst, dtype=np.float64)
    draws, best = np.random.default_rng(seed), np.zeros(len(src), dtype=bool)
    needed, done = rounds, 0
    while done < min(needed, rounds):
        done += 1
        pick = draws.choice(len(src), 4, replace=False)
        with np.errstate(all="ignore"):
            agree = np.linalg.norm(project(homography(src[pick], dst[pick]), src) - dst, axis=1) <= near
        if agree.sum() > best.sum():
            best = agree
            share = min(best.mean() ** 4, 1 - 1e-12)
            needed = int(np.ceil(np.log(1 - sure) / np.log(1 - share))) if share > 0 else rounds
    if best.sum() < 4:
        return None
    return refined(homography(src[best], dst[best]), src[best], dst[best]), best


def undistort_map(width: int, height: int, k1: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of the undistorted image comes from, for one radial coefficient; the focal length is the longer side."""
    focal = max(width, height)
    y, x = np.mgrid[0:height, 0:width].astype(np.float64)
    x, y = (x - width / 2) / focal, (y - height / 2) / focal
    bend = 1 + k1 * (x * x + y * y)
    return (x * bend * focal + width / 2).astype(np.float32), (y * bend * focal + height / 2).astype(np.float32)


def remap(image: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Bilinear samples at places to a thirty-second of a pixel; outside is 0."""
    x, y = np.rint(xs * 32) / 32, np.rint(ys * 32) / 32
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    wide = np.pad(image.astype(np.float64), 1)

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        inside = (yy >= 0) & (yy < image.shape[0]) & (xx >= 0) & (xx < image.shape[1])
        return np.where(inside, wide[np.clip(yy, -1, image.shape[0]) + 1, np.clip(xx, -1, image.shape[1]) + 1], 0)

    mixed = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def warp(image: np.ndarray, h: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image seen through the map from source to target."""
    y, x = np.mgrid[0:height, 0:width]
    places = project(np.linalg.inv(np.asarray(h).reshape(3, 3)), np.column_stack([x.ravel(), y.ravel()]))
    return remap(image, places[:, 0].reshape(height, width), places[:, 1].reshape(height, width))


def footprint_name(cells: list[tuple[int, int]]) -> str | None:
    """The piece whose cells these are, in any place and turn."""
    return SHAPES.get(placed(cells))


def placed(cells: list[tuple[int, int]]) -> frozenset[tuple[int, int]]:
    top, left = min(r for r, _ in cells), min(c for _, c in cells)
    return frozenset((r - top, c - left) for r, c in cells)


#: The cells of each piece, in one turn.
CELLS = {
    "T": [(0, 0), (0, 1), (0, 2), (1, 1)],
    "J": [(0, 0), (0, 1), (0, 2), (1, 2)],
    "Z": [(0, 0), (0, 1), (1, 1), (1, 2)],
    "O": [(0, 0), (0, 1), (1, 0), (1, 1)],
    "S": [(0, 1), (0, 2), (1, 0), (1, 1)],
    "L": [(0, 0), (0, 1), (0, 2), (1, 0)],
    "I": [(0, 0), (0, 1), (0, 2), (0, 3)],
}
SHAPES: dict[frozenset[tuple[int, int]], str] = {}
for _name, _cells in CELLS.items():
    for _ in range(4):
        SHAPES[placed(_cells)] = _name
        _cells = [(c, -r) for r, c in _cells]
