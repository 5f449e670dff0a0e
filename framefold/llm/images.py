"""Image copies by local descriptors: cropped, turned, resized or edited copies share corners that agree in geometry.

Corners are found by the Harris response on a pyramid whose levels shrink by STEP until a patch no longer fits; their number
grows with a level's area. Each corner is turned to its intensity centroid and described by binary brightness tests.
Descriptors are posted in Hamming tables, one for each band of bits: descriptors of different images that share a band are
compared in all bits, each two in the list of the first band that they share. The matches of two images vote for similarity
transforms, each taken from two matches, and images are linked where enough corners agree on one. Pixel-identical images are
linked from the start.

A descriptor with up to LONG others within TIGHT bits in its list, and up to WHOLE close ones, is matched with all of the close
ones. The others, those of large groups, are first matched with leaders alone, which links most images of a group through few
of them. Near copies lie that tight and chance matches hardly do, so few images but those of large groups are among them. Then
their images are described again, and in long lists each descriptor is matched with SOME close ones of other classes, which
links most of what leaders have left apart. At last all pairs that are of different classes so far are compared in all lists.
More matches never undo a link, so the classes are those of all links, and no class is without a link that all pairs would
give. So matches within a class grow with its size and not with its square. Where matches meet, links that join what others of
the same bucket have joined are left out: a forest leaves it, with the same classes. Postings and matches are exchanged in
packed columns.

The input is (id, width, height, pixels), pixels being one byte of gray for each, row by row. Defined cases: an image with
a null or a wrong number of pixels, or too small or too flat for corners, has no links but to its pixel-identical copies;
a null id takes no part; rows of one id are one node, and give one row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm.common import blocks, materialize
from framefold.llm.components import connected_components
from framefold.llm.simhash import with_end

#: How much a level is smaller than the one before; corners of a level at least, and pixels that give one.
STEP, LEAST_CORNERS, PIXELS_A_CORNER = 1.25, 8, 220
#: Half the side of a described patch, the radius that turns it, angles told apart, bits of a descriptor, its bands and their bytes.
PATCH, REACH, ANGLES, BITS, BANDS, BAND_BYTES = 9, 9, 64, 128, 4, 3
#: Deviation of the blur that corners are found in, and of that on top of it that is tested.
BLUR, TEST_BLUR = 1.3, 1.5
#: Gradient below which a pixel is even, and the share of a patch that may be.
EVEN, MOST_EVEN = 0.25, 0.1
#: Bits in which matching descriptors differ at most; pixels by which a corner may miss its place, and that one place is wide; places that must agree.
MOST_BITS, NEAR, PLACE, AGREEING = 15, 4.0, 4, 4
#: By how much a match's own angle and levels may miss the transform.
MOST_TURN, MOST_LEVELS = 0.45, 1.5
#: Transforms that are tried at a time.
TRIED = 8
#: A descriptor is matched with all close ones of its list at once where up to so many differ in so few bits.
LONG, TIGHT = 16, 8
#: And where the close ones are up to so many. Lists of up to so many are compared pair by pair; in longer ones large groups are found through leaders first, until so many in a row gather few.
WHOLE, FEW = 256, 16
#: Close descriptors of other classes that one of a long list is matched with, before it is with all.
SOME = 64
#: Rows are packed about so many at a time, for so many buckets at least.
PACKED, BUCKETS = 1 << 18, 256
#: Bits of each band, as the two longs of a descriptor.
BAND_BITS = np.stack([np.where(np.arange(BITS // 8) // BAND_BYTES == k, 255, 0).astype(np.uint8).view(np.int64) for k in range(BANDS)])


def splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def test_points() -> np.ndarray:
    """(angles, bits, two points, y and x): the brightness tests, turned to each angle."""
    raw = (splitmix(BITS * 4, 1) % np.uint64(2 * PATCH - 1)).astype(np.int64).reshape(BITS, 2, 2) - (PATCH - 1)
    turn = np.arange(ANGLES) * 2 * np.pi / ANGLES
    y = raw[None, ..., 0] * np.cos(turn)[:, None, None] + raw[None, ..., 1] * np.sin(turn)[:, None, None]
    x = raw[None, ..., 1] * np.cos(turn)[:, None, None] - raw[None, ..., 0] * np.sin(turn)[:, None, None]
    return np.stack([np.rint(y), np.rint(x)], axis=-1).astype(np.int64)


TESTS = test_points()
MARGIN = max(int(np.abs(TESTS).max()), REACH) + 1
DISC = np.array([(y, x) for y in range(-REACH, REACH + 1) for x in range(-REACH, REACH + 1) if y * y + x * x <= REACH * REACH])

DISC_WEIGHTS = DISC.T.astype(np.float32)


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1; parts outside count as zero."""
    for axis in (1, 2):
        c = np.cumsum(np.pad(a, [(0, 0)] + [(r + 1, r) if k == axis else (0, 0) for k in (1, 2)]), axis=axis, dtype=np.float64)
        a = c[:, 2 * r + 1 :] - c[:, : -2 * r - 1] if axis == 1 else c[:, :, 2 * r + 1 :] - c[:, :, : -2 * r - 1]
    return a


def summed(a: np.ndarray, r: int) -> np.ndarray:
    """`box` in single precision, for small squares; what lies outside counts as zero."""
    for axis in (1, 2):
        wide = np.pad(a, [(0, 0)] + [(r, r) if k == axis else (0, 0) for k in (1, 2)])
        n = a.shape[axis]
        a = sum(wide[:, k : k + n] if axis == 1 else wide[:, :, k : k + n] for k in range(2 * r + 1))
    return a


def blurred(a: np.ndarray, deviation: float) -> np.ndarray:
    """Images under a Gauss blur; what lies outside is as the edge."""
    r = int(np.ceil(2.5 * deviation))
    weights = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * deviation**2))
    weights = (weights / weights.sum()).astype(np.float32)
    for axis in (1, 2):
        wide = np.pad(a, [(0, 0)] + [(r, r) if k == axis else (0, 0) for k in (1, 2)], mode="edge")
        n = a.shape[axis]
        a = sum(w * (wide[:, k : k + n] if axis == 1 else wide[:, :, k : k + n]) for k, w in enumerate(weights))
    return a


def shrunk(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images of a smaller size: each pixel is the mean of the area that it covers."""
    for axis, size in ((1, height), (2, width)):
        n = a.shape[axis]
        edge = np.arange(size + 1) * n / size
        whole = np.minimum(edge.astype(np.int64), n - 1)
        shape = [-1 if k == axis else 1 for k in range(3)]
        sums = np.cumsum(a, axis=axis, dtype=np.float64)
        upto = np.where((whole > 0).reshape(shape), np.take(sums, np.maximum(whole - 1, 0), axis=axis), 0) + (edge - whole).reshape(shape) * np.take(a, whole, axis=axis)
        a = (np.diff(upto, axis=axis) * size / n).astype(np.float32)
    return a


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (image, y, x, level, angle) in full-size pixels, and their descriptors, of equally large images."""
    corners, found = [np.zeros((0, 5), dtype=np.int64)], [np.zeros((0, BITS // 8), dtype=np.uint8)]
    whole = images.astype(np.float32)
    n, full_height, full_width = whole.shape
    scale = 0
    while True:
        height, width = (round(x / STEP**scale) for x in (full_height, full_width))
        if min(height, width) <= 2 * MARGIN:
            return np.concatenate(corners), np.concatenate(found)
        whole = shrunk(whole, height, width) if scale else whole
        level = blurred(whole, BLUR)
        gy, gx = np.gradient(level, axis=1), np.gradient(level, axis=2)
        a, b, c = summed(gy * gy, 2), summed(gx * gx, 2), summed(gx * gy, 2)
        response = a * b - c * c - 0.04 * (a + b) ** 2
        peak = response.copy()
        for axis in (1, 2):
            peak = np.maximum.reduce([np.roll(peak, k, axis=axis) for k in range(-2, 3)])
        # where much of a patch is even, its bits tell of the border of a frame or bar that other images share
        flat = box((gy * gy + gx * gx < EVEN**2).astype(np.float32), PATCH) > MOST_EVEN * (2 * PATCH + 1) ** 2
        inner = np.where((response >= peak) & (response > 1e2) & ~flat, response, 0)[:, MARGIN : height - MARGIN, MARGIN : width - MARGIN].reshape(n, -1)
        most = min(max(LEAST_CORNERS, inner.shape[1] // PIXELS_A_CORNER), inner.shape[1])
        best = np.argpartition(-inner, most - 1, axis=1)[:, :most]
        image, at = np.nonzero(np.take_along_axis(inner, best, axis=1) > 0)
        at = best[image, at]
        y, x = at // (width - 2 * MARGIN) + MARGIN, at % (width - 2 * MARGIN) + MARGIN
        disc = level[image[:, None], y[:, None] + DISC[:, 0], x[:, None] + DISC[:, 1]]
        angle = np.rint(np.arctan2(*(np.einsum("nd,d->n", disc, weights) for weights in DISC_WEIGHTS)) * ANGLES / (2 * np.pi)).astype(np.int64) % ANGLES
        smooth = blurred(level, TEST_BLUR)
        points = TESTS[angle]
        light = smooth[image[:, None, None], y[:, None, None] + points[..., 0], x[:, None, None] + points[..., 1]]
        found.append(np.packbits(light[..., 0] < light[..., 1], axis=1))
        places = [np.rint((z + 0.5) * size / part - 0.5).astype(np.int64) for z, size, part in ((y, full_height, height), (x, full_width, width))]
        corners.append(np.stack([image, *places, np.full(len(y), scale), angle], axis=1))
        scale += 1


def packed_corners(corners: np.ndarray) -> np.ndarray:
    return (corners[:, 1] << 34) | (corners[:, 2] << 14) | (corners[:, 3] << 8) | corners[:, 4]


POSTED = ["band", "key", "image", "corner", "low", "high"]


def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Hamming tables' rows: (band, key, image, corner, bits in two longs); a corner packs its y, x, level and angle. Of pixel-identical images a task posts one.

    A class that comes after an image's pixels follows in each of its rows.
    """
    seen: set[bytes] = set()
    for batch in batches:
        shapes: dict[tuple[int, int], list[int]] = {}
        width, height, pixels = (batch.column(k).to_pylist() for k in (1, 2, 3))
        for k, (w, h, p) in enumerate(zip(width, height, pixels, strict=True)):
            if w and h and p is not None and len(p) == w * h and (digest := xxhash.xxh3_128_digest(b"%d " % w + p)) not in seen:
                seen.add(digest)
                shapes.setdefault((h, w), []).append(k)
        ids, *more = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, *range(4, batch.num_columns)))
        for (h, w), rows in sorted(shapes.items()):
            step = max(1, (1 << 18) // (h * w))
            for at in range(0, len(rows), step):
                own = rows[at : at + step]
                corners, bits = describe(np.frombuffer(b"".join(pixels[k] for k in own), dtype=np.uint8).reshape(-1, h, w))
                of = np.array(own)[corners[:, 0]]
                image, others = ids[of], [pa.array(x[of]) for x in more]
                corner = packed_corners(corners)
                words = np.ascontiguousarray(bits).view(np.int64).reshape(-1, 2)
                for band in range(BANDS):
                    key = bits[:, BAND_BYTES * band : BAND_BYTES * (band + 1)].astype(np.int32) @ np.array([1 << 8 * k for k in range(BAND_BYTES)], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), band, dtype=np.int32)), pa.array(key.astype(np.int32)), pa.array(image), pa.array(corner), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy()), *others], [*POSTED, "class"][: 6 + len(others)])


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def first_shared(a: np.ndarray, b: np.ndarray, band: np.ndarray | int) -> np.ndarray:
    """Whether descriptors share no band before this one."""
    return np.logical_and.reduce([(band <= k) | (((a ^ b) & BAND_BITS[k]) != 0).any(axis=-1) for k in range(BANDS - 1)])


MATCHED = ["a", "b", "corner_a", "corner_b"]


def matched(rows_a: np.ndarray, rows_b: np.ndarray) -> np.ndarray:
    """(a, b, corner of a, corner of b) of (image, corner) rows, the smaller image first."""
    a, b = np.where((rows_a[:, 0] > rows_b[:, 0])[:, None], (rows_b, rows_a), (rows_a, rows_b))
    return np.stack([a[:, 0], b[:, 0], a[:, 1], b[:, 1]], axis=1)


def by_hash(rows: np.ndarray) -> np.ndarray:
    """The places of (image, corner) rows in an order of images that is the same in all lists."""
    return np.argsort(rows[:, 0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")


def led(rows: np.ndarray, bits: np.ndarray, band: int) -> list[np.ndarray]:
    """Matches of descriptors of one list with the leaders that they are close to.

    In an order of images that is the same in all lists, a descriptor close to no leader before is a leader, so lists of the same images tend to the same ones.
    """
    pairs = []
    rest = by_hash(rows)
    while len(rest):
        leader = rest[0]
        close = differing(bits, bits[leader]) <= MOST_BITS
        own = np.flatnonzero(close & (rows[:, 0] != rows[leader, 0]) & first_shared(bits, bits[leader], band))
        pairs.append(matched(rows[own], np.broadcast_to(rows[leader], (len(own), 2))))
        rest = rest[~close[rest]]
    return pairs


def grouped(rows: np.ndarray, bits: np.ndarray, most: int) -> np.ndarray:
    """Whether descriptors of one list are around a leader with over `most` within TIGHT bits, or over WHOLE close ones; not all of these are found."""
    dense, few, rest = np.zeros(len(rows), dtype=bool), 0, by_hash(rows)
    while len(rest) and few < FEW:
        away, other = differing(bits[rest], bits[rest[0]]), rows[rest, 0] != rows[rest[0], 0]
        many = [reach for reach, limit in ((TIGHT, most), (MOST_BITS, WHOLE)) if np.count_nonzero(other & (away <= reach)) > limit]
        if many:
            dense[rest[away <= many[-1]]] = True
        few, rest = 0 if many else few + 1, rest[away > MOST_BITS]
    return dense


def compared(rows: np.ndarray, bits: np.ndarray, band: int, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Matches of one list, and the images that may lack some: descriptors outside large groups are matched with all close ones, and the others with leaders."""
    low, high = np.ascontiguousarray(bits.T).view(np.uint64)
    dense, found = grouped(rows, bits, most), [np.zeros((2, 0), dtype=np.int64)]
    others, step = np.flatnonzero(~dense), max(1, (1 << 18) // len(rows))
    for begin in range(0, len(others), step):
        own = others[begin : begin + step]
        away = np.bitwise_count(low[own, None] ^ low) + np.bitwise_count(high[own, None] ^ high)
        close = (away <= MOST_BITS) & (rows[own, None, 0] != rows[:, 0])
        dense[own] = ((close & (away <= TIGHT)).sum(axis=1) > most) | (close.sum(axis=1) > WHOLE)
        i, j = np.nonzero(close & ~dense[own, None])
        found.append(np.stack([own[i], j]))
    i, j = np.concatenate(found, axis=1)
    once = ((i < j) | dense[j]) & first_shared(bits[i], bits[j], band)
    return [matched(rows[i[once]], rows[j[once]]), *led(rows[dense], bits[dense], band)], rows[dense, 0]


def close_pairs(edges: np.ndarray, of: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(2, n): places i < j of close descriptors of lists of up to WHOLE, which are of different images or classes; a list starts at each edge."""
    sizes = np.diff(edges)
    ends, place = np.repeat(edges[1:], sizes), np.flatnonzero(np.repeat(sizes <= WHOLE, sizes))
    found = [np.zeros((2, 0), dtype=np.int64)]
    for step in range(1, WHOLE):
        place = place[place + step < ends[place]]
        if not len(place):
            break
        i = place[of[place] != of[place + step]]
        i = i[differing(bits[i], bits[i + step]) <= MOST_BITS]
        found.append(np.stack([i, i + step]))
    return np.concatenate(found, axis=1)


def match(batches: Iterator[pa.RecordBatch], crowds: bool = False, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Close descriptors of different images, from lists that come sorted by (band, key, image, corner), a list being held whole.

    With `crowds` the images that may lack matches are given too, with nulls beside them.
    """
    most = LONG if most is None else most

    def close(band: np.ndarray, key: np.ndarray, image: np.ndarray, corner: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, bits = np.stack([image, corner], axis=1), np.stack([low, high], axis=1)
        edges = np.concatenate(([0], np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1, [len(band)]))
        i, j = close_pairs(edges, image, bits)
        tight = differing(bits[i], bits[j]) <= TIGHT
        dense = np.bincount(np.concatenate((i[tight], j[tight])), minlength=len(rows)) > most
        once = ~(dense[i] & dense[j]) & first_shared(bits[i], bits[j], band[i])
        pairs, crowd = [matched(rows[i[once]], rows[j[once]])], [image[dense]]
        places = np.flatnonzero(dense)
        for own in np.split(places, np.flatnonzero(np.diff(np.searchsorted(edges, places, side="right"))) + 1) if len(places) else []:
            pairs += led(rows[own], bits[own], int(band[own[0]]))
        for k in np.flatnonzero(np.diff(edges) > WHOLE).tolist():
            more, lacking = compared(rows[edges[k] : edges[k + 1]], bits[edges[k] : edges[k + 1]], int(band[edges[k]]), most)
            pairs += more
            crowd.append(lacking)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(pairs).T.copy()], MATCHED)
        if crowds:
            found = np.unique(np.concatenate(crowd))
            yield pa.RecordBatch.from_arrays([pa.array(found), *[pa.nulls(len(found), pa.int64())] * 3], MATCHED)

    held = None
    for batch in with_end(batches):
        if batch is not None:
            columns = [batch.column(k).to_numpy() for k in range(6)]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if held is None or not len(held[0]):
            continue
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        end = len(held[0]) if batch is None else int(last[-1]) + 1 if len(last) else 0
        if end:
            yield from close(*(h[:end] for h in held))
            held = [h[end:] for h in held]


def rest_of_matches(batches: Iterator[pa.RecordBatch], some: int | None = None) -> Iterator[pa.RecordBatch]:
    """All close descriptors of images of different classes, from (list, class, image, corner, low, high) sorted by list, a list being held whole.

    With `some` a descriptor of a long list is matched with up to so many behind it, of images that come first in an order that is the same in all lists.
    """

    def short(edges: np.ndarray, lists: list[np.ndarray]) -> pa.RecordBatch:
        rows, bits = (np.stack(lists[k : k + 2], axis=1) for k in (2, 4))
        i, j = close_pairs(edges, lists[1], bits)
        once = first_shared(bits[i], bits[j], lists[0][i] >> 32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in matched(rows[i[once]], rows[j[once]]).T.copy()], MATCHED)

    def long(run: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, of, n = np.unique(run[1], return_inverse=True, return_counts=True)
        order = np.lexsort((of, n[of]))  # the largest class comes last, and each is compared with those behind it
        of, band = of[order], int(run[0][0]) >> 32
        rows, bits = (np.stack([run[k][order], run[k + 1][order]], axis=1) for k in (2, 4))
        new = np.flatnonzero(of[1:] != of[:-1]) + 1
        place = np.argsort(by_hash(rows))
        found, count = [], 0
        for i in range(new[-1] if len(new) else 0):
            begin = int(new[np.searchsorted(new, i, side="right")])
            k = np.flatnonzero(differing(bits[begin:], bits[i]) <= MOST_BITS) + begin
            k = k if some is None or len(k) <= some else k[np.argpartition(place[k], some)[:some]]
            k = k[first_shared(bits[k], bits[i], band)]
            found.append(matched(np.broadcast_to(rows[i], (len(k), 2)), rows[k]))
            count += len(k)
            if count > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found).T.copy()], MATCHED)
                found, count = [], 0
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found).T.copy()], MATCHED)

    held = None
    for batch in with_end(batches):
        if batch is not None:
            columns = [batch.column(k).to_numpy() for k in range(6)]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if held is None or not len(held[0]):
            continue
        edges = np.concatenate(([0], np.flatnonzero(held[0][1:] != held[0][:-1]) + 1, [len(held[0])]))
        edges = edges if batch is None else edges[:-1]
        yield short(edges, [h[: edges[-1]] for h in held])
        for k in np.flatnonzero(np.diff(edges) > WHOLE).tolist():
            yield from long([h[edges[k] : edges[k + 1]] for h in held])
        held = [h[edges[-1] :] for h in held]


def linked(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Linked pairs (a, b) of matches in any order, a forest of them: two images that others join already aren't judged."""
    order = np.lexsort(columns[1::-1])
    a, b, corners_a, corners_b = (c[order] for c in columns)
    edges = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]))
    found, above = [], {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for k in np.flatnonzero(np.diff(edges) >= AGREEING).tolist():
        x, y = root(int(a[edges[k]])), root(int(b[edges[k]]))
        if x == y:
            continue
        c = np.unique(np.stack([corners_a[edges[k] : edges[k + 1]], corners_b[edges[k] : edges[k + 1]]]), axis=1)
        if c.shape[1] >= AGREEING and agree(c[0], c[1]):
            found.append(edges[k])
            above[x] = y
    return pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], ["a", "b"])


PACKAGES = "bucket int, n int, data binary"


def bucket_of(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(33)) % np.uint64(buckets)


def packages(parts: Iterator[tuple[np.ndarray, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, n, data) of (buckets, long columns): data is n rows, column by column and byte by byte, compressed."""
    codec, held, count = pa.Codec("zstd"), [], 0
    for part in with_end(parts):
        if part is not None:
            held.append(part)
            count += len(part[0])
        if not count or part is not None and count < PACKED:
            continue
        bucket = np.concatenate([x for x, _ in held])
        rows = np.stack([np.concatenate(x) for x in zip(*(x for _, x in held), strict=True)])
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[:, order]
        edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])).tolist()
        data = [codec.compress(np.ascontiguousarray(rows[:, x:y]).view(np.uint8).reshape(len(rows), -1, 8).transpose(0, 2, 1).tobytes(), asbytes=True) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges).astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "n", "data"])
        held, count = [], 0


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket, from packages that come sorted by bucket."""
    codec, held, of = pa.Codec("zstd"), [], None
    for batch in with_end(batches):
        for bucket, n, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if batch is not None else [(None, 0, b"")]:
            if bucket != of and held:
                yield list(np.concatenate(held, axis=1))
                held = []
            of = bucket
            if n:
                raw = np.frombuffer(codec.decompress(data, 8 * width * n, asbytes=True), dtype=np.uint8)
                held.append(np.ascontiguousarray(raw.reshape(width, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(width, n))


def agree(corners_a: np.ndarray, corners_b: np.ndarray) -> bool:
    """Whether one similarity transform, taken from two matches, sends AGREEING places of either image near their matches.

    A match's own levels and angles must fit the transform too. Corners of all levels around one place are one, so a small
    mark that images share isn't a copy. The transforms of all two matches are tried in turn until one fits, so more matches
    never undo a link.
    """
    (a, b), n = ((c >> 34) + 1j * ((c >> 14) & 0xFFFFF) for c in (corners_a, corners_b)), len(corners_a)
    place_a, place_b = (((c >> 34) // PLACE << 32) | ((c >> 14) & 0xFFFFF) // PLACE for c in (corners_a, corners_b))
    turn = np.exp(-1j * ((corners_a & 0xFF) - (corners_b & 0xFF)) * 2 * np.pi / ANGLES)
    grow = (((corners_b >> 8) & 0x3F) - ((corners_a >> 8) & 0x3F)) * np.log(STEP)
    every = np.arange(n)
    likely = dict.fromkeys(max(x, 1) for x in (n // 2, 1, n // 3, n // 5))
    for apart in (*likely, *(x for x in range(2, n // 2) if x not in likely)):
        tried = TRIED if apart in likely else max(TRIED, (1 << 18) // n)
        for begin in range(0, n, tried):
            one = every[begin : begin + tried]
            two = (one + apart) % n
            with np.errstate(all="ignore"):
                factor = (b[two] - b[one]) / (a[two] - a[one])
                use = (np.abs(a[two] - a[one]) > 2 * NEAR) & (np.abs(factor) > 0.2) & (np.abs(factor) < 5)
            factor, start = factor[use, None], one[use]
            hits = np.abs(b[start][:, None] + factor * (a[None, :] - a[start][:, None]) - b[None, :]) <= NEAR * np.maximum(1, np.abs(factor))
            hits &= np.abs(np.angle(factor * turn)) <= MOST_TURN
            hits &= np.abs(np.log(np.abs(factor)) - grow) <= MOST_LEVELS * np.log(STEP)
            for k in np.flatnonzero(hits.sum(axis=1) >= AGREEING).tolist():
                if min(len(set(place_a[hits[k]].tolist())), len(set(place_b[hits[k]].tolist()))) >= AGREEING:
                    return True
    return False


def links_of(matches: DataFrame, buckets: int, width: int, found: Callable[[Iterator[list[np.ndarray]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Links (a, b), and (image, null) of the images that come with nulls, of matches that `found` gives from the packages' buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packages(pack_matches(found(unpacked(batches, width)), buckets))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in unpacked(batches, 4):
            crowd = columns[1] == ALONE
            alone = np.unique(columns[0][crowd])
            yield pa.RecordBatch.from_arrays([pa.array(alone), pa.nulls(len(alone), pa.int64())], ["a", "b"])
            yield linked([c[~crowd] for c in columns])

    parts = blocks(matches.sparkSession)
    dealt = matches.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(send, PACKAGES)
    return materialize(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(judge, "a long, b long"), "image-links")


#: What stands for null in packed matches.
ALONE = np.iinfo(np.int64).min


def pack_matches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        columns = [c.fill_null(int(ALONE)).to_numpy() for c in batch.columns]
        yield bucket_of(columns[0], columns[1], buckets), columns


def pack_postings(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The band goes above the corner, and the key is part of the bits. Further columns follow."""
    for batch in batches:
        band, key, image, corner, *more = (c.to_numpy() for c in batch.columns)
        yield bucket_of(band, key, buckets), [image, corner | band.astype(np.int64) << 56, *more]


def posted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns of POSTED, and what follows, of packed ones."""
    image, corner, low, high, *more = columns
    band = corner >> 56
    bits = np.ascontiguousarray(np.stack([low, high], axis=1)).view(np.uint8)
    key = sum(bits[np.arange(len(band)), BAND_BYTES * band + k].astype(np.int64) << 8 * k for k in range(BAND_BYTES))
    return [band, key, image, corner & ((1 << 56) - 1), low, high, *more]


def buckets_of(spark: SparkSession) -> int:
    parts = blocks(spark)
    return parts * -(-BUCKETS // parts)


def classes_of(links: DataFrame, packed: Callable[[DataFrame | None], DataFrame], most: int | None = None) -> DataFrame:
    """(node, component) of the images that these links (a, b) and those by postings join.

    `packed` gives the packages of all images' postings, or for images (id, class) those of theirs with the class.
    """
    buckets = buckets_of(links.sparkSession)

    def first(lists: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for columns in map(posted, lists):
            order = np.lexsort(columns[3::-1])
            yield from match(iter([pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], POSTED)]), True, most)

    def rest(lists: Iterator[list[np.ndarray]], some: int | None) -> Iterator[pa.RecordBatch]:
        for columns in map(posted, lists):
            band, key, image, corner, low, high, group = columns
            order = np.lexsort((corner, image, group, named := band << 32 | key))
            yield from rest_of_matches(iter([pa.RecordBatch.from_arrays([pa.array(c[order]) for c in (named, group, image, corner, low, high)], ["list", "class", "image", "corner", "low", "high"])]), some)

    found = links_of(packed(None), buckets, 4, first)
    classes = connected_components(links.unionByName(found.where("b IS NOT NULL")))
    crowd = found.where("b IS NULL").select(F.col("a").alias("id")).distinct()
    if not crowd.limit(1).count():
        return classes
    for some in (SOME, None):
        classes = materialize(classes, "image-classes")
        placed = materialize(crowd.join(classes, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("class")), "crowd")
        more = links_of(packed(placed), buckets, 5, functools.partial(rest, some=some))
        classes = connected_components(more.unionByName(classes.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return classes


def image_copies(images: DataFrame, id_column: str = "image_id", width: str = "width", height: str = "height", pixels: str = "pixels") -> DataFrame:
    """(id, class_id): the least id among the images that links reach from the image, itself included."""
    rows = images.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h"), F.col(pixels).alias("p"))
    digest = F.when(F.length("p") == F.col("w") * F.col("h"), F.sha2(F.concat(F.col("w").cast("string").cast("binary"), F.lit(b"x"), F.col("p")), 256)).otherwise(F.concat(F.lit("id"), F.col("id")))
    digests = materialize(rows.withColumn("digest", digest).select("id", "digest"), "digests")
    leaders = digests.groupBy("digest").agg(F.min("id").alias("b"))
    equal = materialize(digests.join(leaders, "digest").where("id <> b").select(F.col("id").alias("a"), "b"), "equal")

    buckets = buckets_of(images.sparkSession)

    def packed(of: DataFrame | None) -> DataFrame:
        own = rows.select("id", "w", "h", "p") if of is None else rows.join(of, "id").select("id", "w", "h", "p", "class")
        return own.mapInArrow(lambda b: packages(pack_postings(post(b), buckets)), PACKAGES)

    classes = classes_of(equal, packed)
    return digests.select("id").distinct().join(classes, F.col("id") == F.col("node"), "left").select(F.col("id").alias(id_column), F.coalesce("component", "id").alias("class_id"))


SIDE = 96


def textures(d: int) -> np.ndarray:
    """A fixed texture of SIDE x SIDE for each component, of mean 0 and deviation 1."""
    noise = (splitmix(d * SIDE * SIDE, 7) >> np.uint64(40)).astype(np.float64).reshape(d, SIDE, SIDE)
    soft = box(noise - noise.mean(), 1)
    return (soft - soft.mean(axis=(1, 2), keepdims=True)) / soft.std(axis=(1, 2), keepdims=True)


def rendered(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(image_id, width, height, pixels): of each vector an image, 2 * id, and an edited crop of it, 2 * id + 1.

    An image is the vector's mix of fixed textures. The crop leaves out 12 pixels on each side, is darker and has a box
    put over a corner. Vectors that are null, empty, of other lengths than the first or hold null or non-finite numbers
    are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(i, v) for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
                for d in sorted({len(v) for _, v in rows}):
                    ids = np.array([i for i, v in rows if len(v) == d], dtype=np.int64)
                    v = np.array([v for _, v in rows if len(v) == d], dtype=np.float64)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    if d not in KEPT:
                        KEPT[d] = textures(d)
                    whole = np.clip(np.rint(128 + 40 * np.einsum("nd,dyx->nyx", v, KEPT[d], optimize=True)), 0, 255)
                    crop = np.rint(whole[:, 12:-12, 12:-12] * 0.8 + 20)
                    crop[:, :8, :8] = 20
                    for kind, picture in enumerate((whole, crop)):
                        side = picture.shape[1]
                        data = [x.tobytes() for x in picture.astype(np.uint8)]
                        yield pa.RecordBatch.from_arrays([pa.array(2 * ids + kind), pa.array([side] * len(ids), pa.int32()), pa.array([side] * len(ids), pa.int32()), pa.array(data, pa.binary())], ["image_id", "width", "height", "pixels"])

    return vectors.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>")).mapInArrow(run, "image_id long, width int, height int, pixels binary")


#: The textures that this process has made, by the number of components.
KEPT: dict[int, np.ndarray] = {}
