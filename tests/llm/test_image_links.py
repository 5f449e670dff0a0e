"""Links of image copies that a list's leaders left out: every close pair of descriptors counts, however long its list is."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from framefold.llm import images


def postings(described):
    """Rows of POSTED for (image, corner, bits as 16 bytes)."""
    out = []
    for image, corner, bits in described:
        low, high = np.frombuffer(bits, dtype=np.int64).tolist()
        for band in range(images.BANDS):
            out.append((band, int.from_bytes(bits[images.BAND_BYTES * band : images.BAND_BYTES * (band + 1)], "little"), image, corner, low, high))
    return out


def packed(y, x):
    return int(images.packed_corners(np.array([[0, y, x, 0, 0]]))[0])


def noisy(rng, bits, most):
    """The descriptor with up to so many bits of its unposted end, and at times one of its first band, flipped."""
    out = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))
    end = 8 * images.BANDS * images.BAND_BYTES
    out[rng.choice(np.arange(end, 128), rng.integers(0, most + 1), replace=False)] ^= 1
    out[rng.integers(0, 24)] ^= rng.integers(0, 2, dtype=np.uint8)
    return np.packbits(out).tobytes()


def plain_matches(described):
    """Matches of all two descriptors, by pair of images."""
    found = {}
    for (i, c, x), (j, d, y) in combinations(sorted(described), 2):
        bands = any(x[3 * k : 3 * k + 3] == y[3 * k : 3 * k + 3] for k in range(images.BANDS))
        away = (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
        if i != j and bands and away <= images.MOST_BITS:
            found.setdefault((i, j), set()).add((c, d))
    return found


def plain_classes(described):
    root = {i: i for i, _, _ in described}
    for (i, j), pairs in plain_matches(described).items():
        corners = np.array(sorted(pairs))
        if root[i] != root[j] and len(pairs) >= images.AGREEING and images.agree(corners[:, 0], corners[:, 1]):
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    return root


def shared_marks():
    """Images 900 and 901 share six corners; each of these, and no other, is in nine images that come first."""
    rng = np.random.default_rng(21)
    places = [(20, 20), (20, 70), (70, 25), (60, 60), (40, 45), (75, 75)]
    described = []
    for k, (y, x) in enumerate(places):
        bits = rng.bytes(16)
        described += [(10 * k + n, packed(y + n, x), noisy(rng, bits, 0)) for n in range(9)]
        described += [(900, packed(y, x), bits), (901, packed(y + 5, x + 3), bits)]
    return described


def crowded():
    """Groups of images that share some corners of their group, beside images that share marks of several groups."""
    rng = np.random.default_rng(22)
    described = []
    marks = [[(int(y), int(x), rng.bytes(16)) for y, x in rng.integers(12, 200, (14, 2))] for _ in range(4)]
    for image in range(70):
        of = marks[image % 4] if image < 60 else [m[rng.integers(14)] for m in marks]
        for k in rng.choice(len(of), min(len(of), int(rng.integers(4, 9))), replace=False):
            y, x, bits = of[k]
            described.append((image * 7 % 71, packed(y + image % 3, x), noisy(rng, bits, 4)))
    return described


@pytest.mark.parametrize("make", [shared_marks, crowded])
def test_long_lists_lose_no_class(spark, make):
    described = make()
    want = plain_classes(described)
    rows = spark.createDataFrame(postings(described), "band int, key int, image long, corner long, low long, high long")
    buckets = images.buckets_of(spark)

    def packed(of):
        own = rows.repartition(5) if of is None else rows.join(of, rows["image"] == of["id"]).select(*images.POSTED, "class")
        return own.mapInArrow(lambda b: images.packages(images.pack_postings(b, buckets)), images.PACKAGES)

    found = images.classes_of(spark.createDataFrame([], "a long, b long"), packed, most=6)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert make is not shared_marks or want[901] == 900


@pytest.mark.parametrize("step", [1, 7, 10000])
def test_lists_give_every_match_between_classes(step):
    """Short lists give all matches, and leaders and the rest all between classes, each once and whatever the batches are."""
    described = shared_marks() + [(i + 2000, c, x) for i, c, x in crowded()]
    want = {(*p, *m) for p, pairs in plain_matches(described).items() for m in pairs}
    rows = sorted(postings(described))
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k < 2 else pa.int64()) for k in range(6)], images.POSTED)
    out = [r for b in images.match((batch.slice(k, step) for k in range(0, len(rows), step)), True, 6) for r in b.to_pylist()]
    first = [tuple(r.values()) for r in out if r["b"] is not None]
    assert len(first) == len(set(first)) and set(first) < want
    crowd = {r["a"] for r in out if r["b"] is None}
    group = lambda image: image % 5
    again = sorted((band << 32 | key, group(image), image, *more) for band, key, image, *more in rows if image in crowd)
    members = pa.table([pa.array(x) for x in zip(*again, strict=True)], ["list", "class", "image", "corner", "low", "high"])
    rest = [tuple(r.values()) for b in images.rest_of_matches(iter(members.to_batches(max_chunksize=step))) for r in b.to_pylist()]
    assert len(rest) == len(set(rest))
    # images of which some match is left out are compared anew, in all lists
    assert {m for m in want if m[0] in crowd and m[1] in crowd and group(m[0]) != group(m[1])} == set(rest)
    assert crowd and all(m in first or m[0] in crowd and m[1] in crowd for m in want)


def test_rows_of_one_id_are_one_node(spark):
    flat = [bytes([k]) * (40 * 40) for k in range(3)]
    rows = [(5, 40, 40, flat[0]), (3, 40, 40, flat[0]), (5, 40, 40, flat[1]), (9, 40, 40, flat[1]), (8, 40, 40, flat[2])]
    frame = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")
    assert sorted(map(tuple, images.image_copies(frame).collect())) == [(3, 3), (5, 3), (8, 8), (9, 3)]


@pytest.mark.parametrize("step", [1, 7, 10000])
def test_longer_lists_give_every_match_between_classes(monkeypatch, step):
    monkeypatch.setattr(images, "WHOLE", 8)
    test_lists_give_every_match_between_classes(step)


@pytest.mark.parametrize("whole", [20, 256])
def test_matches_and_links_grow_with_a_group(monkeypatch, whole):
    """Of one group of near copies, matches don't grow with the square of its images, and links are a forest that joins them all."""
    monkeypatch.setattr(images, "WHOLE", whole)
    rng = np.random.default_rng(23)
    marks = [(int(y), int(x), rng.bytes(16)) for y, x in rng.integers(12, 200, (8, 2))]
    counts = []
    for n in (80, 160):
        described = [(image, packed(y + image % 3, x), noisy(rng, bits, 4)) for image in range(n) for y, x, bits in marks]
        rows = sorted(postings(described))
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k < 2 else pa.int64()) for k in range(6)], images.POSTED)
        found = pa.Table.from_batches(images.match(iter([batch])))
        links = images.linked([c.to_numpy() for c in found.columns]).to_pylist()
        counts.append(found.num_rows)
        root = list(range(n))
        for link in links:
            low, high = sorted((root[link["a"]], root[link["b"]]))
            root = [low if r == high else r for r in root]
        assert root == [0] * n and len(links) == n - 1
    assert counts[1] <= 2.5 * counts[0]


def test_some_matches_between_classes_are_few(monkeypatch):
    """In a long list of a group in single classes, a descriptor leads to so many, and what they link is whole."""
    monkeypatch.setattr(images, "WHOLE", 8)
    rng = np.random.default_rng(24)
    marks = [(int(y), int(x), rng.bytes(16)) for y, x in rng.integers(12, 200, (8, 2))]
    described = [(image, packed(y, x), noisy(rng, bits, 0)) for image in range(60) for y, x, bits in marks]
    rows = sorted((band << 32 | key, image, image, *more) for band, key, image, *more in postings(described))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["list", "class", "image", "corner", "low", "high"])
    every, some = ([pa.Table.from_batches(images.rest_of_matches(iter([batch]), n))] for n in (None, 5))
    every, some = ({tuple(r.values()) for t in ts for r in t.to_pylist()} for ts in (every, some))
    assert some < every and len(some) <= 5 * len(rows) < len(every)
    root = list(range(60))
    for link in images.linked([np.array(x) for x in zip(*some, strict=True)]).to_pylist():
        root = [min(root[link["a"]], root[link["b"]]) if r in (root[link["a"]], root[link["b"]]) else r for r in root]
    assert root == [0] * 60
