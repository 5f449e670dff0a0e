"""SimHash near-copies: a byte-position inverted index with count filtering.

A document's 64-bit fingerprint is the majority of its shingles' hash bits, taken as eight positional bytes. Two fingerprints
that differ in at most four bits differ in at most four bytes, so they share four positional bytes for certain. Equal
fingerprints are one class from the start, so copies are never paired. Positional bytes are ordered by how many distinct
fingerprints hold them, the rarest first. Of two fingerprints that share four, the seven rarest of each share three, so the
index posts each fingerprint under every three of its seven rarest bytes, and the most common byte has no list. Each pair of
a list has its shared positional bytes tallied, pairs short of the sure number are dropped, and the rest are verified by
their differing bits. Within a posting list only a spanning forest of the links is emitted, which keeps the classes whole
without all pairs. A posting list of over `DIRECT` members is cut again, on further tasks, by the nibbles of the bytes left
over; what remains in such a list differs in 16 bits at most and is looked up by flipped bits.

`keep_one` takes the classes of these links, joined with near duplicates by content, which fingerprints miss: the candidates
of those come from prefixes of the shingle sets, which leave no pair at `SIMILAR` out.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; repeated rows share a class;
an empty table gives no rows; a null id has a fingerprint and is a member, and names a class only if all its ids are
null; `near_copies` ignores columns other than the id and the text, `keep_one` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framefold.llm.common import blocks, discard, materialize, shuffles_released, slices
from framefold.llm.components import connected_components

SEED = 42
SHINGLE = 4
#: Differing bits of a link.
MOST_BITS = 4
#: Positional bytes that a posting list shares.
SHARED = 3
#: Members of a posting list that are compared directly; longer lists are cut again.
DIRECT = 4096
#: A-Z becomes a-z, and white space of the contract (tab to carriage return) becomes a space.
FOLD = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
LANES = np.uint64(0x0101010101010101)
LINK_ROWS = "a long, b long, choice int"


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text's fingerprint, unsigned: bits set in over half of the shingles' hashes; zero without words."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split(b" ") if w]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))) + np.arange(len(words))).tolist()
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes. Eight one-byte counters share a lane, for 255 hashes at a time."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(8):
        lanes = (hashes >> np.uint64(k)) & LANES
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255))
        counts[k::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp), fp being the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], [id_column, "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, fp long")


def unit_mask(choice: tuple[int, ...], width: int) -> int:
    """The bits of the chosen units as a signed long."""
    mask = sum(((1 << width) - 1) << (width * k) for k in choice)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


#: The choices of positions that posting lists share.
CHOICES = list(combinations(range(8), SHARED))


def byte_ranks(distinct: DataFrame) -> np.ndarray:
    """(position, byte): the place of each positional byte in the order of how many distinct fingerprints hold it."""
    places = F.array(*(F.lit(256 * k).cast("int") + F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(8)))
    counts = np.zeros(2048, dtype=np.int64)
    for r in distinct.select(F.explode(places).alias("place")).groupBy("place").count().collect():  # 2,048 at most
        counts[r["place"]] = r["count"]
    ranks = np.empty(2048, dtype=np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(2048)
    return ranks.reshape(8, 256)


def byte_postings(fps: np.ndarray, ranks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fp, choice, units): each fingerprint under every choice of its rarest bytes, so many that two that share 8 - bits bytes share a choice."""
    order = np.argsort(ranks[np.arange(8), fps.view(np.uint8).reshape(-1, 8)], axis=1)
    prefix = np.zeros((len(fps), 8), dtype=bool)
    np.put_along_axis(prefix, order[:, : min(8, bits + SHARED)], True, axis=1)
    found = []
    for n, choice in enumerate(CHOICES):
        own = fps[prefix[:, choice].all(axis=1)]
        found.append((own, np.full(len(own), n, dtype=np.int32), own & np.int64(unit_mask(choice, 8))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nibble_postings(fps: np.ndarray, choice: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fp, choice, units) of members of one long list: nibbles of the bytes left over that a link shares for certain, with the bytes shared already."""
    nibbles = [k for byte in range(8) if byte not in CHOICES[choice] for k in (2 * byte, 2 * byte + 1)]
    shared = unit_mask(CHOICES[choice], 8)
    keys = [fps & np.int64(shared | unit_mask(c, 4)) for c in combinations(nibbles, len(nibbles) - bits)]
    order = np.arange(len(keys), dtype=np.int32) + np.int32(1000 * (choice + 1))
    return np.tile(fps, len(keys)), np.repeat(order, len(fps)), np.concatenate(keys)


def linked(differ: np.ndarray, bits: int) -> np.ndarray:
    """By a pair's differing bits: whether the tally of shared positional bytes suffices and the bits are few."""
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (tally >= 8 - bits) & (np.bitwise_count(differ.view(np.uint64)) <= bits)


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, as positions: breadth first, each pair tallied and verified."""
    if len(fps) > DIRECT:
        return flipped_forest(fps, bits)
    rest, queue, pairs = np.arange(1, len(fps)), [0], []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        at = queue.pop()
        near = linked(fps[rest] ^ fps[at], bits)
        found = rest[near].tolist()
        pairs += [(at, k) for k in found]
        queue += found
        rest = rest[~near]
    return pairs


def flipped_forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """`forest` for a long list whose members differ in few bits: neighbours are looked up by flipped bits, so work grows with the list."""
    order = np.argsort(fps)
    ordered = fps[order]
    varying = int(np.bitwise_or.reduce((fps ^ fps[0]).view(np.uint64)))
    bits = [1 << b for b in range(64) if varying >> b & 1]
    parent = np.arange(len(fps))
    pairs: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for size in range(1, most + 1):
        for chosen in combinations(bits, size):
            want = (ordered.view(np.uint64) ^ np.uint64(sum(chosen))).view(np.int64)
            at = np.minimum(np.searchsorted(ordered, want), len(ordered) - 1)
            hit = np.flatnonzero((ordered[at] == want) & (ordered < want))
            for a, b in zip(order[hit].tolist(), order[at[hit]].tolist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[ra] = rb
                    pairs.append((a, b))
    return pairs


def link_lists(batches: Iterator[pa.RecordBatch], final: bool, bits: int = MOST_BITS) -> Iterator[pa.RecordBatch]:
    """Links within posting lists, which come as (fp, choice, units) sorted by list: (a, b, null).

    Unless `final`, members of lists of over DIRECT members go out as (fp, null, choice), to be cut again; of such a
    list no more than a batch is held.
    """

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32())], ["a", "b", "choice"])

    def members(fps: np.ndarray, choice: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(np.full(len(fps), choice, dtype=np.int32))], ["a", "b", "choice"])

    held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)]
    passing: tuple[int, int] | None = None  # the long list whose members are going out
    for batch in with_end(batches):
        if batch is not None:
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        fps, choice, units = held
        if not len(fps):
            continue
        edges = np.concatenate(([0], np.flatnonzero((choice[1:] != choice[:-1]) | (units[1:] != units[:-1])) + 1, [len(fps)]))
        begins, sizes = edges[:-1], np.diff(edges)
        key = (int(choice[-1]), int(units[-1]))
        closed = len(begins) - (batch is not None)  # the last list may go on in the next batch
        skip = int(passing == (int(choice[0]), int(units[0])))
        if skip and closed:
            yield members(fps[: sizes[0]], int(choice[0]))
        pairs = begins[skip:closed][sizes[skip:closed] == 2]
        differ = fps[pairs] ^ fps[pairs + 1]
        near = pairs[linked(differ, bits)]
        yield links(fps[near], fps[near + 1])
        ends: list[tuple[int, int]] = []
        for n in (np.flatnonzero(sizes[skip:closed] > 2) + skip).tolist():
            begin, size = int(begins[n]), int(sizes[n])
            if size > DIRECT and not final:
                yield members(fps[begin : begin + size], int(choice[begin]))
            else:
                ends += [(begin + a, begin + b) for a, b in forest(fps[begin : begin + size], bits)]
        if ends:
            at = np.array(ends)
            yield links(fps[at[:, 0]], fps[at[:, 1]])
        tail = int(edges[closed])
        if tail < len(fps) and not final and (key == passing or sizes[-1] > DIRECT):
            yield members(fps[tail:], key[0])
            passing, tail = key, len(fps)
        elif key != passing:
            passing = None
        held = [h[tail:] for h in held]


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def fingerprint_links(distinct: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """Links (a, b) among the distinct fingerprints (fp) that join the same classes as all links within so many bits, 5 at most."""
    parts = blocks(distinct.sparkSession)
    ranks = byte_ranks(distinct)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in byte_postings(fps[at : at + 4096], ranks, bits)], ["fp", "choice", "units"])

    entries = distinct.select("fp").mapInArrow(post, "fp long, choice int, units long")
    dealt = entries.repartition(parts, "choice", "units").sortWithinPartitions("choice", "units")
    found = materialize(dealt.mapInArrow(lambda b: link_lists(b, False, bits), LINK_ROWS), "links")
    long = found.where("choice IS NOT NULL").select(F.col("a").alias("fp"), "choice")

    def cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, of = (batch.column(k).to_numpy() for k in range(2))
            for choice in np.unique(of).tolist():
                members = fps[of == choice]
                for at in range(0, len(members), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in nibble_postings(members[at : at + 4096], choice, bits)], ["fp", "choice", "units"])

    links = found.where("choice IS NULL").select("a", "b")
    if not long.limit(1).count():
        return links
    again = long.mapInArrow(cut_again, "fp long, choice int, units long").repartition(parts, "choice", "units").sortWithinPartitions("choice", "units")
    return links.unionByName(again.mapInArrow(lambda b: link_lists(b, True, bits), LINK_ROWS).select("a", "b"))


def near_copies(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, fp, component): the least id that links of at most four differing bits reach from the document."""
    rows = materialize(fingerprints(docs, id_column), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min(id_column).alias("least")), "distinct")
    nodes = connected_components(fingerprint_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    named = distinct.join(nodes, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    named = materialize(named, "classes")
    least = materialize(named.groupBy("class").agg(F.min("least").alias("component")), "least")
    classes = materialize(named.join(least, "class").select("fp", "component"), "classes")
    return rows.join(classes, "fp").select(id_column, "fp", "component")


#: Near duplicates by content: shingle words, and the least similarity of two shingle sets.
CONTENT_SHINGLE, SIMILAR = 5, 0.8
#: Lists of up to so many sets give all pairs at once; so many of the most frequent shingles are told apart, and a task holds about so many while it counts.
SMALL_LIST, FREQUENT, HELD = 8, 1 << 16, 1 << 20
#: A sketch holds so many least hashes of a set, or the share of it that is more. It rules pairs out for certain; whole sets decide on the others.
SKETCH, SKETCH_SHARE = 128, 4


def words_of(text: str | None) -> list[bytes]:
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split(b" ") if w]


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The distinct five-word shingles' hashes, ascending; of fewer words, that of the whole sequence."""
    joined = b" ".join(words)
    n = max(1, len(words) - CONTENT_SHINGLE + 1)
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))) + np.arange(len(words))).tolist() or [0]
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array([xxhash.xxh32_intdigest(joined[a:b]) for a, b in zip(starts[:n], ends[min(CONTENT_SHINGLE, len(ends)) - 1 :], strict=True)], dtype=np.uint32))


def compact(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct hashes with their counts; where these are over HELD, hashes that came once are let go."""
    found, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
    if len(found) > HELD:
        found, total = found[total > 1], total[total > 1]
    return [found], [total]


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, ascending, and counts of the most frequent shingles of all rows, FREQUENT at most.

    Tasks tell what came twice and more in their rows. The counts put shingles in an order, and nothing else depends on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, pending = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for t in part.column("text").to_pylist():
                    hashes.append(shingle_set(words_of(t)))
                    counts.append(np.ones(len(hashes[-1]), dtype=np.int64))
                    pending += len(hashes[-1])
                if pending > HELD:
                    hashes, counts = compact(hashes, counts)
                    pending = 0
        (found,), (total,) = compact(hashes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(found[total > 1].astype(np.int64)), pa.array(total[total > 1])], ["hash", "n"])

    counted = docs.select("text").mapInArrow(run, "hash long, n long")
    top = counted.groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()
    found = np.array(sorted((r["hash"], r["n"]) for r in top), dtype=np.int64).reshape(-1, 2)
    return found[:, 0].astype(np.uint32), found[:, 1]


def prefix_of(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The first shingles in the order (count, hash), one of which any set at SIMILAR has among its own first; and how frequent all are."""
    hashes, counts = frequent
    level, n = np.zeros(len(shingles), dtype=np.int64), len(shingles)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        level = np.where(hashes[at] == shingles, counts[at], 0)
    return shingles[np.argsort(level, kind="stable")[: n - (4 * n + 4) // 5 + 1]], int(1000 * np.log2(1 + level).mean())


def parity_of(shingles: np.ndarray) -> list[int]:
    """128 bits, as two longs: whether a bucket's shingles are odd in number. Two sets differ in at least as many shingles as bits."""
    return np.packbits((np.bincount(shingles & np.uint32(127), minlength=128) & 1).astype(np.uint8)).view(np.int64).tolist()


def content(text: str | None, frequent: tuple[np.ndarray, np.ndarray]) -> tuple:
    """A digest of the shingle set, its size, frequency, parities, least hash, least hashes, and prefix."""
    shingles = shingle_set(words_of(text))
    prefix, common = prefix_of(shingles, frequent)
    digest = int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), dtype=np.uint64).view(np.int64))
    return digest, len(shingles), common, *parity_of(shingles), int(shingles[0]), shingles[: max(SKETCH, len(shingles) // SKETCH_SHARE)].tobytes(), prefix.tobytes()


def prefix_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, size, common, mark, left) of each shingle in the prefixes of (node, size, common, mark, prefix); left is how many of the set's shingles it and those after it are."""
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        prefixes = batch.column(4).to_pylist()
        times = [len(x) // 4 for x in prefixes]
        keys = pa.array(np.frombuffer(b"".join(prefixes), dtype=np.int32))
        columns = [np.repeat(batch.column(k).to_numpy(), times) for k in range(4)]
        place = np.arange(len(keys)) - np.repeat(np.cumsum(times) - times, times)
        yield pa.RecordBatch.from_arrays([keys, *(pa.array(c) for c in columns), pa.array(columns[1] - place)], ["key", "node", "size", "common", "mark", "left"])


def may_be_similar(size_a: np.ndarray, size_b: np.ndarray, left_a: np.ndarray, left_b: np.ndarray) -> np.ndarray:
    """Whether two sets can be at SIMILAR if the list's shingle is the first that they share: they share no more than what is left of either."""
    return 9 * np.minimum(left_a, left_b) >= 4 * (size_a + size_b)


def first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, null) within the lists of postings, which come sorted by (key, mark, node), and members (node, null, list) of long lists.

    Short lists give all pairs. Of a long list each member is paired with its most frequent one and the one before; `rest_of_pairs`
    looks at what these leave open. A list is named by its members, so equal lists are one. A list's members are held together, 28 bytes each.
    """

    def close(key: np.ndarray, node: np.ndarray, size: np.ndarray, common: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(key)))
        of = np.cumsum(new) - 1
        short = sizes <= SMALL_LIST
        place, ends = np.arange(len(key)), (begins + sizes)[of]
        pairs = [np.stack([i, i + d]) for d in range(1, SMALL_LIST) for i in [np.flatnonzero(short[of] & (place + d < ends))]]
        long = np.flatnonzero(~short[of])
        if len(long):
            best = np.lexsort((-common, of))[begins]  # the most frequent member of each list
            pairs += [np.stack([best[of[long]], long]), np.stack([long[~new[long]] - 1, long[~new[long]]])]
        i, j = np.concatenate(pairs, axis=1)
        good = may_be_similar(size[i], size[j], left[i], left[j]) & (node[i] != node[j])
        a, b = np.minimum(node[i], node[j])[good], np.maximum(node[i], node[j])[good]
        a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
        named = np.add.reduceat(node.view(np.uint64) * (node.view(np.uint64) | np.uint64(1)), begins).view(np.int64)[of[long]]
        none = np.zeros(len(a), dtype=np.int64), np.zeros(len(long), dtype=np.int64)
        is_pair = np.arange(len(a) + len(long)) < len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, node[long]])), pa.array(np.concatenate([b, none[1]]), mask=~is_pair), pa.array(np.concatenate([none[0], named]), mask=is_pair), pa.array(np.concatenate([none[0], left[long]]))], ["a", "b", "list", "left"])

    held = None
    for batch in with_end(batches):
        if batch is not None:
            columns = [batch.column(k).to_numpy() for k in range(5)]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if held is None or not len(held[0]):
            continue
        end = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
        if end:
            yield close(*(h[:end] for h in held))
            held = [h[end:] for h in held]


def rest_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (a, b) of a list that are of different classes and can be at SIMILAR by size, by what is left, and by parity.

    Members come as (list, node, class, size, left, parity0, parity1), sorted by list and size, and are held list by list.
    """

    def close(run: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, node, group, size, left, *parity = run
        if (group == group[0]).all():
            return
        bits = np.stack(parity, axis=1).view(np.uint64)
        upto = np.searchsorted(size, 5 * size // 4, side="right").tolist()
        found, count = [], 0
        for i, end in enumerate(upto):
            differ = np.bitwise_count(bits[i + 1 : end] ^ bits[i]).sum(axis=1, dtype=np.int64)
            k = np.flatnonzero((group[i + 1 : end] != group[i]) & (9 * differ <= size[i + 1 : end] + size[i]) & may_be_similar(size[i + 1 : end], size[i], left[i + 1 : end], left[i])) + i + 1
            found.append(np.stack([np.full(len(k), node[i]), node[k]]))
            count += len(k)
            if count > 1 << 16 or i == len(upto) - 1:
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                found, count = [], 0

    held = None
    for batch in with_end(batches):
        if batch is not None:
            columns = [batch.column(k).to_numpy() for k in range(7)]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if held is None or not len(held[0]):
            continue
        edges = np.concatenate(([0], np.flatnonzero(held[0][1:] != held[0][:-1]) + 1, [len(held[0])])).tolist()
        last = len(edges) - 1 if batch is None else len(edges) - 2
        for begin, end in zip(edges[:last], edges[1 : last + 1], strict=True):
            yield from close([h[begin:end] for h in held])
        held = [h[edges[last] :] for h in held]


def similarity(a: bytes, b: bytes) -> float:
    """The shared part of the union of two sets of hashes."""
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def sketched(a: bytes, b: bytes, size_a: int, size_b: int) -> bool | None:
    """Whether two sets of these sizes are alike, by their least hashes; None where these can't tell for certain.

    Up to the greatest hash that both sketches reach, all differences are known; sets at SIMILAR differ in a ninth of their sizes' sum at most.
    """
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    if len(x) == size_a and len(y) == size_b:
        return similarity(a, b) >= SIMILAR
    reach = min(int(s[-1]) for s, n in ((x, size_a), (y, size_b)) if len(s) < n)
    x, y = x[: np.searchsorted(x, reach, side="right")], y[: np.searchsorted(y, reach, side="right")]
    differ = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
    return False if 9 * differ > size_a + size_b else None


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_column: str) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are at least SIMILAR, written: sketches rule out what they can, and whole sets decide."""
    sketch_a, sketch_b = (nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("size").alias(f"size_{x}")) for x in ("a", "b"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sketched(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["a", "b", "sure"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = [words_of(t) for t in part.column("text").to_pylist()]
                found = [shingle_set(w).tobytes() for w in words]
                ids = np.array([xxhash.xxh3_64_intdigest(x) for x in found], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found, pa.binary())], ["node", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(x.as_py(), y.as_py()) >= SIMILAR for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.filter(pa.array(found, pa.bool_())).select(["a", "b"])

    judged = pairs.join(sketch_a, "a").join(sketch_b, "b").select("a", "b", "sketch_a", "sketch_b", "size_a", "size_b").mapInArrow(judge, "a long, b long, sure boolean")
    judged = materialize(judged.where("sure IS NULL OR sure"), "judged")
    unsure = judged.where("sure IS NULL").select("a", "b")
    asked = unsure.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    owners = nodes.join(asked, "node", "left_semi").select(F.col("least").alias(id_column))
    texts = docs.select(id_column, "text").join(owners, id_column, "left_semi")
    whole = materialize(texts.mapInArrow(sets, "node long, hashes binary").join(asked, "node", "left_semi").dropDuplicates(["node"]), "sets")
    of_a, of_b = (whole.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in ("a", "b"))
    exact = unsure.join(of_a, "a").join(of_b, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(compare, "a long, b long")
    links = materialize(judged.where("sure").select("a", "b").unionByName(exact), "likes")
    discard(judged, whole)
    return links


def near_duplicates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, component): classes of documents whose five-word shingle sets are at least SIMILAR alike.

    Documents of equal shingle sets are one node. Two sets at SIMILAR share a shingle among the first fifth of each in any
    common order, here that of frequency; each such shingle has a list of the nodes that hold it there. Pairs in a list that can
    be at SIMILAR if that shingle is the first they share are compared, or are of one class already, so no pair at SIMILAR is left out. Documents without words are one class; rows
    without an id take no part.
    """
    docs = docs.where(F.col(id_column).isNotNull())
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))
    longs = ("node", "size", "common", "parity0", "parity1", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = list(zip(*(content(t, frequent.value) for t in part.column("text").to_pylist()), strict=True))
                kinds = [*(pa.int64() for _ in longs), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], [id_column, *longs, "sketch", "prefix"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, {', '.join(f'{c} long' for c in longs)}, sketch binary, prefix binary")
    rows = materialize(rows, "contents")
    parts = blocks(docs.sparkSession)
    nodes = materialize(rows.groupBy("node").agg(F.min(id_column).alias("least"), *(F.min(c).alias(c) for c in (*longs[1:], "sketch", "prefix"))), "nodes")
    members = materialize(rows.select(id_column, "node"), "members")
    discard(rows)  # sketches and prefixes, which nodes have
    postings = nodes.where("size >= 4").select("node", "size", "common", "mark", "prefix").mapInArrow(prefix_postings, "key int, node long, size long, common long, mark long, left long")
    postings = postings.repartition(parts, "key").sortWithinPartitions("key", "mark", "node").select("key", "node", "size", "common", "left")
    found = materialize(postings.mapInArrow(first_pairs, "a long, b long, list long, left long"), "first")
    pairs = materialize(found.where("list IS NULL").select("a", "b").distinct(), "pairs")
    links = alike(pairs, nodes, docs, id_column)
    classes = connected_components(links).select("node", F.col("component").alias("class"))
    # lists of equal members are one; the most that is left in any of them rules nothing out that one of them keeps
    lists = found.where("list IS NOT NULL").groupBy("list", F.col("a").alias("node")).agg(F.max("left").alias("left"))
    if lists.limit(1).count():
        placed = lists.join(nodes.select("node", "size", "parity0", "parity1"), "node").join(classes, "node", "left")
        placed = placed.select("list", "node", F.coalesce("class", "node").alias("class"), "size", "left", "parity0", "parity1")
        rest = placed.repartition(parts, "list").sortWithinPartitions("list", "size", "node").mapInArrow(rest_of_pairs, "a long, b long").distinct()
        rest = materialize(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
        more = alike(rest, nodes, docs, id_column)
        classes = connected_components(more.unionByName(classes.select(F.col("node").alias("a"), F.col("class").alias("b")))).select("node", F.col("component").alias("class"))
    named = materialize(nodes.select("node", "least").join(classes, "node", "left").select("node", "least", F.coalesce("class", "node").alias("class")), "classes")
    least = materialize(named.groupBy("class").agg(F.min("least").alias("component")), "least")
    of_node = materialize(named.join(least, "class").select("node", "component"), "components")
    out = materialize(members.join(of_node, "node").select(id_column, "component"), "near-duplicates")
    discard(nodes, members, found, pairs, links)
    return out


def joint_classes(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, component): the least id that links by fingerprint, as in `near_copies`, and by content, as in `near_duplicates`, reach; rows without an id take no part."""
    docs = docs.where(F.col(id_column).isNotNull())
    member = F.col(id_column).alias("a"), F.col("component").alias("b")
    with shuffles_released(docs.sparkSession):
        links = near_copies(docs, id_column).select(*member).unionByName(near_duplicates(docs, id_column).select(*member))
        classes = connected_components(links)
    ids = docs.select(id_column).distinct()
    return ids.join(classes, F.col(id_column) == F.col("node"), "left").select(id_column, F.coalesce("component", id_column).alias("component"))


def keep_one(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of docs, unchanged, that lead their class of near copies by fingerprint and content: one row for each, that with its least id.

    Of several rows with a class's least id, one stays. Rows without an id can't be told apart and all stay.
    """
    named = docs.where(F.col(id_column).isNotNull())
    leaders = joint_classes(named, id_column).where(F.col(id_column) == F.col("component")).select(id_column)
    order = Window.partitionBy(id_column).orderBy(F.xxhash64(*docs.columns))
    first = named.join(leaders, id_column, "left_semi").withColumn("__framefold_rank", F.row_number().over(order)).where("__framefold_rank = 1")
    return docs.where(F.col(id_column).isNull()).unionByName(first.drop("__framefold_rank").select(docs.columns))
