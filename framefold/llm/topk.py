"""Exact top-k by inner product: a Voronoi join between queries and data.

Pivots split the space into cells. Data are dealt by cell and distance to its pivot and become packed blocks of one cell
each, with a summary: the greatest distance and the greatest angle to the pivot. Queries are dealt the same way into groups
of near ones, and a bounded set of data vectors gives each query a score that its k-th best reaches at least. For query q,
pivot c and a block of radius r and angle a, no score is over q.c + |q| r, nor over |q| n cos(angle(q, c) - a) where n is
the cell's greatest length. From these a group derives, for each cell, the least radius and the least angle of a block that
can hold better; only such blocks are sent to the group. Groups solve their share of the data locally, best bounds first,
and give up blocks whose bound has fallen behind; the shares' best k are then merged. Bounds rule out much where vectors
gather, and nothing where they point everywhere evenly in many dimensions: there every group gets all data, in blocks.

Components become floor(scale * x), and scores are exact integers as long as they fit a long. Defined cases: a null
vector, or one with a null or non-finite component, is neither a query nor a candidate, nor is a row with a null id;
shorter vectors are padded with zeros to the longest one's length; components are held within 2^62; equal scores go to
the smaller id; a row never finds its own id; rows of one id are candidates each; without candidates there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framefold.llm.common import blocks, materialize

K, SCALE = 20, 64
#: Bounds on what is gathered: pivots (the root of the number of vectors, between these), and data vectors for the queries' first bounds.
PIVOTS, SAMPLE = (64, 1024), 4096
#: Vectors in a data block, queries in a group, and data blocks in a share.
BLOCK, GROUP, SHARE = 2048, 2048, 16
HELD = 2.0**62


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, v): packed longs of the rows that take part, v's components being floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                values = np.asarray(v, dtype=np.float64)
                if np.isfinite(values).all():
                    ids.append(i)
                    packed.append(np.clip(np.floor(values * scale), -HELD, HELD).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["id", "v"])

    return rows.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>")).mapInArrow(run, "id long, v binary")


def unpack(packed: list[bytes], d: int) -> np.ndarray:
    """Vectors of d components each; shorter ones are padded."""
    return np.frombuffer(b"".join(x.ljust(8 * d, b"\0") for x in packed), dtype=np.int64).reshape(-1, d)


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as longs; in doubles where these are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if most < 2**53 else q @ x.T


def best_first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k best, by falling score and then by rising id; ids rise, and ~ turns the order without overflow."""
    if scores.shape[1] > 4 * k:
        low = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        width = int((scores >= low[:, None]).sum(axis=1).max())
        near = np.argsort(np.where(scores >= low[:, None], 0, 1), axis=1, kind="stable")[:, :width]
        inner = np.argsort(~np.take_along_axis(scores, near, axis=1), axis=1, kind="stable")[:, :k]
        return np.take_along_axis(near, inner, axis=1)
    return np.argsort(~scores, axis=1, kind="stable")[:, :k]


class Best:
    """The best k so far of some queries."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, k), np.iinfo(np.int64).min), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """ids: of the columns, or of each score."""
        ids = np.broadcast_to(ids, scores.shape)
        every, names = np.concatenate([self.scores, scores], axis=1), np.concatenate([self.ids, ids], axis=1)
        order = np.lexsort((names, ~every), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(every, order, axis=1), np.take_along_axis(names, order, axis=1)


class Pivots:
    """Pivots in an order in which neighbours are near, and where vectors lie by them."""

    def __init__(self, vectors: np.ndarray, most: int):
        every = np.unique(vectors, axis=0)
        rest = every[np.linspace(0, len(every) - 1, min(most, len(every))).astype(int)].astype(np.float64)
        chain = [0]
        far = ((rest - rest[0]) ** 2).sum(axis=1)
        left = np.ones(len(rest), dtype=bool)
        left[0] = False
        while left.any():
            chain.append(int(np.flatnonzero(left)[far[left].argmin()]))
            left[chain[-1]] = False
            far = ((rest - rest[chain[-1]]) ** 2).sum(axis=1)
        self.at = rest[chain]
        self.lengths = np.linalg.norm(self.at, axis=1)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest pivot, and the distance and the angle to it, both rounded up."""
        v = vectors.astype(np.float64)
        far = np.maximum((self.at**2).sum(axis=1) - 2 * (v @ self.at.T) + (v**2).sum(axis=1)[:, None], 0)
        near = far.argmin(axis=1)
        distance = np.linalg.norm(v - self.at[near], axis=1) * (1 + 1e-9) + 1e-3
        return near, distance, np.minimum(self.angles(v, near) + 1e-6, np.pi)

    def angles(self, v: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Angles to the pivots of these cells; the greatest for vectors without a direction."""
        lengths = np.linalg.norm(v, axis=1) * self.lengths[cells]
        cosine = np.einsum("nd,nd->n", v, self.at[cells]) / np.maximum(lengths, 1e-300)
        return np.where(lengths > 0, np.arccos(np.clip(cosine, -1, 1)), np.pi)

    def most(self, queries: np.ndarray, cell: int, radius: float, angle: float, longest: float) -> np.ndarray:
        """A score that no vector of a block with this summary is over, for each query."""
        q = queries.astype(np.float64)
        lengths = np.linalg.norm(q, axis=1)
        own = self.angles(q, np.full(len(q), cell)) if self.lengths[cell] > 0 else np.zeros(len(q))
        bound = np.minimum(q @ self.at[cell] + lengths * radius, lengths * longest * np.cos(np.maximum(own - angle, 0)))
        return bound + 1e-6 * (np.abs(bound) + lengths * longest) + 1

    def needed(self, queries: np.ndarray, least: np.ndarray, cell: int, longest: float) -> tuple[float, float]:
        """The least radius and angle of a block of the cell that can hold a score that some query needs."""
        q, low = queries.astype(np.float64), least.astype(np.float64)
        lengths = np.linalg.norm(q, axis=1)
        lengths = np.linalg.norm(q, axis=1)
        slack = 1e-6 * np.abs(low) + 1
        radius = (low - slack - q @ self.at[cell]) / np.maximum(lengths, 1e-300)
        reach = (low - slack) / np.maximum(lengths * longest, 1e-300)
        own = self.angles(q, np.full(len(q), cell)) if self.lengths[cell] > 0 else np.zeros(len(q))
        angle = np.where(reach > 1, np.inf, own - np.arccos(np.clip(reach, -1, 1)) - 1e-6)
        # a query without a length scores 0 everywhere
        radius, angle = (np.where(lengths > 0, x, np.where(low <= 0, -np.inf, np.inf)) for x in (radius, angle))
        return float(radius.min()), float(angle.min())


PLACED = "id long, v binary, cell int, far double, angle double, length double"


class Join:
    """Packed blocks of data, groups of queries, and the blocks that are sent to each group."""

    def __init__(self, rows: DataFrame, queries: DataFrame, k: int, scale: int, id_column: str, vector_column: str, block: int, group: int):
        spark = rows.sparkSession
        data = materialize(integer_vectors(rows, id_column, vector_column, scale), "vectors")
        asked = integer_vectors(queries, id_column, vector_column, scale)
        size = data.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("bytes")).first()
        longest_query = asked.agg(F.max(F.length("v")).alias("bytes")).first()["bytes"] or 0
        self.n, self.d = size["n"], max(size["bytes"] or 0, longest_query, 8) // 8
        if not self.n:
            return
        d = self.d
        sample = data.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toArrow().sort_by("id")
        sample_ids, sample_vectors = sample.column("id").to_numpy(), unpack(sample.column("v").to_pylist(), d)
        pivots = Pivots(sample_vectors, min(max(math.isqrt(self.n), PIVOTS[0]), PIVOTS[1]))
        self.shared = shared = spark.sparkContext.broadcast((sample_ids, sample_vectors, pivots))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, _, pivots = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    vectors = unpack(part.column("v").to_pylist(), d)
                    cell, far, angle = pivots.cells(vectors)
                    length = np.linalg.norm(vectors.astype(np.float64), axis=1) * (1 + 1e-9)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), *(pa.array(x) for x in (far, angle, length))], ["id", "v", "cell", "far", "angle", "length"])

        placed = materialize(data.mapInArrow(place, PLACED), "placed")
        order = ("cell", "far", "id")
        dealt = placed.repartitionByRange(max(1, min(blocks(spark), -(-self.n // block))), *order).sortWithinPartitions(*order)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks of one cell, their rows by id."""
            for part in runs_of(batches, "cell", block):
                part = part.sort_by([("id", "ascending")])
                summary = [part.column("cell")[0].as_py(), pc.max(part.column("far")).as_py(), pc.max(part.column("angle")).as_py(), pc.max(part.column("length")).as_py()]
                vectors = unpack(part.column("v").to_pylist(), d)
                yield pa.RecordBatch.from_arrays([*(pa.array([x], kind) for x, kind in zip(summary, (pa.int32(), *[pa.float64()] * 3), strict=True)), pa.array([part.column("id").to_numpy().tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], ["cell", "radius", "angle", "length", "ids", "vectors"])

        packed = materialize(dealt.mapInArrow(pack, "cell int, radius double, angle double, length double, ids binary, vectors binary"), "blocks")
        #: Of each block: cell, radius, angle, length, ids, vectors and share.
        self.packed = packed.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(max(1, -(-packed.count() // SHARE)))).cast("int"))
        longest = {r["cell"]: r["length"] for r in packed.groupBy("cell").agg(F.max("length").alias("length")).collect()}  # one for each pivot at most
        placed_queries = materialize(asked.mapInArrow(place, PLACED), "placed-queries")
        groups_of = max(1, -(-placed_queries.count() // group))
        near = placed_queries.repartitionByRange(max(1, min(blocks(spark), groups_of)), *order).sortWithinPartitions(*order)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Groups of queries of one cell or of neighbours: ids, vectors, and each one's least k-th score."""
            sample_ids, sample_vectors, _ = shared.value
            for n, part in enumerate(runs_of(batches, None, group)):
                ids, vectors = part.column("id").to_numpy(), unpack(part.column("v").to_pylist(), d)
                least = np.full(len(ids), np.iinfo(np.int64).min)
                if len(sample_ids) >= k:
                    for at in range(0, len(ids), 256):
                        found = scores_of(vectors[at : at + 256], sample_vectors)
                        found[ids[at : at + 256][:, None] == sample_ids[None, :]] = np.iinfo(np.int64).min
                        least[at : at + 256] = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k]
                yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + n]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, least))], ["group", "ids", "vectors", "least"])

        self.groups = materialize(near.mapInArrow(gather, "group long, ids binary, vectors binary, least binary"), "groups")

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(group, cell, least radius, least angle) of the blocks that can matter to a group."""
            _, _, pivots = shared.value
            for batch in batches:
                for group_, packed_queries, low in zip(*(batch.column(c).to_pylist() for c in ("group", "vectors", "least")), strict=True):
                    vectors, least = unpack_all(packed_queries, d), np.frombuffer(low, dtype=np.int64)
                    found = [(c, *pivots.needed(vectors, least, c, n)) for c, n in sorted(longest.items())]
                    kept = [x for x in found if np.isfinite(x[1:]).all() or min(x[1:]) == -np.inf]
                    yield pa.RecordBatch.from_arrays([pa.array([group_] * len(kept), pa.int64()), pa.array([x[0] for x in kept], pa.int32()), *(pa.array([x[i] for x in kept], pa.float64()) for i in (1, 2))], ["group", "cell", "least_radius", "least_angle"])

        bounds = materialize(self.groups.select("group", "vectors", "least").mapInArrow(bound, "group long, cell int, least_radius double, least_angle double"), "bounds")
        #: The blocks that each group gets.
        self.sent = self.packed.join(bounds, "cell").where("radius >= least_radius AND angle >= least_angle")


def unpack_all(packed: bytes, d: int) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.int64).reshape(-1, d)


def runs_of(batches: Iterator[pa.RecordBatch], column: str | None, most: int) -> Iterator[pa.Table]:
    """Cut sorted rows into tables of so many rows at most, and of one value of the column."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        values = held.column(column).to_numpy() if column else np.zeros(held.num_rows)
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), held.num_rows]
        begin = 0
        for end in edges[1:]:
            while end - begin > most or (end < held.num_rows and end > begin):
                size = min(most, end - begin)
                yield held.slice(begin, size).combine_chunks()
                begin += size
        held = held.slice(begin)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but its own, all rows if there are fewer."""
    join = Join(rows, queries, k, scale, id_column, vector_column, block, group)
    if not join.n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d, shared = join.d, join.shared
    sent = join.sent.select(F.col("group").alias("to"), F.col("share").alias("of"), "cell", "radius", "angle", "length", "ids", "vectors")
    places = join.sent.select("group", "share").distinct().join(join.groups, "group")

    def solve(own: pa.Table, data: pa.Table) -> pa.Table:
        """The group's best k in a share of the data, blocks with the best bounds first."""
        if not own.num_rows or not data.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        _, _, pivots = shared.value
        ids = np.frombuffer(own.column("ids")[0].as_py(), dtype=np.int64)
        vectors, least = unpack_all(own.column("vectors")[0].as_py(), d), np.frombuffer(own.column("least")[0].as_py(), dtype=np.int64)
        best = Best(len(ids), k)
        bounds = [pivots.most(vectors, *summary) for summary in zip(*(data.column(c).to_pylist() for c in ("cell", "radius", "angle", "length")), strict=True)]
        for b in sorted(range(data.num_rows), key=lambda b: -float(bounds[b].max())):
            need = np.maximum(best.scores[:, -1], least)
            open_ = np.flatnonzero(bounds[b] >= need)
            if not len(open_):
                continue
            names = np.frombuffer(data.column("ids")[b].as_py(), dtype=np.int64)
            x = unpack_all(data.column("vectors")[b].as_py(), d)
            for at in range(0, len(open_), 512):
                q = open_[at : at + 512]
                found = scores_of(vectors[q], x)
                found[ids[q][:, None] == names[None, :]] = np.iinfo(np.int64).min
                near = best_first(found, names, k)
                part = Best(len(q), k)
                part.scores, part.ids = best.scores[q], best.ids[q]
                part.add(np.take_along_axis(found, near, axis=1), names[near])
                best.scores[q], best.ids[q] = part.scores, part.ids
        real = (best.scores > np.iinfo(np.int64).min) & (best.ids < np.iinfo(np.int64).max) & (best.scores >= least[:, None])
        return pa.table({"query_id": np.repeat(ids, k)[real.ravel()], "vec_id": best.ids[real], "score": best.scores[real]})

    solved = places.groupBy("group", "share").cogroup(sent.groupBy("to", "of")).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
