"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents are dealt to groups of about `GROUP` rows, and each group is packed by itself: pieces go in by falling size;
open bins are kept in order of their residual, and each carries a bitmap of its sources and one of its duplicate clusters.
The search starts at the least residual that holds the piece and goes on to the next bin until one is compatible, which
is the tightest; without one a new bin is opened. A bin never has two pieces of one source or of one cluster. A hot source
or cluster is spread over the groups like any other rows and takes a bin for each of its pieces.

A document of over `capacity` words is cut into pieces of that size and a last one; nothing is dropped. A cluster is the
documents whose lower-case words are the same. Defined cases: a document without words (null, empty, blank) is one piece
of no words and of no cluster; a null source conflicts with nothing; repeated rows are packed each; an empty table gives
no rows; equal sizes go in by id and equal residuals by the bin's age.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.llm.common import dealt_key, even_keys, slices
from framefold.llm.simhash import FOLD

CAPACITY = 2048
GROUP = 4000
#: Fixed for a bin's number: the group in the high bits, the bin in the low ones.
BIN_BITS = 32


def best_fit(sizes: list[int], sources: list[str | None], clusters: list[int | None], capacity: int) -> list[int]:
    """The bin of each piece; pieces are taken in the order given."""
    source_bit = {s: 1 << k for k, s in enumerate(sorted({s for s in sources if s is not None}))}
    often = [c for c, n in Counter(c for c in clusters if c is not None).items() if n > 1]
    cluster_bit = {c: 1 << k for k, c in enumerate(often)}
    order: list[tuple[int, int]] = []
    bin_sources: list[int] = []
    bin_clusters: list[int] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(order, (size, -1))
        while at < len(order) and (bin_sources[order[at][1]] & s or bin_clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, number = order.pop(at)
        else:
            residual, number = capacity, len(bin_sources)
            bin_sources.append(0)
            bin_clusters.append(0)
        bin_sources[number] |= s
        bin_clusters[number] |= c
        insort(order, (residual - size, number))
        placed.append(number)
    return placed


def measured(docs: DataFrame, id_column: str, source_column: str) -> DataFrame:
    """(id, source, words, cluster) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = [(t or "").encode("utf-8", "surrogatepass").translate(FOLD).split(b" ") for t in part.column("text").to_pylist()]
                words = [[w for w in ws if w] for ws in words]
                clusters = [xxhash.xxh3_64_intdigest(b" ".join(ws)) - (1 << 63) if ws else None for ws in words]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(ws) for ws in words], pa.int64()), pa.array(clusters, pa.int64())], ["id", "source", "words", "cluster"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), "text").mapInArrow(run, f"id {kind}, source string, words long, cluster long")


def pack(docs: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """(id, piece, start_word, n_words, source, cluster, bin_id, bin_words): one row per piece of a document."""
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // GROUP))
    keys = even_keys(spark, groups)
    number = {k: n for n, k in enumerate(keys)}
    rows = measured(docs, id_column, source_column)
    dealt = rows.withColumn("dealt", dealt_key(F.xxhash64("id", "source", "words", "cluster"), keys)).repartition(groups, "dealt")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        words = group.column("words").to_numpy()
        pieces = np.maximum(1, -(-words // capacity))
        of = np.repeat(np.arange(len(words)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        size = np.minimum(capacity, words[of] - start)
        ids, sources, clusters = (group.column(c).to_pylist() for c in ("id", "source", "cluster"))
        order = sorted(range(len(of)), key=lambda k: (-size[k], ids[of[k]] is None, ids[of[k]] if ids[of[k]] is not None else 0, piece[k]))
        of, piece, start, size = of[order], piece[order], start[order], size[order]
        bins = np.array(best_fit(size.tolist(), [sources[k] for k in of], [clusters[k] for k in of], capacity), dtype=np.int64)
        held = np.bincount(bins, weights=size, minlength=1).astype(np.int64)
        return pa.table(
            {
                id_column: group.column("id").take(pa.array(of)),
                "piece": pa.array(piece.astype(np.int64)),
                "start_word": pa.array(start.astype(np.int64)),
                "n_words": pa.array(size.astype(np.int64)),
                "source": group.column("source").take(pa.array(of)),
                "cluster": group.column("cluster").take(pa.array(of)),
                "bin_id": pa.array(bins + (number[group.column("dealt")[0].as_py()] << BIN_BITS)),
                "bin_words": pa.array(held[bins]),
            }
        )

    return dealt.groupBy("dealt").applyInArrow(run, f"`{id_column}` {kind}, piece long, start_word long, n_words long, source string, cluster long, bin_id long, bin_words long")
