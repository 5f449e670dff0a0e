"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all training rows; the log-probability matrix (buckets x languages, bounded by
`MAX_LANGUAGES`) is broadcast, and batches are scored sparsely in numpy.

Defined cases: null text, empty text and text without a letter give `und` with score 0; rows with null lang are
not learned from; if nothing can be learned, all rows give `und`; repeated rows are each scored; further columns
of the input are ignored by `predict` and kept by `keep_known`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.llm.common import held_out, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: The matrix has at most BUCKETS x MAX_LANGUAGES doubles.
MAX_LANGUAGES = 256
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """By code point: the code point itself for a letter, else a space."""
    return np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), dtype=np.uint32, count=0x110000)


def features(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket ids per order at each position, where each text starts, and the letters each text has.

    Positions whose n-gram has no letter get the bucket BUCKETS, which never counts. Texts are parted by spaces.
    """
    lowered = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) + 2 for t in lowered])
    starts = np.concatenate(([0], ends[:-1]))
    points = np.frombuffer("  ".join(lowered).encode("utf-32-le", "surrogatepass") + b" \0\0\0" * 4, dtype=np.uint32)
    c = letters()[points]
    n = int(ends[-1]) if len(ends) else 0
    key, blank = np.zeros(n, dtype=np.uint32), np.ones(n, dtype=bool)
    found = []
    for k in range(max(ORDERS)):
        part = c[k : k + n]
        key = key * np.uint32(0x9E3779B1) + part + np.uint32(k + 1)
        blank = blank & (part == 32)
        if k + 1 in ORDERS:
            mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            bucket = ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype(np.int32)
            bucket[blank] = BUCKETS
            found.append(bucket)
    has = np.add.reduceat((c[:n] != 32).astype(np.int64), starts) if n else np.zeros(0, dtype=np.int64)
    return found, starts, has


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a partition's training rows; bucket -1 has the number of rows."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            index = {name: i for i, name in enumerate(names)}
            buckets, starts, _ = features(part.column("text").to_pylist())
            which = np.array([index[x] for x in langs], dtype=np.int64)
            ends = np.append(starts[1:], len(buckets[0]))
            row = np.repeat(which * (BUCKETS + 1), ends - starts)
            total = sum(np.bincount(row + b, minlength=len(names) * (BUCKETS + 1)) for b in buckets)
            for name, i in index.items():
                held = counts.setdefault(name, np.zeros(BUCKETS + 1, dtype=np.int64))
                held[:BUCKETS] += total[i * (BUCKETS + 1) : (i + 1) * (BUCKETS + 1) - 1]
                held[BUCKETS] += int((which == i).sum())
    for name, held in counts.items():
        at = np.flatnonzero(held)
        bucket = np.where(at == BUCKETS, -1, at).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(bucket), pa.array(held[at])], ["lang", "bucket", "n"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the (BUCKETS + 1) x languages log-probability matrix, from all rows of (text, lang).

    Raises ValueError over MAX_LANGUAGES languages, so that the broadcast matrix stays bounded.
    """
    labelled = labelled.select("text", "lang").where("lang IS NOT NULL")
    names = sorted(r["lang"] for r in labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    counts = labelled.mapInArrow(count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    index = {name: i for i, name in enumerate(names)}
    matrix, rows = np.zeros((BUCKETS + 1, len(names))), np.zeros(len(names))
    at = np.array([index[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    grams = bucket >= 0
    matrix[bucket[grams], at[grams]] = n[grams]
    rows[at[~grams]] = n[~grams]
    matrix[:BUCKETS] += SMOOTHING
    if names:
        matrix[:BUCKETS] = np.log(matrix[:BUCKETS]) - np.log(matrix[:BUCKETS].sum(axis=0))
    return names, np.log(np.maximum(rows, 1) / max(rows.sum(), 1)), matrix


def score_texts(texts: list[str | None], names: list[str], priors: np.ndarray, columns: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The most probable language of each text (ties to the first name) and its posterior probability."""
    buckets, starts, has = features(texts)
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    logs = np.stack([priors[k] + sum(np.add.reduceat(column[b], starts) for b in buckets) for k, column in enumerate(columns)], axis=1)
    best = logs.argmax(axis=1)
    share = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    return [names[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)], np.where(has > 0, share, 0.0)


def predict(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) of every row of docs, from a model of the (text, lang) rows of `labelled`."""
    spark = docs.sparkSession
    names, priors, matrix = train(labelled)
    model = spark.sparkContext.broadcast((names, priors, [np.ascontiguousarray(matrix[:, k]) for k in range(len(names))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs, scores = score_texts(part.column("text").to_pylist(), *model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_column, "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, labelled: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs, unchanged, whose language is known with a posterior of at least `least`."""
    spark = docs.sparkSession
    names, priors, matrix = train(labelled)
    model = spark.sparkContext.broadcast((names, priors, [np.ascontiguousarray(matrix[:, k]) for k in range(len(names))]))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs, scores = score_texts(part.column(text_at).to_pylist(), *model.value)
                yield part.filter(pa.array((scores >= least) & np.array([x != UNKNOWN for x in langs], dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """The rows that may be learned from: those outside the held-out fold with a lang."""
    return docs.where(~held_out("doc_id", folds, fold) & F.col("lang").isNotNull())
