"""License notices: exact phrases, and fuzzy ones found by pigeonhole seeds and verified by bounded-error matching.

Text is lower-cased (A-Z), and words are runs of ASCII letters, digits and non-ASCII characters. A phrase with up
to e edits must hold one of e + 1 parts unchanged; these seeds locate windows, in which the regex library finds the
best match within e edits that starts and ends at word edges.

Defined cases: a null text is an empty one: no words, no places, null first and last word, empty labels, score 0.
Equal best matches: the leftmost. Overlapping matches of one phrase count once. Texts of any length are scanned whole.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framefold.llm.common import slices

#: Fixed values of the contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices that the fuzzy search adds; the phrase, its label and the edits allowed.
FUZZY = (
    ("mit license", "mit", 1),
    ("apache license", "apache", 2),
    ("general public license", "gpl", 3),
    ("bsd license", "bsd", 1),
    ("mozilla public license", "mpl", 3),
    ("creative commons attribution", "cc-by", 4),
    ("all rights reserved", "proprietary", 2),
    ("permission is hereby granted free of charge", "mit", 6),
    ("redistribution and use in source and binary forms", "bsd", 6),
)
#: ASCII other than letters and digits parts words; A-Z becomes a-z.
FOLD = bytes(32 if i < 128 and not chr(i).isalnum() else i + 32 if 65 <= i <= 90 else i for i in range(256))


def seeds(phrase: str, edits: int) -> list[tuple[int, bytes]]:
    """The phrase in edits + 1 parts of nearly equal length, with their offsets."""
    cut = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b].encode()) for a, b in zip(cut, cut[1:], strict=False)]


@functools.cache
def patterns() -> list[tuple[str, str, int, list[tuple[int, bytes]], regex.Pattern]]:
    return [(p, label, e, seeds(p, e), regex.compile(rf"(?b)(?<=^|\s)(?:{regex.escape(p, special_only=True)}){{e<={e}}}(?=\s|$)")) for p, label, e in FUZZY]


def normalize(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Byte offsets at which the phrase's words stand consecutively; joined has a space before, between and after words."""
    found, at, want = [], 0, b" " + phrase + b" "
    while (at := joined.find(want, at)) >= 0:
        found.append(at + 1)
        at += 1
    return found


def windows(joined: bytes, parts: list[tuple[int, bytes]], length: int, edits: int) -> list[tuple[int, int]]:
    """Merged stretches around every exact seed in which a match can lie, wide enough for whole words at its ends."""
    found = []
    for offset, seed in parts:
        at = joined.find(seed)
        while at >= 0:
            found.append((max(0, at - offset - edits - 1), min(len(joined), at - offset + length + edits + 1)))
            at = joined.find(seed, at + 1)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return merged


def best_matches(text: str, pattern: regex.Pattern) -> list[regex.Match]:
    """The best match, and those of the parts before and behind it, each searched likewise; in order."""
    found, parts = [], [(0, len(text))]
    while parts:
        begin, end = parts.pop()
        if begin < end and (m := pattern.search(text, begin, end)):
            found.append(m)
            parts += [(begin, m.start() - 1), (m.end(), end)]
    return sorted(found, key=lambda m: m.start())


def verified(joined: bytes, begin: int, end: int, pattern: regex.Pattern) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) by byte of matches in a window; windows are cut at word edges so no edge is made up."""
    first = joined.rfind(b" ", 0, begin + 1) + 1
    last = joined.find(b" ", max(first, end - 1))
    text = joined[first : last if last >= 0 else len(joined)].decode("utf-8", "surrogatepass")
    for m in best_matches(text, pattern):
        yield first + len(text[: m.start()].encode("utf-8", "surrogatepass")), first + len(text[: m.end()].encode("utf-8", "surrogatepass")), sum(m.fuzzy_counts)


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, fuzzy spans of one text."""
    words = normalize(text)
    joined = b" " + b" ".join(words) + b" "
    starts: list[int] = []

    def word_at(offset: int) -> int:
        if not starts:
            at = 1
            for w in words:
                starts.append(at)
                at += len(w) + 1
        return bisect_right(starts, offset) - 1

    hits, base = [], set()
    for phrase, label in BASE:
        if found := places(joined, phrase.encode()):
            hits += [word_at(x) for x in found]
            base.add(label)
    labels, score, spans = set(base), 1.0 if base else 0.0, []
    for phrase, label, edits, parts, pattern in patterns():
        for begin, end in windows(joined, parts, len(phrase), edits):
            for a, b, errors in verified(joined, begin, end, pattern):
                labels.add(label)
                score = max(score, 1.0 - errors / len(phrase))
                spans.append({"phrase": phrase, "label": label, "first_word": word_at(a), "last_word": word_at(max(a, b - 1)), "edits": errors})
    spans.sort(key=lambda s: (s["first_word"], s["last_word"], s["phrase"]))
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


SPAN = "array<struct<phrase:string,label:string,first_word:long,last_word:long,edits:long>>"
SPAN_ARROW = pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())]))
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPAN_ARROW)
NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def scan_licenses(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [scan(t) for t in part.column("text").to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_column, *NAMES])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}")
