"""Substring dedup: content-defined chunks by a gear rolling hash over words, deduplicated by digest.

Text is taken as its words, lower-cased (A-Z) and joined by spaces. A gear hash, h = (h << shift) + gear[word], rolls over
the words and holds the last `gear_words` of them. A word run whose hash is the least of `spread` runs in a row is a cut, so
cuts depend on what stands around them alone and come back soon after an insertion. A chunk reaches from a cut through the
run at the next cut. Spread is chosen so that any `LEAST_WORDS` words hold two cuts, and so a whole chunk, that no word
outside of them decides: two documents that share so many words share those chunks. Chunks are deduplicated by digest over
the corpus. A window of `LEAST_WORDS` words is looked up whole where all such chunks of its own come in two documents;
each that came in an earlier document, and so is a repeat by itself, is compared byte by byte with that document and grown
as far as both texts agree. A stretch of at least `LEAST_WORDS` whole words that an earlier document has is a repeat; the
first document keeps it.

Documents are dealt to blocks by id. A block asks for each distinct chunk and window once, in packed arrays by digest range,
and one task per range answers with the corpus's first place, so thousands of copies weigh no more than one row per block;
ranges that a block has nothing for get no message, so messages never outnumber digests. Blocks then ask for the texts they
compare with, each once per block.

Defined cases: null, empty and short texts have no repeats; rows without an id take no part and are kept as they are; rows
of one id are parts of one document, in the order of their texts; repeats within one document are left alone; of several
places of a window, the one with the smallest id is first; texts of any length are compared whole; an empty table gives no rows.
Ids are cast to long. Repeats have two words at least.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.llm.common import blocks, dealt_key, even_keys, materialize
from framefold.llm.simhash import FOLD

LEAST_WORDS = 50
#: Words that the gear hash holds, at most.
GEAR_WORDS = 8
#: Rows of one id are laid end to end at this distance.
ROW_SPAN = 1 << 40
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def normal(text: str | None) -> bytes:
    return b" ".join(w for w in (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split(b" ") if w)


class Block:
    """The documents of a block: rows sorted by id and text, and their chunks."""

    def __init__(self, table: pa.Table, id_column: str):
        self.table = table
        ids, texts = table.column(id_column).cast(pa.int64()).to_pylist(), table.column("text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k] or ""))
        self.ids = [ids[k] for k in self.order]
        self.texts = [normal(texts[k]) for k in self.order]
        self.part = [k - bisect_left(self.ids, x) for k, x in enumerate(self.ids)]

    def words(self, least: int) -> Iterator[Words]:
        """The words of rows of at least so many, about PIECE bytes at a time; long texts in pieces that share one word less than a window."""
        rows, texts, begins, held = [], [], [], 0
        for row, text in enumerate(self.texts):
            for begin, end in pieces(text, least):
                if rows and held + end - begin > PIECE:
                    yield Words(rows, texts, begins)
                    rows, texts, begins, held = [], [], [], 0
                rows.append(row)
                texts.append(text[begin:end])
                begins.append(begin)
                held += end - begin
        if rows:
            yield Words(rows, texts, begins)

    def chunk_digests(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct digests of chunks, and those that two documents of the block have."""
        digests, docs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        ids = np.array(self.ids, dtype=np.int64)
        for words in self.words(least):
            cuts, digest, whole = words.chunks(least)
            digests.append(digest[whole])
            docs.append(ids[words.row[cuts[:-1]][whole]])
        digest, doc = np.concatenate(digests), np.concatenate(docs)
        order = np.lexsort((doc, digest))
        digest, doc = digest[order], doc[order]
        return np.unique(digest), np.unique(digest[1:][(digest[1:] == digest[:-1]) & (doc[1:] != doc[:-1])])

    def windows(self, least: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digest, row, begin and end of each window whose own chunks are all known, by row and begin."""
        empty = np.zeros(0, dtype=np.int64)
        found = [(empty.astype(np.uint64), empty, empty, empty)]
        g, n = gear_words(least), spread(least)
        for words in self.words(least):
            whole, valid = words.digests(least)
            cuts, digest, _ = words.chunks(least)
            before = np.concatenate(([0], np.cumsum(np.bincount(cuts, minlength=len(words.begin)))))  # cuts before each word
            missing = np.concatenate(([0], np.cumsum(~np.isin(digest, known))))  # unknown chunks before each
            start = np.arange(len(whole))
            first, last = before[start + n - 1], before[start + least - g - n + 2] - 1
            k = np.flatnonzero(valid & (last > first) & (missing[np.maximum(last, 0)] == missing[np.minimum(first, len(missing) - 1)]))
            found.append((whole[k], words.row[k], words.begin[k] + words.shift[k], words.end[k + least - 1] + words.shift[k]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: Bytes of text that are hashed at a time.
PIECE = 1 << 20
FACTOR = 0xD1342543DE82EF95
KEPT: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR and of its inverse, modulo 2^64."""
    if len(KEPT.get("up", ())) < n:
        for name, x in (("up", FACTOR), ("down", pow(FACTOR, -1, 1 << 64))):
            steps = np.full(max(n, 2 * PIECE), x, dtype=np.uint64)
            steps[0] = 1
            KEPT[name] = np.cumprod(steps, dtype=np.uint64)
    return KEPT["up"][:n], KEPT["down"][:n]


def byte_table() -> np.ndarray:
    """A 64-bit value for each byte, from splitmix64 of the byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = byte_table()


def gear_words(least: int) -> int:
    """Words that the gear hash holds."""
    return min(GEAR_WORDS, max(1, least // 6))


def spread(least: int) -> int:
    """Of so many runs in a row one is a cut. A window has least - gear_words + 1 runs, of which spread - 1 at either end may be cut by words outside; the rest holds two spreads."""
    return (least + 3 - gear_words(least)) // 4


def running(x: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """of(x[i : i + n]) for each i that has so many."""
    if len(x) < n:
        return x[:0]
    most, span = x, 1
    while 2 * span <= n:
        most = of(most[:-span], most[span:])
        span *= 2
    return of(most[: len(x) - n + 1], most[n - span :][: len(x) - n + 1])


def pieces(text: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Begin and end of pieces that hold every window of so many words whole, each in one of them; none for fewer words."""
    begin = 0
    while len(text) - begin > PIECE:
        end = text.find(b" ", begin + PIECE)
        more = 2 * least - text.count(b" ", begin, end if end >= 0 else len(text))
        while end >= 0 and more > 0:
            end = text.find(b" ", end + 1)
            more -= 1
        if end < 0:
            break
        yield begin, end
        begin = end
        for _ in range(least - 1):
            begin = text.rfind(b" ", 0, begin)
        begin = begin + 1 if least > 1 else end + 1
    if text and text.count(b" ", begin) + 1 >= least:
        yield begin, len(text)


class Words:
    """The words of some pieces of text: row, begin and end, to which `shift` is added to give places in the row's text."""

    def __init__(self, rows: list[int], texts: list[bytes], begins: list[int]):
        data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        space = np.flatnonzero(data == 32)
        self.begin, self.end = np.concatenate(([0], space + 1)), np.append(space, len(data))
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
        self.piece = np.searchsorted(starts, self.begin, side="right") - 1
        self.row, self.shift = np.array(rows)[self.piece], (np.array(begins) - starts)[self.piece]
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTES[data] * self.up[:-1], dtype=np.uint64)))

    def digests(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The digest of each n words in a row, and whether they are of one piece."""
        count = max(0, len(self.begin) - n + 1)
        return self.digest_of(self.begin[:count], self.end[n - 1 :]), self.piece[:count] == self.piece[n - 1 :]

    def gear(self, n: int) -> np.ndarray:
        """The gear hash of each n words in a row; a word that has left is shifted out."""
        word = self.digests(1)[0]
        count = max(0, len(word) - n + 1)
        h, shift = np.zeros(count, dtype=np.uint64), np.uint64(-(-64 // n))
        for k in range(n):
            h = (h << shift) + word[k : k + count] if k else word[:count].copy()
        return np.maximum(h, np.uint64(1))

    def chunks(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cuts, ascending, the digest of the chunk from each to the next, and whether that is of one piece. Equal hashes are all cuts."""
        g, n = gear_words(least), spread(least)
        h = self.gear(g)
        valid = self.piece[: max(0, len(self.piece) - g - n + 2)] == self.piece[g + n - 2 :]
        lowest = np.where(valid, running(h, n, np.minimum), np.uint64(0)) if len(valid) else np.zeros(0, dtype=np.uint64)
        blank = np.zeros(n - 1, dtype=np.uint64)
        cuts = np.flatnonzero(running(np.concatenate((blank, lowest, blank)), n, np.maximum) == h) if len(valid) else np.zeros(0, dtype=np.int64)
        begin, last = cuts[:-1], cuts[1:] + g - 1
        return cuts, self.digest_of(self.begin[begin], self.end[last]), self.piece[begin] == self.piece[last]

    def digest_of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.maximum(mixed((self.sums[end] - self.sums[begin]) * self.down[begin]), np.uint64(1))


def grown(a: bytes, b: bytes, i: int, j: int, n: int) -> tuple[int, int, int] | None:
    """The longest common stretch around a[i:i+n] == b[j:j+n] as (start in a, start in b, length); None if these differ."""
    if a[i : i + n] != b[j : j + n]:
        return None
    step = 256
    while i and j:
        k = min(step, i, j)
        if a[i - k : i] == b[j - k : j]:
            i, j, n = i - k, j - k, n + k
        elif k == 1:
            break
        else:
            step = k // 2
    step = 256
    while i + n < len(a) and j + n < len(b):
        k = min(step, len(a) - i - n, len(b) - j - n)
        if a[i + n : i + n + k] == b[j + n : j + n + k]:
            n += k
        elif k == 1:
            break
        else:
            step = k // 2
    return i, j, n


def whole_words(a: bytes, b: bytes, i: int, j: int, n: int) -> tuple[int, int]:
    """The stretch's start and length in a, cut down to words that are whole in both texts."""
    end = i + n
    if (i and a[i - 1] != 32) or (j and b[j - 1] != 32):
        at = a.find(b" ", i, end)
        i = end if at < 0 else at + 1
    if (end < len(a) and a[end] != 32) or (j + n < len(b) and b[j + n] != 32):
        at = a.rfind(b" ", i, end)
        end = i if at < 0 else at
    while i < end and a[i] == 32:
        i += 1
    while end > i and a[end - 1] == 32:
        end -= 1
    return i, end - i


RUN = "block int, doc long, at long, size long, first_doc long, first_at long, text binary"


def find_repeats(docs: DataFrame, id_column: str = "doc_id", least_words: int = LEAST_WORDS, cut: bool = False) -> DataFrame:
    """Repeats as (id, start_word, n_words, first_doc_id, first_start_word, part); or, with `cut`, docs with repeats cut from their texts."""
    if least_words < 2:
        raise ValueError("a repeat has two words at least")
    spark = docs.sparkSession
    parts = blocks(spark)
    keys = even_keys(spark, parts)
    block_of = lambda c: dealt_key(F.xxhash64(c.cast("long")), keys)
    named = docs.where(F.col(id_column).isNotNull())
    rows = named if cut else named.select(id_column, "text")
    block_column = "__framefold_block"
    dealt = rows.withColumn(block_column, block_of(F.col(id_column))).repartition(parts, block_column)
    edges = np.array([(1 << 64) * k // parts for k in range(1, parts)], dtype=np.uint64)

    def first_places(block: Block, replies: pa.Table) -> tuple[tuple, np.ndarray, np.ndarray]:
        """The windows to look up; of each distinct digest, sorted, the block's first window; and which distinct digest each window has."""
        _, own = block.chunk_digests(least_words)
        known = np.unique(np.concatenate([own, *(np.frombuffer(x, dtype=np.uint64) for x in replies.column("digests").to_pylist())]))
        windows = block.windows(least_words, known)
        _, first, which = np.unique(windows[0], return_index=True, return_inverse=True)
        return windows, first, which

    def place(block: Block, row: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.array(block.ids, dtype=np.int64)[row], np.array(block.part, dtype=np.int64)[row] * ROW_SPAN + begin

    def ask_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        for number in table.column(block_column).unique().to_pylist():
            wanted, _ = Block(table.filter(pc.equal(table.column(block_column), number)), id_column).chunk_digests(least_words)
            border = np.concatenate(([0], np.searchsorted(wanted, edges), [len(wanted)]))
            for s in range(parts):
                a, b = border[s], border[s + 1]
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[s]], pa.int32()), pa.array([number], pa.int32()), pa.array([wanted[a:b].tobytes()], pa.binary())], ["shard", "block", "digests"])

    def answer_chunks(group: pa.Table) -> pa.Table:
        """For each block, the digests that other blocks have too."""
        digests = [np.frombuffer(x, dtype=np.uint64) for x in group.column("digests").to_pylist()]
        every = np.sort(np.concatenate(digests))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        return pa.table({"block": group.column("block"), "digests": pa.array([np.intersect1d(x, twice, assume_unique=True).tobytes() for x in digests], pa.binary())})

    dealt_again = dealt.groupBy(block_column)
    asked_chunks = dealt.mapInArrow(ask_chunks, "shard int, block int, digests binary")
    shared = asked_chunks.groupBy("shard").applyInArrow(answer_chunks, "block int, digests binary").where("length(digests) > 0")

    def ask(own: pa.Table, replies: pa.Table) -> pa.Table:
        rows_ = []
        if own.num_rows:
            block = Block(own, id_column)
            (digest, row, begin, _), first, _ = first_places(block, replies)
            wanted, (doc, at) = digest[first], place(block, row[first], begin[first])
            border = np.concatenate(([0], np.searchsorted(wanted, edges), [len(wanted)]))
            number = own.column(block_column)[0].as_py()
            rows_ = [(keys[s], number, *(x[a:b].tobytes() for x in (wanted, doc, at))) for s, (a, b) in enumerate(zip(border, border[1:], strict=False)) if b > a]
        kinds = {"shard": pa.int32(), "block": pa.int32(), "digests": pa.binary(), "docs": pa.binary(), "places": pa.binary()}
        return pa.table({name: pa.array([r[k] for r in rows_], kind) for k, (name, kind) in enumerate(kinds.items())})

    asked = dealt_again.cogroup(shared.groupBy("block")).applyInArrow(ask, "shard int, block int, digests binary, docs binary, places binary")

    def answer(group: pa.Table) -> pa.Table:
        """For each block, the digests whose first place is in another block."""
        digests = [np.frombuffer(x, dtype=np.uint64) for x in group.column("digests").to_pylist()]
        docs_, places = (np.concatenate([np.frombuffer(x, dtype=np.int64) for x in group.column(c).to_pylist()]) for c in ("docs", "places"))
        every = np.concatenate(digests)
        order = np.lexsort((places, docs_, every))
        ordered = every[order]
        head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        leader = np.empty(len(every), dtype=np.int64)
        leader[order] = order[head][np.cumsum(head) - 1]
        said, at = [], 0
        for x in digests:
            own = np.arange(at, at + len(x))
            other = own[leader[own] != own]
            said.append((every[other].tobytes(), docs_[leader[other]].tobytes(), places[leader[other]].tobytes()))
            at += len(x)
        return pa.table({"block": group.column("block"), **{c: pa.array(list(v), pa.binary()) for c, v in zip(("digests", "docs", "places"), zip(*said, strict=True), strict=True)}})

    answers = asked.groupBy("shard").applyInArrow(answer, "block int, digests binary, docs binary, places binary").where("length(digests) > 0")

    def runs(own: pa.Table, replies: pa.Table) -> pa.Table:
        """Windows in a row that all came before, in a row, in one other document."""
        empty = pa.table({"block": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("doc", "at", "size", "first_doc", "first_at")}, "text": pa.array([], pa.binary())})
        if not own.num_rows:
            return empty
        block = Block(own, id_column)
        is_chunk = replies.column("docs").is_null()
        (digest, row, begin, end), first, which = first_places(block, replies.filter(is_chunk))
        replies = replies.filter(pc.invert(is_chunk))
        if not len(digest):
            return empty
        wanted, (doc, at) = digest[first], place(block, row[first], begin[first])
        doc, at = doc.copy(), at.copy()
        for d, x, p in zip(*(replies.column(c).to_pylist() for c in ("digests", "docs", "places")), strict=True):
            k = np.searchsorted(wanted, np.frombuffer(d, dtype=np.uint64))
            doc[k], at[k] = np.frombuffer(x, dtype=np.int64), np.frombuffer(p, dtype=np.int64)
        own_doc, own_at = place(block, row, begin)
        before, before_at = doc[which], at[which]
        k = np.flatnonzero(before != own_doc)
        if not len(k):
            return empty
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1] + 1) | (row[k][1:] != row[k][:-1]) | (begin[k][1:] > end[k][:-1]) | (before[k][1:] != before[k][:-1]) | ((own_at - before_at)[k][1:] != (own_at - before_at)[k][:-1])
        a = k[new]  # growth from a run's first window covers the rest
        number = own.column(block_column)[0].as_py()
        return pa.table({"block": pa.array(np.full(len(a), number, dtype=np.int32)), "doc": own_doc[a], "at": own_at[a], "size": end[a] - begin[a], "first_doc": before[a], "first_at": before_at[a], "text": pa.nulls(len(a), pa.binary())})

    replies = answers.unionByName(shared, allowMissingColumns=True)
    found = materialize(dealt_again.cogroup(replies.groupBy("block")).applyInArrow(runs, RUN), "runs").repartition(parts, "block")
    needed = found.select("block", "first_doc", F.shiftright("first_at", 40).alias("part")).distinct().withColumn("first_block", block_of(F.col("first_doc")))

    def send(own: pa.Table, wanted: pa.Table) -> pa.Table:
        if not own.num_rows or not wanted.num_rows:
            own, wanted = own.slice(0, 0), wanted.slice(0, 0)
        block = Block(own, id_column)
        texts = [block.texts[bisect_left(block.ids, d) + p] for d, p in zip(wanted.column("first_doc").to_pylist(), wanted.column("part").to_pylist(), strict=True)]
        blank = pa.nulls(wanted.num_rows, pa.int64())
        return pa.table({"block": wanted.column("block"), "doc": blank, "at": blank, "size": blank, "first_doc": wanted.column("first_doc"), "first_at": pc.multiply(wanted.column("part").cast(pa.int64()), ROW_SPAN), "text": pa.array(texts, pa.binary())})

    sent = dealt_again.cogroup(needed.groupBy("first_block")).applyInArrow(send, RUN)

    def settle(own: pa.Table, facts: pa.Table) -> tuple[Block, list[tuple[int, list[tuple[int, int, int, int, int]]]]]:
        """The block, and for rows that have some, the repeats as (first word, words, first document, its word, part)."""
        block = Block(own, id_column)
        is_text = facts.column("text").is_valid()
        texts = facts.filter(is_text)
        text_of = dict(zip(zip(texts.column("first_doc").to_pylist(), texts.column("first_at").to_pylist(), strict=True), texts.column("text").to_pylist(), strict=True))
        by_row: dict[int, list[tuple[int, int, int, int]]] = {}
        every = facts.filter(pc.invert(is_text))
        for doc, at, size, first, first_at in zip(*(every.column(c).to_pylist() for c in ("doc", "at", "size", "first_doc", "first_at")), strict=True):
            by_row.setdefault(bisect_left(block.ids, doc) + at // ROW_SPAN, []).append((at % ROW_SPAN, size, first, first_at))
        out: list[tuple[int, list[tuple[int, int, int, int, int]]]] = []
        for row, hits in by_row.items():
            text, spans, done, reach = block.texts[row], [], {}, 0
            for at, size, first, first_at in sorted(hits):
                slot = (first, first_at - first_at % ROW_SPAN, at - first_at % ROW_SPAN)
                if at + size <= max(done.get(slot, 0), reach):
                    continue  # any window outside the spans so far is a hit of its own
                other = text_of[slot[:2]]
                match = grown(text, other, at, first_at % ROW_SPAN, size)
                if match is None:
                    continue
                i, j, n = match
                done[slot] = i + n
                start, length = whole_words(text, other, i, j, n)
                words = text.count(b" ", start, start + length) + 1 if length else 0
                if words >= least_words:
                    reach = max(reach, start + length)
                    spans.append((text.count(b" ", 0, start), words, first, other.count(b" ", 0, j + start - i), block.part[row]))
            kept, reach = [], 0
            for span in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
                if span[0] + span[1] > reach:
                    kept.append(span)
                    reach = span[0] + span[1]
            if kept:
                out.append((row, kept))
        return block, out

    facts = found.unionByName(sent).groupBy("block")
    if not cut:

        def spans(own: pa.Table, said: pa.Table) -> pa.Table:
            block, out = settle(own, said) if own.num_rows and said.num_rows else (None, [])
            rows_ = [(block.ids[row], *s) for row, kept in out for s in kept]
            return pa.table([pa.array([r[k] for r in rows_], pa.int64()) for k in range(6)], names=[id_column, "start_word", "n_words", "first_doc_id", "first_start_word", "part"])

        return dealt_again.cogroup(facts).applyInArrow(spans, f"`{id_column}` long, start_word long, n_words long, first_doc_id long, first_start_word long, part long")

    def cleaned(own: pa.Table, said: pa.Table) -> pa.Table:
        table = own.drop_columns([block_column])
        if own.num_rows and said.num_rows:
            block, out = settle(own, said)
            texts = own.column("text").to_pylist()
            for row, kept in out:
                texts[block.order[row]] = without(texts[block.order[row]], [(s[0], s[1]) for s in kept])
            at = table.column_names.index("text")
            table = table.set_column(at, table.schema.field("text"), pa.array(texts, table.schema.field("text").type))
        return table

    changed = dealt_again.cogroup(facts).applyInArrow(cleaned, docs.schema)
    return docs.where(F.col(id_column).isNull()).unionByName(changed)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first word, words); what stands between other words stays."""
    data = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for first, words in sorted(spans):
        begin, end = starts[first], starts[min(first + words, len(starts) - 1)]
        if begin > at:
            out.append(data[at:begin])
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def cut_repeats(docs: DataFrame, id_column: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs with all columns; each repeat of an earlier document is cut from `text`, which may become empty."""
    return find_repeats(docs, id_column, least_words, cut=True)
