"""Tokenizer encoding: prefix-sharing trie BPE with decoding, and token-id files in ORC.

Texts are cut where no tokenizer rule looks across, so that each distinct piece is encoded once and remembered in a
cache of bounded size. For the byte-level vocabulary the distinct words of a slice form a trie, which is walked depth
first: a node's state is the last token of its prefix's encoding, found from the states above it, so shared prefixes are
worked on once. The word vocabulary's pieces go through the tokenizers library.

Defined cases: a null text is an empty one and has no ids of its own; texts of any length are encoded whole; special
tokens that stand in a text become their ids, as in the library; repeated rows are each encoded.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framefold.llm.common import materialize, scratch_path, slices

#: White space of the tokenizers' patterns (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A space and what follows it up to white space; or white space not taken so. No byte-level rule looks across these pieces.
BYTE_PIECES = regex.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: White space outside ASCII.
ODD_SPACE = regex.compile(f"[{SPACE.split(' ', 1)[1]}]")
#: Pieces that are one word.
PLAIN = regex.compile(" ?[A-Za-z]+")
#: Fixed rule of the byte-level vocabulary: contractions, letters, numbers, other signs, white space. Used on ASCII.
BYTE_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: By byte: 0 outside ASCII, 1 letter, 2 digit, 3 other sign, 4 white space.
CLASS = np.array([0 if i > 127 else 4 if i == 32 or 9 <= i <= 13 else 1 if chr(i).isalpha() else 2 if chr(i).isdigit() else 3 for i in range(256)], dtype=np.int8)
#: Words that a worker remembers; the bytes of text that it encodes together.
REMEMBERED, SLICE = 400_000, 8 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else the next free sign from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Store:
    """What a worker remembers: pieces that came more than once in a slice. Forgets all when there are over REMEMBERED."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def encode(self, encoder: TrieEncoder | LibraryEncoder, pieces: list[str], often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of ids, and where in it each piece's begin and how many it has."""
        known = self.known
        at = np.fromiter((known.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        new = np.flatnonzero(at < 0)
        ids, counts = encoder.encode_pieces([pieces[k] for k in new.tolist()])
        all_ids, all_counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        at[new] = len(self.counts) + np.arange(len(new))
        first = np.cumsum(all_counts) - all_counts
        if len(known) > REMEMBERED:
            known.clear()
            self.ids, self.counts = self.ids[:0], self.counts[:0]
        keep = often[new]
        known.update(zip([pieces[k] for k in new[keep].tolist()], range(len(self.counts), len(self.counts) + int(keep.sum())), strict=True))
        self.ids, self.counts = np.concatenate([self.ids, ids[np.repeat(keep, counts)]]), np.concatenate([self.counts, counts[keep]])
        return all_ids, first[at], all_counts[at]


class TrieEncoder:
    """Byte-pair encoding of words by last-token states over a trie, from a tokenizers JSON file."""

    FOLD = None

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = ByteLevel(add_prefix_space=False)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.vocabulary = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.merges = {(self.vocabulary[a], self.vocabulary[b]): (rank, self.vocabulary[a + b]) for rank, (a, b) in enumerate((as_bytes(x), as_bytes(y)) for x, y in pairs)}
        self.bytes_of = {i: t for t, i in self.vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        #: By the last three bytes of a prefix: the length of the longest token that ends so.
        self.reach: dict[bytes, int] = {}
        for token in self.vocabulary:
            for end in {token[-3:], token}:
                self.reach[end] = max(self.reach.get(end, 2), len(token))
        for token, length in list(self.reach.items()):
            self.reach[token] = max(length, 2)
        self.sizes = {i: len(t) for i, t in self.bytes_of.items()}
        self.store = Store()
        self.stable: dict[tuple[int, int], bool] = {}
        lengths = np.zeros(max(self.bytes_of) + 1, dtype=np.int64)
        for i, t in self.bytes_of.items():
            lengths[i] = len(t)
        self.lengths, self.offsets = lengths, np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.letters = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(lengths))), dtype=np.uint8)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, data: bytes) -> list[int]:
        """Plain byte-pair encoding by ascending rank; the slow form that states are checked with."""
        ids = [self.vocabulary[data[k : k + 1]] for k in range(len(data))]
        while len(ids) > 1:
            rank, at = min((self.merges.get(pair, (1 << 60, 0))[0], k) for k, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            pair = (ids[at], ids[at + 1])
            joined, out, k = self.merges[pair][1], [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(joined)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def is_stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side; left is -1 at a word's start."""
        key = (left, right)
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > 2_000_000:
                self.stable.clear()
            known = self.merged(self.bytes_of[right]) == [right] if left < 0 else self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.stable[key] = known
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of each word. Sorted words are the trie in depth-first order; `last` holds the states on the path to the node."""
        out: dict[bytes, list[int]] = {}
        last: list[int] = [-1]
        before = b""
        vocabulary, reach, stable, sizes = self.vocabulary, self.reach, self.stable, self.sizes
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(max(0, end - reach.get(word[max(0, end - 3) : end], 2)), end):
                    token = vocabulary.get(word[begin:end])
                    if token is None:
                        continue
                    held = last[begin]
                    ok = stable.get((held, token))
                    if ok is None:
                        ok = self.is_stable(held, token)
                    if ok:
                        last.append(token)
                        break
                else:
                    raise AssertionError("a prefix without an encoding")
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= sizes[last[at]]
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids in a row, and how many each has. The library cuts pieces that aren't ASCII, as Unicode's classes differ by version."""
        split = [(p.encode(),) if PLAIN.fullmatch(p) else [w.encode() for w in (BYTE_WORDS.findall(p) if p.isascii() else (p[a:b] for _, (a, b) in self.library.pre_tokenize_str(p)))] for p in pieces]
        known = self.encode_words({w for words in split for w in words})
        found = [known[words[0]] if len(words) == 1 else [i for w in words for i in known[w]] for words in split]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(counts.sum())), counts

    def encode_text(self, text: str) -> np.ndarray:
        """One text's ids, by its special tokens and pieces; for texts that `encode_all` can't cut by bytes."""
        found = [np.zeros(0, dtype=np.uint32)]
        for special, part in self.parts(text):
            pieces = [] if special else BYTE_PIECES.findall(part)
            found.append(np.array([self.special[part]], dtype=np.uint32) if special else self.encode_pieces(pieces)[0])
        return np.concatenate(found)

    def is_odd(self, text: str) -> bool:
        return bool(ODD_SPACE.search(text)) or bool(self.special_pattern and self.special_pattern.search(text))

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """The text cut at special tokens: (is special, text)."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return [(False, text)]
        found, at = [], 0
        for m in self.special_pattern.finditer(text):
            found += [(False, text[at : m.start()]), (True, m[0])]
            at = m.end()
        return [*found, (False, text[at:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.letters[at].tobytes().decode("utf-8", "replace")


class LibraryEncoder:
    """Pieces through the tokenizers library, for tokenizers that drop white space and never look across it."""

    #: The vocabulary is lower case; ASCII may be folded beforehand.
    FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
    #: Stands between pieces; a sign of its own with one id.
    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_pattern = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.store = Store()
        (self.mark,) = self.encode_text(self.MARK).tolist()

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids in a row, and how many each has; pieces are encoded in long strings with marks between."""
        between = f" {self.MARK} "
        texts = [between.join("" if self.MARK in p else p for p in pieces[k : k + 1000]) + between for k in range(0, len(pieces), 1000)]
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *(np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        marks = np.flatnonzero(ids == self.mark)
        counts = np.diff(marks, prepend=-1) - 1
        if len(marks) != len(pieces):
            raise AssertionError("a mark merged with a piece")
        ids = ids[ids != self.mark]
        own = [k for k, p in enumerate(pieces) if self.MARK in p]
        if own:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in own:
                parts[k] = self.encode_text(pieces[k])
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, counts

    def encode_text(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def is_odd(self, text: str) -> bool:
        return bool(ODD_SPACE.search(text)) or bool(self.special_pattern and self.special_pattern.search(text))


def cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces start in UTF-8 bytes whose only white space is ASCII: the BYTE_PIECES rule for all texts at once.

    Pieces are cut further between ASCII letters, digits and other signs, where words end in either vocabulary's rule;
    but not after an apostrophe, which may begin a contraction. starts: where texts of at least one byte start.
    """
    kind = CLASS[data]
    blank = kind == 4
    after = np.concatenate(([False], blank[:-1]))
    after[starts] = False
    begin = blank & ~after
    begin[starts] = True
    words = np.flatnonzero(~blank & after)
    begin[words - 1] = True
    begin[words[data[words - 1] != 32]] = True
    a, b = kind[:-1], kind[1:]
    begin[1:] |= (a != b) & (a > 0) & (b > 0) & (a < 4) & (b < 4) & ~((data[:-1] == 39) & (b == 1))
    return np.flatnonzero(begin)


def encode_all(encoder: TrieEncoder | LibraryEncoder, texts: list[str]) -> list[np.ndarray]:
    """Each text's ids. Distinct pieces are encoded once; texts with other white space or special tokens go one by one."""
    odd = {k: encoder.encode_text(t) for k, t in enumerate(texts) if encoder.is_odd(t)}
    encoded = [b"" if k in odd else t.encode().translate(encoder.FOLD) for k, t in enumerate(texts)]
    ends = np.cumsum(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)))
    begins = np.concatenate(([0], ends[:-1]))
    data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
    if not len(data):
        return [odd.get(k, np.zeros(0, dtype=np.uint32)) for k in range(len(texts))]
    at = cut(data, begins[begins < ends])
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
    which = pieces.indices.to_numpy()
    ids, first, counts = encoder.store.encode(encoder, pieces.dictionary.to_pylist(), np.bincount(which) > 1)
    each = counts[which]
    to = np.cumsum(each)
    flat = ids[np.repeat(first[which] - (to - each), each) + np.arange(int(to[-1]))]
    border = np.concatenate(([0], to))[np.searchsorted(at, np.append(begins, len(data)))]
    return [odd[k] if k in odd else flat[a:b] for k, (a, b) in enumerate(zip(border, border[1:], strict=False))]


#: By kind and path: what this worker process has loaded.
LOADED: dict[tuple[type, str], TrieEncoder | LibraryEncoder] = {}


def loaded(kind: type, path: str) -> TrieEncoder | LibraryEncoder:
    if (kind, path) not in LOADED:
        LOADED[kind, path] = kind(path)
    return LOADED[kind, path]


def encode_and_decode(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, by a byte-level vocabulary file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(TrieEncoder, path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                encoded = [x.astype("<u4", copy=False) for x in encode_all(encoder, [t or "" for t in part.column("text").to_pylist()])]
                decoded = [encoder.decode(x) for x in encoded]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in encoded], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in encoded]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])],
                    [id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of every row by a word vocabulary, each with the end id appended; keeps the rows' order."""
    end = np.array([end_id], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(LibraryEncoder, path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                encoded = encode_all(encoder, [t or "" for t in part.column("text").to_pylist()])
                ends = np.cumsum([0, *(len(x) + 1 for x in encoded)]).astype(np.int32)
                flat = np.concatenate([y for x in encoded for y in (x, end)]).view(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, files: int, id_column: str = "doc_id", stripe_bytes: int = 16 << 20) -> None:
    """Write every row's ids as ORC in ascending id order, rows of equal ids by their text; a null id comes first.

    Integer columns are run-length encoded (version 2), a row index entry is kept per 1,000 rows, and the id column has
    a Bloom filter, so that readers take stripes in parallel and skip by id. File names ascend with the ids.
    """
    ordered = docs.select(id_column, "text").repartitionByRange(files, F.col(id_column).asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col(id_column).asc_nulls_first(), F.xxhash64("text"))
    encode_ids(ordered, tokenizer, end_id, id_column).write.option("orc.bloom.filter.columns", id_column).option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "1000").option("orc.create.index", "true").option(
        "orc.stripe.size", str(stripe_bytes)
    ).option("orc.compress", "ZSTD").orc(path)


def read_token_files(spark: SparkSession, path: str, id_column: str = "doc_id", only: list | None = None) -> DataFrame:
    """(id, ids) of the files; `only` is pushed to the scan, where stripe statistics and Bloom filters skip what can't match."""
    found = spark.read.orc(path).select(id_column, "ids")
    return found if only is None else found.where(F.col(id_column).isin(only))


def token_offsets(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files, start being the ids of all documents before it.

    Only counts are shuffled: sums within a file, then an offset per file; there is one row per file.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64()), batch.column(2), batch.column(3)], [id_column, "n_tokens", "ids_crc32", "file", "place"])

    source = spark.read.orc(path)
    kind = source.schema[id_column].dataType.simpleString()
    number = F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"part-(\d+)", 1).cast("int")
    rows = source.select(id_column, "ids", number.alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))
    rows = rows.mapInArrow(digest, f"`{id_column}` {kind}, n_tokens long, ids_crc32 long, file int, place struct<block:long,row:long>")
    rows = materialize(rows, "token-counts")
    within = Window.partitionBy("file").orderBy(F.col(id_column).asc_nulls_first(), "place")
    rows = rows.withColumn("sum_to", F.sum("n_tokens").over(within))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    files = files.select("file", (F.sum("in_file").over(Window.orderBy("file")) - F.col("in_file")).alias("before"))
    return rows.join(F.broadcast(files), "file").select(id_column, (F.col("before") + F.col("sum_to") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, files: int, id_column: str = "doc_id") -> DataFrame:
    """Write the token files of docs to the shared folder and return what `token_offsets` reads back from them."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, end_id, path, files, id_column)
    return token_offsets(docs.sparkSession, path, id_column)
