"""Language-model scoring with a weighted backoff automaton over n-gram counts of the whole corpus.

The model is never gathered in one place. Documents are dealt to blocks. Each block counts its distinct n-grams and asks,
in packed arrays by key range, for their counts in the whole corpus; each key range is summed on one task, which answers
every block that asked. A block then builds the part of the automaton that its own texts can reach: a state for each
context seen in training, an arc for each n-gram seen in training, and a failure arc to the shorter context with the weight
mu / (c(context) + mu), from probabilities p(w | h) = (c(h w) + mu p(w | shorter h)) / (c(h) + mu) that add to one.

`Automaton.walk` is one traversal from left to right that carries the state and adds log10 weights. Many stretches of text
step at once; a stretch that doesn't begin its text first reads the tokens that a state can hold, which puts it in the state
that the stretch before ended in.

An n-gram is at most once in a block's request, so frequent words weigh no more than others, and what is exchanged grows
with the corpus; ranges that a block has no n-gram in get no message. Keys are 64-bit hashes of n-grams.

Defined cases: a null or empty text is one end token; repeated rows count and score each; without training rows all
scores are those of the uniform model; an empty table gives no rows; a null id belongs to the training part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.llm.common import blocks, dealt_key, even_keys, held_out, slices

ADDED = 0.1
ORDER = 2
MU = 100.0
#: Stands for a text's end, and for what comes before its first word; holds a space, so no word equals it.
END = b" end"
ROOT = 0
#: Bytes of text that are scored at a time.
PIECE = 1 << 22
#: Tokens of a stretch of text that steps beside others.
STRETCH = 512


class Grams:
    """The tokens of some texts and their distinct n-grams, sorted by key."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, order: int):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.take(pa.array(np.arange(len(texts))))  # a slice of its own
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
        lengths = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        which, text_of = coded.indices.to_numpy(), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        names = [w.encode() for w in coded.dictionary.to_pylist()]
        if b"" in names:  # white space at a text's edge
            keep = which != names.index(b"")
            which, text_of = which[keep], text_of[keep]
        counts = np.bincount(text_of, minlength=len(lengths))
        #: Where each text's tokens end in `tokens`; the end token is the last of each.
        self.ends = np.cumsum(counts + 1)
        self.starts = self.ends - counts - 1
        self.text_of = np.repeat(np.arange(len(lengths), dtype=np.int32), counts + 1)
        end = len(names)  # the end token
        self.tokens = np.full(len(which) + len(lengths), end, dtype=np.int32)
        is_word = np.ones(len(self.tokens), dtype=bool)
        is_word[self.ends - 1] = False
        self.tokens[is_word] = which
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names] + [xxhash.xxh3_64_intdigest(END)], dtype=np.uint64)
        #: For each order: the distinct keys, sorted, and for each token the place of its n-gram's key; -1 where a text is too short.
        self.keys: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        key = hashes[self.tokens]
        self.before_first = mixed(np.array([xxhash.xxh3_64_intdigest(END)], dtype=np.uint64))[0]
        found = mixed(key)
        for n in range(1, order + 1):
            if n > 1:
                shifted = np.concatenate((found[:1], found[:-1])) if len(found) else found
                if n == 2 and len(found):
                    shifted[self.starts] = self.before_first
                found = mixed(shifted * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64(n))
            whole = np.arange(len(found)) - self.starts[self.text_of] >= n - 2
            keys, at = np.unique(found[whole], return_inverse=True)
            places = np.full(len(found), -1, dtype=np.int32)
            places[whole] = at
            self.keys.append(keys)
            self.places.append(places)

    def counts(self, counted: np.ndarray) -> list[np.ndarray]:
        """How often each key stands in the texts that are counted."""
        use = counted[self.text_of]
        return [np.bincount(p[use & (p >= 0)], minlength=len(k)).astype(np.uint32) for k, p in zip(self.keys, self.places, strict=True)]


def pieces_of(rows: pa.Table, order: int) -> list[tuple[pa.RecordBatch, Grams]]:
    """The rows in order, about PIECE bytes of text at a time, with their n-grams: the automaton of a piece stays small."""
    return [(part, Grams(part.column("text"), order)) for batch in rows.to_batches() for part in slices(batch, "text", PIECE)]


def all_keys(pieces: list[tuple[pa.RecordBatch, Grams]], order: int) -> list[np.ndarray]:
    """The distinct keys of all pieces, sorted, for each order."""
    return [np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(g.keys[n] for _, g in pieces)])) for n in range(order)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Automaton:
    """The part of the model that some texts reach. State 0 is the root; other states stand for contexts seen in training."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], tokens: int, distinct: int, mu: float = MU):
        self.grams, self.order = grams, len(grams.keys)
        self.width = int(grams.tokens.max(initial=0)) + 1  # tokens that arcs are told apart by
        counts = [t.astype(np.float64) for t in totals]
        chance = (counts[0] + ADDED) / (tokens + ADDED * (distinct + 1))
        #: Log10 of the base probability of each distinct unigram.
        self.base = np.log10(chance)
        begins = np.concatenate(([1], 1 + np.cumsum([len(c) for c in counts])))  # states of contexts of n words from begins[n - 1] on
        states = int(begins[self.order - 1])
        self.fails, self.fail_weights = np.zeros(states, dtype=np.int64), np.zeros(states)
        of_token = np.zeros(self.width, dtype=np.int64)
        of_token[grams.tokens] = grams.places[0]
        self.root_weights = self.base[of_token]
        self.root_next = np.where(counts[0][of_token] > 0, 1 + of_token, ROOT) if self.order > 1 else np.zeros(self.width, dtype=np.int64)
        end = int(grams.tokens[grams.ends[0] - 1]) if len(grams.ends) else 0
        #: The state before a text's first token.
        self.start = int(self.root_next[end]) if len(grams.ends) else ROOT
        arcs, weights, targets = [], [], []
        for n in range(1, self.order):  # arcs of n-word contexts
            place, at = np.unique(grams.places[n], return_index=True)
            place, at = (place[1:], at[1:]) if len(place) and place[0] < 0 else (place, at)
            first = np.isin(at, grams.starts)  # here the context is the end token that stands before a text
            context = np.where(first, of_token[end], grams.places[n - 1][at - 1]) if n == 1 else grams.places[n - 1][at - 1]
            suffix, held = grams.places[n - 1][at], counts[n - 1][context]
            chance = np.where(held > 0, (counts[n] + mu * chance[suffix]) / (held + mu), chance[suffix])
            state = begins[n - 1] + context
            self.fail_weights[state] = np.log10(mu / (held + mu))
            seen = counts[n] > 0
            arcs.append((state * self.width + grams.tokens[at])[seen])
            weights.append(np.log10(chance)[seen])
            targets.append((begins[n] + place if n + 1 < self.order else begins[n - 1] + suffix)[seen])
            if n + 1 < self.order:
                self.fails[begins[n] + place] = begins[n - 1] + suffix
        every = np.concatenate(arcs) if arcs else np.zeros(0, dtype=np.int64)
        order = np.argsort(every)
        self.arcs = every[order]
        self.weights, self.targets = (np.concatenate(x)[order] if x else np.zeros(0) for x in (weights, targets))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the weights added on the way: an arc of the state, or of the first state along its failure arcs that has one."""
        state, weight = state.copy(), np.zeros(len(state))
        out = np.empty(len(state), dtype=np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            at_root = state[open_] == ROOT
            done = open_[at_root]
            out[done], weight[done] = self.root_next[token[done]], weight[done] + self.root_weights[token[done]]
            open_ = open_[~at_root]
            if not len(open_):
                break
            if not len(self.arcs):
                found = np.zeros(len(open_), dtype=bool)
            else:
                key = state[open_] * self.width + token[open_]
                at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                found = self.arcs[at] == key
                done, at = open_[found], at[found]
                out[done], weight[done] = self.targets[at], weight[done] + self.weights[at]
            open_ = open_[~found]
            weight[open_] += self.fail_weights[state[open_]]
            state[open_] = self.fails[state[open_]]
        return out, weight

    def walk(self, stretch: int = STRETCH) -> np.ndarray:
        """The log10 weight of each token, from left to right; a text's log10 probability is the sum of its own."""
        g = self.grams
        lengths = g.ends - g.starts
        times = -(-lengths // stretch)
        offset = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * stretch
        text = np.repeat(np.arange(len(times)), times)
        warm = np.minimum(offset, self.order - 1)  # tokens that are read for the state alone
        begin = g.starts[text] + offset - warm
        size = np.minimum(lengths[text] - offset, stretch) + warm
        longest = np.argsort(-size, kind="stable")
        begin, size, warm = begin[longest], size[longest], warm[longest]
        # a stretch that reads from its text's first token on starts in the state before that
        state = np.where(begin == g.starts[text][longest], self.start, ROOT)
        out = np.zeros(len(g.tokens))
        for t in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -t, side="left"))
            state, weight = self.step(state[:m], g.tokens[begin[:m] + t])
            own = t >= warm[:m]
            out[begin[:m][own] + t] = weight[own]
        return out


def score(docs: DataFrame, folds: int = 10, fold: int = 0, order: int = ORDER, mu: float = MU, id_column: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows outside the fold."""
    spark = docs.sparkSession
    parts = blocks(spark)
    keys = even_keys(spark, parts)
    kind = docs.schema[id_column].dataType.simpleString()
    dealt = docs.select(F.col(id_column).alias("id"), "text", held_out(id_column, folds, fold).alias("held_out"), dealt_key(F.xxhash64(F.col(id_column), "text"), keys).alias("block")).repartition(parts, "block")
    edges = np.array([(1 << 64) * k // parts for k in range(1, parts)], dtype=np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        for block in rows.column("block").unique().to_pylist():
            own = rows.filter(pc.equal(rows.column("block"), block))
            grams = Grams(own.column("text"), order)
            every, counts = grams.keys, grams.counts(~own.column("held_out").to_numpy())
            cuts = [np.concatenate(([0], np.searchsorted(k, edges), [len(k)])) for k in every]
            for s in range(parts):
                if not any(c[s + 1] > c[s] for c in cuts):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[s]], pa.int32()), pa.array([block], pa.int32()), pa.array([[k[c[s] : c[s + 1]].tobytes() for k, c in zip(every, cuts, strict=True)]], pa.list_(pa.binary())), pa.array([[k[c[s] : c[s + 1]].tobytes() for k, c in zip(counts, cuts, strict=True)]], pa.list_(pa.binary()))],
                    ["shard", "block", "keys", "counts"],
                )

    asked = dealt.mapInArrow(ask, "shard int, block int, keys array<binary>, counts array<binary>")
    shard_at = {k: n for n, k in enumerate(keys)}

    def answer(rows: pa.Table) -> pa.Table:
        block, shard = rows.column("block").to_pylist(), shard_at[rows.column("shard")[0].as_py()]
        asked_keys, asked_counts = rows.column("keys").to_pylist(), rows.column("counts").to_pylist()
        replies: list[list[bytes]] = [[] for _ in block]
        for n in range(order):
            wanted = [np.frombuffer(k[n], dtype=np.uint64) for k in asked_keys]
            all_keys, which = np.unique(np.concatenate(wanted), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate([np.frombuffer(c[n], dtype=np.uint32) for c in asked_counts]), minlength=len(all_keys)).astype(np.uint64)
            at = 0
            for k, own in enumerate(wanted):
                replies[k].append(total[which[at : at + len(own)]].tobytes())
                at += len(own)
        return pa.table({"block": pa.array(block, pa.int32()), "shard": pa.array([shard] * len(block), pa.int32()), "totals": pa.array(replies, pa.list_(pa.binary()))})

    def sizes(rows: pa.Table) -> pa.Table:
        """Tokens and distinct words of a key range."""
        found = np.concatenate([np.frombuffer(k[0], dtype=np.uint64) for k in rows.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(c[0], dtype=np.uint32) for c in rows.column("counts").to_pylist()])
        return pa.table({"tokens": [int(counts.sum(dtype=np.int64))], "distinct": [len(np.unique(found[counts > 0]))]})

    by_shard = asked.groupBy("shard")
    corpus = by_shard.applyInArrow(sizes, "tokens long, distinct long").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"))
    answers = by_shard.applyInArrow(answer, "block int, shard int, totals array<binary>").select("*", corpus.select("tokens").scalar().alias("tokens"), corpus.select("distinct").scalar().alias("distinct"))

    def judge(own: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("shard")
        said = replies.column("totals").to_pylist()
        totals = [np.concatenate([np.frombuffer(x[n], dtype=np.uint64) for x in said]) for n in range(order)]
        tokens, distinct = replies.column("tokens")[0].as_py(), replies.column("distinct")[0].as_py()
        pieces = pieces_of(own, order)
        every, out = all_keys(pieces, order), []
        for part, grams in pieces:
            known = [totals[n][np.searchsorted(every[n], k)] for n, k in enumerate(grams.keys)]
            automaton = Automaton(grams, known, tokens, distinct, mu)
            add = lambda x, g=grams: np.add.reduceat(x, g.starts)
            columns = {
                "n_tokens": pa.array(grams.ends - grams.starts),
                "n_known": pa.array(add((known[0][grams.places[0]] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(grams.ends), tokens, dtype=np.int64)),
                "base_score": pa.array(add(automaton.base[grams.places[0]])),
                "score": pa.array(add(automaton.walk())),
            }
            out.append(pa.table({id_column: part.column("id"), "held_out": part.column("held_out"), **columns}))
        return pa.concat_tables(out)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, f"`{id_column}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
