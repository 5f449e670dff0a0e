"""Near duplicates that candidates by fingerprints left out: every pair at 0.8 counts, however the copies were made."""

import os
import random
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from framefold.llm import common, components, simhash


def classes(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component"] for r in simhash.near_duplicates(frame).collect()}


def plain(texts):
    """The least id of each text's class, from all pairs."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if root[a] != root[b] and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(5, len(words) - 5), n):
        out[k] = f"edit{rng.randrange(10**9)}"
    return " ".join(out)


def test_copies_are_linked_through_their_original(spark):
    rng = random.Random(11)
    texts = []
    for t in range(3):
        words = [f"t{t}w{rng.randrange(3000)}" for _ in range(200)]
        texts += [*(edited(rng, words, 4) for _ in range(60)), " ".join(words)]
    want = plain(texts)
    assert len(set(want.values())) < 20
    assert classes(spark, texts) == want


@pytest.mark.parametrize("share", [0.1, 0.2])
def test_appended_prepended_and_truncated_copies(spark, share):
    rng = random.Random(12)
    texts = []
    for t in range(40):
        words = [f"v{rng.randrange(50000)}" for _ in range(rng.choice([50, 200, 1000]))]
        more = [f"v{rng.randrange(50000)}" for _ in range(int(share * len(words)))]
        texts += [" ".join(words), " ".join([words + more, more + words, words[: len(words) - len(more)]][t % 3])]
    want = plain(texts)
    assert sum(want[k] != k for k in want) >= 26
    assert classes(spark, texts) == want


def test_long_lists_leave_no_pair_out():
    """Whatever the order and classes, first pairs and the rest cover every pair of a list, but those of one class."""
    rng = np.random.default_rng(13)
    lists = {key: np.sort(rng.choice(np.arange(1, 400), n, replace=False)) for key, n in enumerate((1, 2, 5, 8, 9, 60, 200))}
    size = lambda node: 100 + node % 40
    rows = np.concatenate([np.stack([np.full(len(x), key), x, size(x), x % 7]) for key, x in lists.items()], axis=1)
    batch = pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), *(pa.array(r) for r in rows[1:]), pa.array(rows[2])], ["key", "node", "size", "common", "left"])
    want = {(a, b) for x in lists.values() for a, b in combinations(x.tolist(), 2) if 5 * min(size(a), size(b)) >= 4 * max(size(a), size(b))}
    for step in (1, 7, 1000):
        out = [r for b in simhash.first_pairs(batch.slice(k, step) for k in range(0, batch.num_rows, step)) for r in b.to_pylist()]
        first = {(r["a"], r["b"]) for r in out if r["list"] is None}
        long = sorted({(r["list"], size(r["a"]), r["a"]) for r in out if r["list"] is not None})
        assert first <= want and {n for _, _, n in long} == set(lists[4]) | set(lists[5]) | set(lists[6])
        group = {n: n % 3 for _, _, n in long}
        members = pa.table({"list": [r[0] for r in long], "node": [r[2] for r in long], "class": [group[r[2]] for r in long], "size": [r[1] for r in long], "left": [r[1] for r in long], "p": [0] * len(long), "q": [0] * len(long)})
        rest = {(r["a"], r["b"]) for b in simhash.rest_of_pairs(iter(members.to_batches(max_chunksize=step))) for r in b.to_pylist()}
        assert rest <= want and all(p in first or p in rest or group[p[0]] == group[p[1]] for p in want)


def test_texts_over_one_set_of_words(spark):
    """A chain of texts of equal word sets, each like its neighbours alone, stays whole."""
    rng = random.Random(14)
    words = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(40):
        k = rng.randrange(5, 190)
        words[k], words[k + 1] = words[k + 1], words[k]
        k = rng.randrange(5, 190)
        words[k], words[k + 1] = words[k + 1], words[k]
        texts.append(" ".join(words))
    rng.shuffle(texts)
    want = plain(texts)
    assert set(want.values()) == {0}
    assert classes(spark, texts) == want


def test_one_row_stays_of_fingerprint_and_content_classes(spark):
    """Links by fingerprint count beside those by content, and classes join through both."""
    rng = random.Random(15)
    tail = lambda n: [f"tail{rng.randrange(10**9)}" for _ in range(n)]
    phrase = [f"p{k}" for k in range(9)] * 60
    first, second = phrase + tail(40), phrase + tail(40)
    third = second[:-2] + tail(2)
    texts = [" ".join(x) for x in (first, second, third, tail(200))]
    bits = [simhash.fingerprint(t) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= simhash.MOST_BITS < (bits[0] ^ bits[3]).bit_count()
    assert plain(texts[:2]) == {0: 0, 1: 1} and classes(spark, texts)[1] == 1
    frame = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    assert {r["doc_id"]: r["component"] for r in simhash.joint_classes(frame).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(frame).collect()]
    assert sorted(kept, key=str) == sorted([(0, texts[0]), (3, texts[3]), (None, texts[0])], key=str)


def test_tables_and_shuffle_files_go_once_they_are_read(spark, monkeypatch):
    """Disk holds what is still to be read: a step's shuffle files go with the step, a large table with the last step that reads it."""
    folder = common.shared_folder(spark).removeprefix("file:")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for d in blocks.localDirs() for _, _, files in os.walk(d.getPath()) for f in files if f.endswith(".data")}
    tables, files, steps = set(os.listdir(folder)), shuffled(), []

    def step(df, label):
        out = common.materialize(df, label)
        steps.append((label, {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - tables}))
        return out

    for module in (simhash, components):
        monkeypatch.setattr(module, "materialize", step)
    rng = random.Random(16)
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [*(edited(rng, words, 4) for _ in range(60)), " ".join(words)]
    out = simhash.joint_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for _ in range(100):  # files are deleted beside the work
        if not (left := shuffled() - files):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.SHUFFLE_CLEANUP, None) is None
    assert {r["doc_id"]: r["component"] for r in out.collect()} == plain(texts)
    assert [label for label, _ in steps].count("sets") == 2
    assert all("contents" not in there for label, there in steps if label in ("first", "judged", "sets"))
    assert all(not there & {"judged", "sets"} for label, there in steps if label == "near-duplicates")
