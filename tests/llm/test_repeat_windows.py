"""Repeats that single first places of chunks left out."""

import random

from framefold.llm import repeats


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in repeats.find_repeats(frame).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert texts[r["first_doc_id"]].split()[r["first_start_word"] :][: r["n_words"]] == texts[r["doc_id"]].split()[r["start_word"] :][: r["n_words"]]
    return got


def plain(texts):
    """The words of each text that lie in 50 words of an earlier one."""
    seen, covered = set(), {}
    for d, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        if hit := {k + i for k, x in enumerate(windows) if x in seen for i in range(50)}:
            covered[d] = hit
        seen.update(windows)
    return covered


def own(rng, n):
    return [f"own{rng.randrange(10**9)}" for _ in range(n)]


def test_passages_of_which_earlier_documents_hold_parts(spark):
    rng = random.Random(21)
    texts = []
    for p in range(30):
        passage = [f"p{p}w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join([*own(rng, 20), *x, *own(rng, 20)]) for x in (passage[:40], passage[20:], passage, passage)]
    want = plain(texts)
    assert len(want) == 30 and found(spark, texts) == want


def test_pieces_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    rng = random.Random(22)
    for longest in (3, 40, 900):
        text = " ".join("x" * rng.randint(1, longest) for _ in range(700)).encode()
        starts = [0, *(k + 1 for k in range(len(text)) if text[k] == 32)]
        ends = [*(k - 1 for k in starts[1:]), len(text)]
        for least in (2, 50):
            windows = [(starts[k], ends[k + least - 1]) for k in range(len(starts) - least + 1)]
            spans = list(repeats.pieces(text, least))
            assert len(spans) > 1 and all(sum(a <= x and y <= b for a, b in spans) == 1 for x, y in windows)


def test_passages_of_few_bytes_and_of_one_pattern(spark):
    rng = random.Random(23)
    texts = []
    for n in (50, 50, 55, 60):
        for digits in (10, 100):
            for _ in range(6):
                passage = [str(rng.randrange(digits)) for _ in range(n)]
                texts += [" ".join([*own(rng, 20), *passage, *own(rng, 20)]) for _ in range(2)]
    texts += [" ".join([*own(rng, 20), *["la", "le", "lu"] * n, *own(rng, 20)]) for n in (17, 100, 30)]
    want = plain(texts)
    assert len(want) == 50 and found(spark, texts) == want
