"""Every operator and stage over nulls, empty and long texts, repeated rows, empty tables and clashing columns."""


import corpus_pipeline
import public_tokenizers
import pytest

from framefold.llm import images, language, licenses, lm, packing, repeats, simhash, tokens, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "score double, held_out string, fp string, block string, component string, rank int, id string, bin_id string, words string"
LONG = "the quick brown fox jumps over the lazy dog again and again " * 20000


def messy(spark, extra=False, empty=False):
    passage = " ".join(f"word{k} wanders" for k in range(40))
    rows = [
        (1, "The cat sat on the mat and looked at the moon, the moon looked back.", "en", "a", 10),
        (2, None, "en", None, None),
        (3, "", None, "a", 0),
        (4, "  \n\t ", "en", "b", 5),
        (5, LONG, "en", "a", len(LONG)),
        (6, "Der Hund läuft über die Straße und bellt, weil er müde ist.", "de", "b", 60),
        (6, "Der Hund läuft über die Straße und bellt, weil er müde ist.", "de", "b", 60),
        (7, "Der Hund läuft über die Straße und bellt, weil er müde ist.", "de", None, 60),
        (None, "Released under the MIT License. Le chat est sur la table.", "fr", "c", 1),
        (None, None, None, None, None),
        (8, f"before it {passage} after it", "en", "c", 1),
        (9, f"something else here {passage} and more", "en", "c", 1),
        (9, "another row of the same id", "en", "c", 1),
        (10, "🙂 \x00 ÉÀ 12345 <|endoftext|> ñ", None, "d", 1),
    ]
    frame = spark.createDataFrame([] if empty else rows, SCHEMA)
    if extra:
        for c in CLASHING.split(", "):
            name, kind = c.split()
            frame = frame.selectExpr("*", f"cast(null as {kind}) as {name}")
    return frame


OPERATORS = {
    "repeats": lambda d: repeats.find_repeats(d),
    "cut": lambda d: repeats.cut_repeats(d),
    "lm": lambda d: lm.score(d),
    "lm3": lambda d: lm.score(d, order=3),
    "tokens": lambda d: tokens.token_files(d, public_tokenizers.path("word_bpe_49k.json"), 2, 3),
    "bpe": lambda d: tokens.encode_and_decode(d, public_tokenizers.path("byte_bpe_50k.json")),
    "simhash": lambda d: simhash.near_copies(d),
    "keep_one": lambda d: simhash.keep_one(d),
    "language": lambda d: language.predict(d, language.training_rows(d)),
    "keep_known": lambda d: language.keep_known(d, language.training_rows(d)),
    "packing": lambda d: packing.pack(d),
    "licenses": lambda d: licenses.scan_licenses(d),
}
#: Operators that give a row for every row of the input.
WHOLE = ("cut", "lm", "lm3", "tokens", "bpe", "simhash", "language", "licenses")


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("kind", ["plain", "extra", "empty"])
def test_defined_everywhere(spark, name, kind):
    docs = messy(spark, extra=kind == "extra", empty=kind == "empty")
    rows = OPERATORS[name](docs).collect()
    assert kind != "empty" or rows == []
    if name in WHOLE and kind != "empty":
        assert len(rows) == 14
    if name in ("cut", "keep_one", "keep_known"):
        assert OPERATORS[name](docs).columns == docs.columns


@pytest.mark.parametrize("kind", ["plain", "extra", "empty"])
def test_stages_keep_columns(spark, tmp_path, kind):
    docs = messy(spark, extra=kind == "extra", empty=kind == "empty")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
    assert (docs.count() == 0) == (kind == "empty")


def test_stage_order_and_sql():
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None


def test_top_k_defined(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (20, [0.5, 1.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [0.5, 1.0]), (6, [0.5, 1.0]), (None, [9.0, 9.0]), (40, [-1.0, 0.0, 3.0]), (7, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame, frame.where("vec_id % 20 = 0"), k=3).collect()}
    q0, q20 = (64, 32), (32, 64)
    cross = q0[0] * q20[0] + q0[1] * q20[1]
    assert got == {(0, 1): (6, cross), (0, 2): (6, cross), (0, 3): (20, cross), (20, 1): (6, 32 * 32 + 64 * 64), (20, 2): (6, 32 * 32 + 64 * 64), (20, 3): (0, cross), (40, 1): (7, 0), (40, 2): (6, -32 * 64), (40, 3): (6, -32 * 64)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, score long, rank int")
    assert topk.top_k(empty, empty).collect() == []


def test_images_defined(spark):
    flat = bytes([7]) * (96 * 96)
    rows = [(1, 96, 96, flat), (2, 96, 96, flat), (3, 96, 96, None), (4, 96, 96, b"12"), (None, 96, 96, flat), (5, None, 3, b"123"), (6, 2, 2, b"1234"), (1, 96, 96, flat)]
    frame = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")
    got = {r["image_id"]: r["class_id"] for r in images.image_copies(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert images.image_copies(frame.limit(0)).collect() == []


