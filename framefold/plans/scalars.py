"""Queries over scalar rules: geometry, colours, text, times, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.functions import formats as T
from framefold.functions import geometry as G
from framefold.operators import frames as V
from framefold.plans.registry import CLEARS, FRAMES, query

VECTORS = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def e(k: int) -> Column:
    """Component k from 1."""
    return F.get(F.col("e"), F.lit(k - 1))


def rounded(digits: int, **columns: Column) -> list[Column]:
    return [F.round(c, digits).alias(n) for n, c in columns.items()]


@query(
    "f14_colours",
    """
    WITH p AS (SELECT vec_id, abs(e[1]) * 800 AS l, e[2] * 400 + 128 AS a, e[3] * 400 + 128 AS b, abs(e[4]) * 800 AS m, e[5] * 400 + 128 AS c, e[6] * 400 + 128 AS d FROM e),
    q AS (SELECT vec_id, sqrt((l - m) ** 2 + (a - c) ** 2 + (b - d) ** 2) AS distance, atan2(b - 128, a - 128) AS hue, atan2(d - 128, c - 128) AS other, sqrt((a - 128) ** 2 + (b - 128) ** 2) AS chroma, sqrt((c - 128) ** 2 + (d - 128) ** 2) AS chroma2 FROM p)
    SELECT vec_id, round(distance, 6) AS distance, round(hue, 6) AS hue, round(chroma, 6) AS chroma,
        round(CASE WHEN chroma >= 30 AND chroma2 >= 30 THEN 0.7 * distance + 0.3 * least(abs(hue - other), 2 * pi() - abs(hue - other)) / pi() * 120 ELSE distance END, 6) AS cost
    FROM q
    """,
    VECTORS,
)
def f14_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.abs(e(1)) * 800, e(2) * 400 + 128, e(3) * 400 + 128)
    b = F.array(F.abs(e(4)) * 800, e(5) * 400 + 128, e(6) * 400 + 128)
    return vectors(spark, sf_dir).select("vec_id", *rounded(6, distance=G.lab_distance(a, b), hue=G.hue_angle(a), chroma=G.chroma(a), cost=G.assign_cost(a, b, 0.3)))


@query(
    "f15_quads",
    """
    WITH p AS (SELECT vec_id, e[1] * 40 AS ax, e[2] * 40 AS ay, 100 + e[3] * 40 AS bx, e[4] * 40 AS by_, 100 + e[5] * 40 AS cx, 150 + e[6] * 400 AS cy, e[7] * 40 AS dx, 150 + e[8] * 400 AS dy FROM e),
    s AS (SELECT vec_id, (sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) + sqrt((cx - dx) ** 2 + (cy - dy) ** 2)) / 2 AS w, (sqrt((dx - ax) ** 2 + (dy - ay) ** 2) + sqrt((cx - bx) ** 2 + (cy - by_) ** 2)) / 2 AS h, (ax + bx + cx + dx) / 4 AS x, (ay + by_ + cy + dy) / 4 AS y FROM p)
    SELECT vec_id, round(w, 6) AS width, round(h, 6) AS height, round(h / greatest(w, 1e-6), 6) AS aspect, round(x, 6) AS centre_x, round(y, 6) AS centre_y,
        round(CASE WHEN h / w < 1.1 THEN greatest((h / w - 1.0) / 0.1, 0) WHEN h / w > 2.2 THEN greatest((2.6 - h / w) / 0.4, 0) ELSE 1 END, 6) AS score
    FROM s
    """,
    VECTORS,
)
def f15_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    quad = F.array(F.array(e(1) * 40, e(2) * 40), F.array(100 + e(3) * 40, e(4) * 40), F.array(100 + e(5) * 40, 150 + e(6) * 400), F.array(e(7) * 40, 150 + e(8) * 400))
    rows = vectors(spark, sf_dir).select("vec_id", quad.alias("quad"))
    q = F.col("quad")
    width, height = G.quad_sides(q)
    return rows.select("vec_id", *rounded(6, width=width, height=height, aspect=G.quad_aspect(q), centre_x=G.at(G.quad_centre(q), 0), centre_y=G.at(G.quad_centre(q), 1), score=G.aspect_score(G.quad_aspect(q))))


@query(
    "f16_rects",
    """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, (l_quantity - 20) * 0.5 AS x, (l_quantity - 20) * 0.25 AS y, l_linenumber * 1.5 AS w, l_linenumber * 0.5 AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(greatest(round_even(x, 0), 0) AS BIGINT) AS x0, CAST(greatest(round_even(y, 0), 0) AS BIGINT) AS y0,
        CAST(greatest(round_even(x + w, 0), greatest(round_even(x, 0), 0)) AS BIGINT) AS x1, CAST(greatest(round_even(y + h, 0), greatest(round_even(y, 0), 0)) AS BIGINT) AS y1,
        round(w * 3, 6) AS wide, round(greatest(abs(x - 3), abs(y - 4), abs(x + w - 8), abs(y + h - 10)), 6) AS far
    FROM r
    """,
)
def f16_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity") - 20, F.col("l_linenumber")
    rows = V.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.array(q * 0.5, q * 0.25, n * 1.5, n * 0.5).alias("r"))
    edge, r = G.bounds(F.col("r")), F.col("r")
    other = F.array(*map(F.lit, (3.0, 4.0, 5.0, 6.0)))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", *(G.at(edge, k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), *rounded(6, wide=G.at(G.scaled(r, F.lit(3.0), F.lit(2.0)), 2), far=G.box_distance(r, other)))


@query(
    "f11_matrices",
    """
    WITH m AS (SELECT vec_id, list_transform(range(1, 10), lambda i: e[i] + CASE WHEN i % 4 = 1 THEN 2 ELSE 0 END) AS m FROM e),
    c AS (SELECT *, m[5] * m[9] - m[6] * m[8] AS c1, m[4] * m[9] - m[6] * m[7] AS c2, m[4] * m[8] - m[5] * m[7] AS c3 FROM m),
    d AS (SELECT *, m[1] * c1 - m[2] * c2 + m[3] * c3 AS det FROM c)
    SELECT vec_id, round(m[1] * m[3] + m[2] * m[6] + m[3] * m[9], 6) AS product_13, round(-c2 / det, 6) AS inverse_21, round((m[1] * m[5] - m[2] * m[4]) / det, 6) AS inverse_33,
        round((m[1] * 3 + m[2] * 4 + m[3]) / (m[7] * 3 + m[8] * 4 + m[9]), 4) AS x, round((m[4] * 3 + m[5] * 4 + m[6]) / (m[7] * 3 + m[8] * 4 + m[9]), 4) AS y
    FROM d
    """,
    VECTORS,
)
def f11_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", F.array(*(e(k) + (2 if k % 4 == 1 else 0) for k in range(1, 10))).alias("m"))
    m = F.col("m")
    inverse, point = G.matrix_inverse(m), G.project(m, F.lit(3.0), F.lit(4.0))
    return rows.select("vec_id", *rounded(6, product_13=G.at(G.matrix_product(m, m), 2), inverse_21=G.at(inverse, 3), inverse_33=G.at(inverse, 8)), *rounded(4, x=G.at(point, 0), y=G.at(point, 1)))


@query(
    "p11_palette",
    """
    WITH p AS (SELECT [['#0058F8', '#3CBCFC'], ['#00A800', '#B8F818'], ['#D800CC', '#F878F8'], ['#0058F8', '#58D854'], ['#E40058', '#58F898'], ['#58F898', '#6888FC'], ['#F83800', '#7C7C7C'], ['#6844FC', '#A80020'], ['#0058F8', '#F83800'], ['#F83800', '#FC9838']] AS p)
    SELECT level, size, CASE WHEN size IN (2, 3) THEN p[level % 10 + 1][size - 1] ELSE '#FCFCFC' END AS colour, CASE WHEN size IN (2, 3) THEN (['#3CBCFC', '#F83800'])[size - 1] ELSE '#FCFCFC' END AS plain, count(*) AS n FROM clears, p GROUP BY ALL
    """,
    CLEARS,
)
def p11_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, cell = F.col("level"), F.col("size")
    rows = V.clears(spark, sf_dir).select("level", "size", G.cell_colour(level, cell).alias("colour"), G.cell_colour(F.lit(None).cast("long"), cell).alias("plain"))
    return rows.groupBy("level", "size", "colour", "plain").agg(F.count("*").alias("n"))


@query(
    "str_formats",
    """
    WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN p_size || 'x' || p_partkey WHEN 1 THEN ' ' || p_size || ' X' || p_partkey WHEN 2 THEN p_size || 'by' || p_partkey ELSE p_name END AS size_text,
        CASE p_partkey % 4 WHEN 0 THEN 'Writing (' || p_size || ' %) 9%' WHEN 1 THEN p_size || '.5%' WHEN 2 THEN 'no share' ELSE 'at' || p_size || '  % of 7' END AS share_text,
        CASE p_partkey % 4 WHEN 0 THEN 'v4l2:/dev/video' || p_size WHEN 1 THEN 'RTSP://host/' || p_size WHEN 2 THEN 'http://' ELSE p_name || '.mp4' END AS input, CASE p_partkey % 4 WHEN 0 THEN replace(p_brand, '#', '-') WHEN 1 THEN p_brand WHEN 2 THEN '.' || p_size ELSE p_size || '.1+b_' END AS token FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(size_text, '^\\s*\\d+\\s*[xX]\\s*\\d+\\s*$') THEN CAST(regexp_extract(size_text, '(\\d+)\\s*[xX]\\s*(\\d+)', 1) AS BIGINT) END AS w,
        round(CASE k WHEN 0 THEN p_size / 100 WHEN 1 THEN (p_size + 0.5) / 100 WHEN 3 THEN p_size / 100 END, 6) AS share, CASE k WHEN 0 THEN 'v4l2' WHEN 1 THEN 'stream' ELSE 'file' END AS kind,
        regexp_full_match(token, '[A-Za-z0-9+_-][A-Za-z0-9.+_-]{0,39}') AS safe, 'base/' || token AS topic, token = 'Brand-2' OR starts_with(token, '1') AND len(token) > 1 AND FALSE AS allowed
    FROM p
    """,
)
def str_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size, name, brand = (F.col(f"p_{c}") for c in ("partkey", "size", "name", "brand"))
    number = size.cast("string")

    def by_key(*values: Column) -> Column:
        return F.get(F.array(*values), (key % 4).cast("int"))

    text = F.concat_ws("x", number, key.cast("string"))
    rows = V.read(spark, sf_dir, "part").select(
        "p_partkey",
        by_key(text, F.concat(F.lit(" "), number, F.lit(" X"), key.cast("string")), F.concat_ws("by", number, key.cast("string")), name).alias("size_text"),
        by_key(F.concat(F.lit("Writing ("), number, F.lit(" %) 9%")), F.concat(number, F.lit(".5%")), F.lit("no share"), F.concat(F.lit("at"), number, F.lit("  % of 7"))).alias("share_text"),
        by_key(F.concat(F.lit("v4l2:/dev/video"), number), F.concat(F.lit("RTSP://host/"), number), F.lit("http://"), F.concat(name, F.lit(".mp4"))).alias("input"),
        by_key(F.replace(brand, F.lit("#"), F.lit("-")), brand, F.concat(F.lit("."), number), F.concat(number, F.lit(".1+b_"))).alias("token"),
    )
    token = F.col("token")
    return rows.select("p_partkey", T.size_of(F.col("size_text"))["w"].alias("w"), F.round(T.percent(F.col("share_text")), 6).alias("share"), T.input_kind(F.col("input")).alias("kind"), T.safe_token(token).alias("safe"), T.topic(F.lit("base"), token).alias("topic"), T.allowed(token, ("Brand-2",)).alias("allowed"))


@query(
    "date_formats",
    """
    SELECT o_orderkey, strftime(o_orderdate + to_milliseconds(o_orderkey % 86400000), '%Y-%m-%dT%H:%M:%S.%g') AS stamp, 'station-' || epoch_ms(o_orderdate + to_milliseconds(o_orderkey % 86400000)) AS game_id,
        strftime(o_orderdate + to_milliseconds(o_orderkey % 86400000), '%Y%m%d-%H%M%S') || printf('_g%03d', o_orderkey % 2000) AS part_name, CAST(round(greatest(o_totalprice / 1000 - 50, 0) * 1000) AS BIGINT) AS clock_ms
    FROM orders
    """,
)
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.timestamp_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400000).alias("ts"))
    ts = F.col("ts")
    return orders.select("o_orderkey", F.substring(T.stamp(ts), 1, 23).alias("stamp"), T.game_id(F.lit("station"), ts).alias("game_id"), T.part_name(ts, (F.col("o_orderkey") % 2000).cast("int")).alias("part_name"), T.clock_ms(F.col("o_totalprice") / 1000, F.lit(50.0)).alias("clock_ms"))


@query(
    "arr_boards",
    """
    WITH b AS (SELECT vec_id, list_transform(range(3), lambda r: list_transform(range(4), lambda c: (vec_id * 7 + r * 5 + c * 3) % 13)) AS g FROM embeddings),
    f AS (SELECT vec_id, g, list_transform(flatten(g), lambda x: least(x, 3)) AS f FROM b),
    u AS (SELECT *, [f[2], f[3], f[6], f[7]] AS v FROM f),
    m AS (SELECT *, CASE WHEN len(list_filter(v, lambda x: x = 1)) > 2 THEN 1 WHEN len(list_filter(v, lambda x: x = 2)) > 2 THEN 2 WHEN len(list_filter(v, lambda x: x = 3)) > 2 THEN 3 END AS m FROM u)
    SELECT vec_id, array_to_string(f, '') AS field, array_to_string(list_transform(g, lambda row: array_to_string(list_transform(row, lambda c: least(c, 9)), '')), '/') AS rows, array_to_string(f[5:8], '') AS second,
        array_to_string(list_transform(range(1, 13), lambda k: CASE WHEN k IN (2, 3, 6, 7) THEN 0 ELSE f[k] END), '') AS emptied, array_to_string(list_transform(range(1, 13), lambda k: CASE WHEN k IN (2, 3, 6, 7) THEN coalesce(m, f[k]) ELSE f[k] END), '') AS uniform
    FROM m
    """,
)
def arr_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: (F.col("vec_id") * 7 + r * 5 + c * 3) % 13))
    rows = V.read(spark, sf_dir, "embeddings").select("vec_id", grid.alias("g")).withColumn("f", T.flat_field(F.col("g")))
    joined = lambda a: F.array_join(a.cast("array<string>"), "")
    cells = F.array(*map(F.lit, (1, 2, 5, 6)))
    return rows.select("vec_id", joined(F.col("f")).alias("field"), F.array_join(T.digit_rows(F.col("g")), "/").alias("rows"), joined(F.get(T.grid_of(F.col("f"), 4), F.lit(1))).alias("second"), joined(T.without_cells(F.col("f"), cells)).alias("emptied"), joined(T.uniform_colour(F.col("f"), cells)).alias("uniform"))


@query(
    "map_counts",
    "SELECT game_id, nullif(count(*) FILTER (size = 1), 0) AS ones, nullif(count(*) FILTER (size = 4), 0) AS fours FROM clears GROUP BY 1",
    CLEARS,
)
def map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = V.clears(spark, sf_dir).groupBy("game_id", "size").agg(F.count("*").alias("n"))
    held = sizes.groupBy("game_id").agg(F.map_from_entries(F.collect_list(F.struct("size", "n"))).alias("counts"))  # four sizes at most
    return held.select("game_id", T.piece_of(F.col("counts"), F.lit(1).cast("long")).alias("ones"), T.piece_of(F.col("counts"), F.lit(4).cast("long")).alias("fours"))


@query(
    "json_compare",
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) = event_id % 100 AS same, TRUE AS both_lack, CASE WHEN value IS NULL THEN TRUE WHEN event_id % 2 = 0 THEN TRUE ELSE abs(value * 1e-6) <= 1e-9 * greatest(abs(value * (1 + 1e-6)), 1) END AS close FROM events
    """,
)
def json_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.concat(F.lit('{"k": '), (F.col("event_id") % 100).cast("string"), F.lit("}"))
    off = F.when(F.col("event_id") % 2 == 0, 1 + 1e-12).otherwise(1 + 1e-6)
    return V.read(spark, sf_dir, "events").select("event_id", T.same_at(F.col("props"), other, "$.k").alias("same"), T.same_at(F.col("props"), other, "$.none").alias("both_lack"), T.close(F.col("value"), F.col("value") * off).alias("close"))


@query("hash_sha256", "SELECT page_id, sha256(url) AS sha256 FROM pages")
def hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "pages").select("page_id", T.sha256_hex(F.col("url")).alias("sha256"))


@query(
    "k9_upload_outcomes",
    "WITH s AS (SELECT 200 + (o_orderkey * 37) % 320 AS status FROM orders) SELECT status, CASE WHEN status BETWEEN 200 AND 299 THEN 'done' WHEN status IN (400, 409, 413, 422) THEN 'drop' ELSE 'retry' END AS outcome, count(*) AS n FROM s GROUP BY ALL",
)
def k9_upload_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = 200 + (F.col("o_orderkey") * 37) % 320
    return V.read(spark, sf_dir, "orders").select(status.alias("status")).groupBy("status", T.upload_outcome(F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "p3_state_sets",
    """
    WITH b AS (SELECT *, lag(state) OVER (PARTITION BY stream_id ORDER BY seq) AS before FROM frames)
    SELECT stream_id, seq, state IN ('paused', 'level_select') AS holds_lock, coalesce(before IN ('in_game', 'paused'), FALSE) AS pauses, coalesce(before IN ('in_game', 'paused', 'game_over'), FALSE) AS falls, seq % 6 = 0 AS sampled, state = 'level_select' AS menu FROM b
    """,
    FRAMES,
)
def p3_state_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framefold.functions import rules
    from framefold.operators.states import before_state

    state, before = F.col("state"), F.col("before")
    return before_state(V.frames(spark, sf_dir)).select("stream_id", "seq", rules.is_lock_hold(state).alias("holds_lock"), rules.may_pause(before).alias("pauses"), rules.may_fall(before).alias("falls"), rules.is_sampled(F.col("seq")).alias("sampled"), rules.is_menu(state).alias("menu"))
