"""Views of the driver's tables as game telemetry: frames, games, clears, glyphs, labelled segments and sessions.

Each view is a projection or a window, so filters and column choice reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framefold.functions.rules import PIECES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """A timestamp as seconds with fraction."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def in_order() -> Window:
    return Window.partitionBy("stream_id").orderBy("seq")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event: a stream for each user, in order of time.

    state from the event type, conf from the properties, gain from the value; score and lines rise, while raw_score is
    the noisy reading; piece cycles through the pieces and is null for one event in eleven.
    """
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gain = F.floor(F.coalesce("value", F.lit(0.0)))
    state = (
        F.when(F.col("event_type").isin("click", "view"), "in_game")
        .when(F.col("event_type") == "purchase", "paused")
        .when(F.col("event_type") == "signup", "level_select")
        .otherwise("unknown")
    )
    piece = F.when(F.col("event_id") % 11 != 0, F.element_at(F.array(*map(F.lit, PIECES)), (F.col("event_id") % 7 + 1).cast("int")))
    return e.select(
        F.col("user_id").alias("stream_id"),
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        seconds(F.col("ts")).alias("ts"),
        state.alias("state"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("conf"),
        gain.cast("long").alias("raw_score"),
        F.sum(gain).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("score"),
        F.sum((F.col("event_id") % 5 == 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lines"),
        piece.alias("piece"),
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game per order: its score, day, player and station."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
        .join(nations, customers["c_nationkey"] == nations["n_nationkey"])
        .select(
            F.col("o_orderkey").alias("game_id"),
            F.round("o_totalprice", 2).alias("score"),
            F.to_date("o_orderdate").alias("day"),
            F.col("c_name").alias("player"),
            F.col("n_name").alias("station"),
            F.col("o_orderstatus").alias("status"),
        )
    )


def clears(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line clear per line item: a game for each order, size 1 to 4 and level 0 to 19."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        ((F.col("l_linenumber") - 1) % 4 + 1).cast("long").alias("size"),
        (F.col("l_partkey") % 20).cast("long").alias("level"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 patch per vector, with its label."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("patch"))
