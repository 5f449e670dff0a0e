"""Small stores and feeds of a station: best games, spooled messages, reference ranges and commands."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Games that a store keeps, and messages sent at a time.
MOST_GAMES, BATCH = 2000, 32
GAME = "game_id string, player string, score long, lines long, level long, day date, stored_at timestamp"


def load_games(spark: SparkSession, path: str, schema: str = GAME) -> DataFrame:
    """The games of a store; none where it is missing or can't be read."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def kept_games(games: DataFrame, order: list[str], most: int = MOST_GAMES) -> DataFrame:
    """The newest games, as many as a store keeps."""
    return games.orderBy(*(F.desc(c) for c in order)).limit(most)


def save_games(games: DataFrame, path: str, order: list[str], most: int = MOST_GAMES) -> None:
    kept_games(games, order, most).write.mode("overwrite").json(path)


def spool_id(at: Column, number: Column) -> Column:
    """Ids that sort as their messages were made: milliseconds and a counter modulo a million."""
    return F.format_string("%013d-%06d", F.unix_millis(at), F.pmod(number, F.lit(1_000_000)))


def spooled(messages: DataFrame, most: int, station: str = "station") -> DataFrame:
    """Undelivered messages (station, id) with their place, oldest first; a full spool has lost its oldest ones. `batch` numbers the sendings."""
    newest = Window.partitionBy(station).orderBy(F.desc("id"))
    oldest = Window.partitionBy(station).orderBy("id")
    kept = messages.withColumn("__newest", F.row_number().over(newest)).where(F.col("__newest") <= most).drop("__newest")
    placed = kept.withColumn("place", F.row_number().over(oldest))
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / BATCH).cast("long"))


def reference_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(video, kind, start_s, end_s) of a JSON specification {video: [{kind, ranges: [[start, end]]}]}."""
    spec = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<struct<kind:string,ranges:array<array<double>>>>>").alias("m"))
    kinds = spec.select(F.explode("m").alias("video", "kinds")).select("video", F.explode("kinds").alias("k"))
    return kinds.select("video", "k.kind", F.explode("k.ranges").alias("r")).select("video", "kind", F.col("r")[0].alias("start_s"), F.col("r")[1].alias("end_s"))


def command_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Inbound commands, a JSON object a line, from files that appear in a folder; others are null."""
    os.makedirs(folder, exist_ok=True)
    return spark.readStream.text(folder).select(F.from_json("value", "target string, release string, version string, mode string").alias("command"))


def update_request(command: Column) -> Column:
    """(target, release, version, factory) of a command that may run; null for unknown targets, unsafe tokens and modes."""
    from framefold.functions.formats import safe_token

    mode = F.coalesce(command["mode"], F.lit(""))
    fine = command["target"].isin("station", "reader") & safe_token(command["release"]) & safe_token(command["version"]) & mode.isin("", "app", "factory")
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(command["target"].alias("target"), command["release"].alias("release"), command["version"].alias("version"), (mode == "factory").alias("factory")))
