"""The synthetic tables read as the engine's tables: segments, transcripts, speakers and voice prints.

Times are whole microseconds; they become seconds on output only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, meeting_id, speaker_id (null: not attributed), channel, start_us, dur_us, end_us, energy."""
    kind = F.col("event_type")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("meeting_id"),
        F.when(kind != "error", F.col("user_id") % 3).alias("speaker_id"),
        F.when(kind.isin("click", "view"), "mic").when(kind == "error", "mixed").otherwise("system").alias("channel"),
        start.alias("start_us"),
        F.round(F.col("value") * 10000).cast("long").alias("dur_us"),
        (start + F.round(F.col("value") * 10000).cast("long")).alias("end_us"),
        F.col("value").alias("energy"),
    )


TIMED = """(SELECT event_id AS id, date_diff('day', DATE '2024-01-01', ts::DATE) AS meeting_id,
  CASE WHEN event_type <> 'error' THEN user_id % 3 END AS speaker_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'mic' WHEN event_type = 'error' THEN 'mixed' ELSE 'system' END AS channel,
  epoch_us(ts) AS start_us, CAST(round(value * 10000) AS BIGINT) AS dur_us,
  epoch_us(ts) + CAST(round(value * 10000) AS BIGINT) AS end_us, value AS energy FROM events)"""


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, id (turn), speaker, start_s, text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("id"), F.col("role").alias("speaker"), F.col("turn").cast("double").alias("start_s"), "text")


SPOKEN = "(SELECT conv_id AS meeting_id, turn AS id, role AS speaker, CAST(turn AS DOUBLE) AS start_s, text FROM conversations)"


def voice_prints(spark: SparkSession, sf_dir: str, kind: str = "double") -> DataFrame:
    """id, speaker_id, centroid as doubles, or as floats, as which it is stored."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("speaker_id"), F.col("embedding").cast(f"array<{kind}>").alias("centroid"))


PRINTS = "(SELECT vec_id AS id, CAST(label AS BIGINT) AS speaker_id, CAST(embedding AS DOUBLE[]) AS centroid FROM embeddings)"


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name (every other one by default from the id), is_self."""
    default = F.concat(F.lit("Speaker "), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, default).otherwise(F.col("s_name")).alias("name"), (F.col("s_suppkey") == 3).alias("is_self"))


SPEAKERS = "(SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Speaker ' || s_suppkey ELSE s_name END AS name, s_suppkey = 3 AS is_self FROM supplier)"
