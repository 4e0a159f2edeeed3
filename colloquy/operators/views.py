"""What readers of meetings and speakers get: nested rows, texts of times, defaults and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lens import PRINTS, SPEAKERS, TIMED, speakers, table, timed_segments, voice_prints

#: Modes of a meeting, the first being what anything unknown becomes.
MODES = ["work", "interview", "study", "talk"]


def iso(at: Column) -> Column:
    """A time as ISO text, null as null."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def duration_text(started: Column, ended: Column) -> Column:
    """Whole seconds between two times as text; nothing where one is missing."""
    seconds = F.unix_micros(ended.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.coalesce(F.floor(seconds / 1_000_000).cast("long").cast("string"), F.lit(""))


def known_or_first(value: Column, known: list[str] = MODES) -> Column:
    """One of ``known``, else the first of them; null too."""
    return F.when(value.isin(known), value).otherwise(known[0])


def with_speaker(segments: DataFrame, people: DataFrame) -> DataFrame:
    """Segments with their speaker as a struct (id, name, is_self), null where there is none or not any more."""
    named = people.select(F.col("id").alias("of_speaker"), F.struct("id", "name", "is_self").alias("speaker"))
    return segments.join(named, F.col("speaker_id") == F.col("of_speaker"), "left").drop("of_speaker")


def with_prints(people: DataFrame, prints: DataFrame, *fields: str) -> DataFrame:
    """Speakers with their prints as a list of structs (id and ``fields``) by id; an empty list for none.

    Prints are gathered per speaker before the join; a print is a few numbers here, its vector stays in its table.
    """
    held = prints.groupBy(F.col("speaker_id").alias("of_speaker")).agg(F.array_sort(F.collect_list(F.struct("id", *fields))).alias("prints"))
    empty = F.array().cast(held.schema["prints"].dataType)
    return people.join(held, F.col("id") == F.col("of_speaker"), "left").drop("of_speaker").withColumn("prints", F.coalesce("prints", empty))


def listing(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key its distinct values in order: the dictionary of lists."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def any_row(rows: DataFrame, condition: Column) -> DataFrame:
    """One row ``found``: whether any row meets the condition. Reading stops at the first one."""
    return rows.filter(condition).select(F.lit(True).alias("found")).limit(1).agg((F.count("*") > 0).alias("found"))


def without(values: Column, gone: Column) -> Column:
    """A list less one value; null lists stay null."""
    return F.array_remove(values, gone)


def hundredths(micros: Column) -> Column:
    """Seconds to 2 places, rounded as whole numbers are."""
    return F.round(micros / 1e4) / 100


def segment_view(segments: DataFrame, people: DataFrame) -> DataFrame:
    """Segments as clients read them: times to 2 places, similarity to 3 where known, the speaker as JSON or null."""
    rows = with_speaker(segments, people)
    return rows.select("meeting_id", "id", hundredths(F.col("start_us")).alias("start_s"), hundredths(F.col("end_us")).alias("end_s"), "channel", F.round("similarity", 3).alias("similarity"), F.to_json("speaker").alias("speaker"))


def _segments(spark, d):
    """Times from the first day on, so that seconds keep their decimals."""
    zero = 1_704_067_200_000_000
    known = F.when(F.col("id") % 4 != 0, F.col("energy") / 1000)
    return timed_segments(spark, d).withColumns({"start_us": F.col("start_us") - zero, "end_us": F.col("end_us") - zero, "similarity": known})


def _meetings(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_orderkey % 9000)")).alias("ended_at"), "o_orderpriority")
    mode = F.lower(F.element_at(F.split("o_orderpriority", "-"), -1))
    return rows.select("meeting_id", iso(F.col("started_at")).alias("started_at"), iso(F.col("ended_at")).alias("ended_at"), duration_text(F.col("started_at"), F.col("ended_at")).alias("seconds"), known_or_first(mode, ["medium", "low", "high"]).alias("mode"))


QUERIES = {
    "segment_view": lambda s, d: segment_view(_segments(s, d), speakers(s, d)),
    "speaker_prints": lambda s, d: with_prints(speakers(s, d), voice_prints(s, d).withColumn("dims", F.size("centroid"))).select("id", "name", F.to_json(F.transform("prints", lambda p: p["id"])).alias("prints")),
    "meeting_view": _meetings,
    "live_probe": lambda s, d: any_row(table(s, d, "orders"), F.col("o_orderstatus") == "P"),
    "prints_by_speaker": lambda s, d: listing(voice_prints(s, d), "speaker_id", "id").select("speaker_id", F.array_join("values", ",").alias("prints")),
    "prints_kept": lambda s, d: listing(voice_prints(s, d), "speaker_id", "id").select("speaker_id", F.array_join(without(F.col("values"), F.get("values", F.lit(0))), ",").alias("prints")),
    "model_names": lambda s, d: table(s, d, "part").select(F.lower("p_type").alias("model")).distinct().orderBy("model"),
}
_ZERO = 1_704_067_200_000_000
SQL = {
    "segment_view": f"""SELECT t.meeting_id, t.id, round((start_us - {_ZERO}) / 1e4) / 100 AS start_s, round((end_us - {_ZERO}) / 1e4) / 100 AS end_s, channel, round(CASE WHEN t.id % 4 <> 0 THEN energy / 1000 END, 3) AS similarity,
      CASE WHEN s.id IS NOT NULL THEN '{{"id":' || s.id || ',"name":"' || s.name || '","is_self":' || s.is_self || '}}' END AS speaker FROM {TIMED} t LEFT JOIN {SPEAKERS} s ON t.speaker_id = s.id""",
    "speaker_prints": f"SELECT s.id, s.name, '[' || coalesce((SELECT string_agg(p.id, ',' ORDER BY p.id) FROM {PRINTS} p WHERE p.speaker_id = s.id), '') || ']' AS prints FROM {SPEAKERS} s",
    "meeting_view": """SELECT o_orderkey AS meeting_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS started_at, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + to_seconds(o_orderkey % 9000), '%Y-%m-%dT%H:%M:%S') END AS ended_at,
      CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 9000)::VARCHAR ELSE '' END AS seconds, CASE WHEN lower(split_part(o_orderpriority, '-', -1)) IN ('medium', 'low', 'high') THEN lower(split_part(o_orderpriority, '-', -1)) ELSE 'medium' END AS mode FROM orders""",
    "live_probe": "SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS found",
    "prints_by_speaker": f"SELECT speaker_id, string_agg(id, ',' ORDER BY id) AS prints FROM {PRINTS} GROUP BY speaker_id",
    "prints_kept": f"SELECT speaker_id, coalesce(string_agg(id, ',' ORDER BY id) FILTER (i > 1), '') AS prints FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY id) AS i FROM {PRINTS}) GROUP BY speaker_id",
    "model_names": "SELECT DISTINCT lower(p_type) AS model FROM part",
}
