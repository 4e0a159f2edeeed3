"""Meetings, speakers and segments: counts, directories and ordered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lens import SPEAKERS, SPOKEN, TIMED, speakers, table, timed_segments, transcript

UNKNOWN = "unknown"


def with_child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, to: str) -> DataFrame:
    """``parents`` with the number of their children, 0 for none. Children are counted before the join."""
    counts = children.groupBy(F.col(child_key).alias("_key")).agg(F.count("*").alias(to))
    joined = parents.join(counts, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(to, F.coalesce(F.col(to), F.lit(0)).cast("long"))


def truthy(text: Column) -> Column:
    """False for null and for the empty text."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def or_unknown(name: Column) -> Column:
    return F.coalesce(name, F.lit(UNKNOWN))


def segments_by_ids(segments: DataFrame, meeting_id: int, ids: list[int]) -> DataFrame:
    """A meeting's segments among ``ids``, in its order; no id, no rows."""
    wanted = segments.filter(F.col("meeting_id") == meeting_id)
    return (wanted.filter(F.col("id").isin(ids)) if ids else wanted.limit(0)).orderBy("start_s", "id")


def participants(segments: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Per meeting, "name (n)" of its speakers by falling count; ties by first appearance. Homonyms count as one."""
    named = segments.withColumn("_name", or_unknown(F.col(name)))
    counts = named.groupBy("meeting_id", "_name").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", F.format_string("%s (%d)", "_name", "n").alias("item"))))
    return counts.groupBy("meeting_id").agg(F.array_join(F.transform(items, lambda x: x["item"]), ", ").alias("participants"))


def directory(segments: DataFrame, prints: DataFrame, speakers: DataFrame) -> DataFrame:
    """Speakers with distinct meetings, segments and prints; each counted on its own side, so no join multiplies rows."""
    spoken = segments.groupBy("speaker_id").agg(F.count_distinct("meeting_id").alias("meetings"), F.count("*").alias("segments"))
    held = prints.groupBy("speaker_id").agg(F.count("*").alias("prints"), F.min("id").alias("first_print"))
    joined = speakers.join(spoken, "speaker_id", "left").join(held, "speaker_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("speaker_id", "is_self", zero("meetings"), zero("segments"), zero("prints"), "first_print").orderBy(F.desc("is_self"), "speaker_id")


def _meeting_overview(spark, d):
    meetings = table(spark, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderdate").alias("started_at"), truthy(F.col("o_orderpriority")).alias("has_summary"))
    return with_child_counts(meetings, table(spark, d, "lineitem"), "meeting_id", "l_orderkey", "segments").orderBy(F.desc("started_at"), "meeting_id")


def _child_counts(spark, d):
    return with_child_counts(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "doc_id", "labels")


def _directory(spark, d):
    segments = timed_segments(spark, d)
    prints = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("long").alias("speaker_id"))
    speakers = spark.range(4).select(F.col("id").alias("speaker_id"), (F.col("id") == 2).alias("is_self"))
    return directory(segments, prints, speakers)


def _in_order(spark, d):
    rows = timed_segments(spark, d).join(speakers(spark, d).select(F.col("id").alias("speaker_id"), "name"), "speaker_id", "left")
    return rows.select("meeting_id", "id", or_unknown(F.col("name")).alias("speaker"), "channel", (F.round(F.col("dur_us") / 1e4) / 100).alias("duration_s"), F.round(F.col("energy"), 1).alias("energy")).orderBy("meeting_id", "id")


def _participants_by_id(spark, d):
    rows = timed_segments(spark, d).filter(F.col("speaker_id").isNotNull())
    return rows.groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("utterances")).join(speakers(spark, d).select(F.col("id").alias("speaker_id"), "name"), "speaker_id", "left")


QUERIES = {
    "meeting_overview": _meeting_overview,
    "child_counts_left": _child_counts,
    "speaker_directory": _directory,
    "segments_in_order": _in_order,
    "segments_by_ids": lambda s, d: segments_by_ids(transcript(s, d), 3, [0, 2, 5, 999]),
    "participants_line": lambda s, d: participants(transcript(s, d), "speaker", ["start_s", "id"]),
    "participants_by_id": _participants_by_id,
}

SQL = {
    "meeting_overview": "SELECT o_orderkey AS meeting_id, o_orderdate AS started_at, coalesce(length(o_orderpriority) > 0, false) AS has_summary, count(l_orderkey) AS segments FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
    "child_counts_left": "SELECT d.doc_id, count(l.doc_id) AS labels FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id",
    "speaker_directory": f"""SELECT s AS speaker_id, s = 2 AS is_self, (SELECT count(DISTINCT meeting_id) FROM {TIMED} t WHERE t.speaker_id = s) AS meetings,
      (SELECT count(*) FROM {TIMED} t WHERE t.speaker_id = s) AS segments, (SELECT count(*) FROM embeddings WHERE label % 3 = s) AS prints,
      (SELECT min(vec_id) FROM embeddings WHERE label % 3 = s) AS first_print FROM range(4) r(s)""",
    "segments_in_order": f"SELECT meeting_id, t.id, coalesce(name, '{UNKNOWN}') AS speaker, channel, round(dur_us / 1e4) / 100 AS duration_s, round(energy, 1) AS energy FROM {TIMED} t LEFT JOIN {SPEAKERS} s ON t.speaker_id = s.id",
    "segments_by_ids": f"SELECT * FROM {SPOKEN} WHERE meeting_id = 3 AND id IN (0, 2, 5, 999)",
    "participants_line": f"""SELECT meeting_id, string_agg(speaker || ' (' || n || ')', ', ' ORDER BY n DESC, first) AS participants
      FROM (SELECT meeting_id, coalesce(speaker, '{UNKNOWN}') AS speaker, count(*) AS n, min(start_s) AS first FROM {SPOKEN} GROUP BY ALL) GROUP BY meeting_id""",
    "participants_by_id": f"SELECT speaker_id, meeting_id, utterances, name FROM (SELECT speaker_id, meeting_id, count(*) AS utterances FROM {TIMED} WHERE speaker_id IS NOT NULL GROUP BY ALL) t LEFT JOIN {SPEAKERS} s ON t.speaker_id = s.id",
}
