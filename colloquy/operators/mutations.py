"""Changes to the tables as pure functions from frames to frames; nothing is written in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lens import PRINTS, SPEAKERS, TIMED, speakers, table, timed_segments, voice_prints
from .ranks import ranked


def custom_name(name: Column, speaker_id: Column) -> Column:
    """Named by a person: neither empty nor the default "Speaker {id}"."""
    return F.coalesce((F.length(name) > 0) & (name != F.concat(F.lit("Speaker "), speaker_id.cast("string"))), F.lit(False))


def merge_plan(speakers: DataFrame, segments: DataFrame, a: int, b: int) -> DataFrame:
    """One row (source, target, name) for two speakers: oneself first, then a custom name, then more segments, then the older id."""
    counts = segments.filter(F.col("speaker_id").isin(a, b)).groupBy(F.col("speaker_id").alias("_s")).agg(F.count("*").alias("n"))
    both = speakers.filter(F.col("id").isin(a, b)).join(counts, F.col("id") == F.col("_s"), "left")
    rank = F.struct("is_self", custom_name(F.col("name"), F.col("id")).alias("custom"), F.coalesce("n", F.lit(0)).alias("n"), (-F.col("id")).alias("old"))
    picked = both.agg(F.max_by("id", rank).alias("target"), F.min_by("id", rank).alias("source"), F.max_by(F.struct("id", "name"), rank).alias("t"), F.min_by("name", rank).alias("other"), F.count("*").alias("k"))
    name = F.when(custom_name(F.col("t.name"), F.col("target")) | F.col("other").isNull(), F.col("t.name")).otherwise(F.when(custom_name(F.col("other"), F.col("source")), F.col("other")).otherwise(F.col("t.name")))
    return picked.filter("k = 2").select("source", "target", name.alias("name"))


def remap(df: DataFrame, column: str, plan: DataFrame) -> DataFrame:
    """``df`` with ``column`` rewritten from source to target; nulls and others stay."""
    to = plan.select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    return df.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def merge_speakers(speakers: DataFrame, segments: DataFrame, prints: DataFrame, a: int, b: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after a merge: prints move, segments are rewritten, the source goes and its name may live on."""
    plan = merge_plan(speakers, segments, a, b)
    named = speakers.join(plan.select(F.col("target").alias("_t"), F.col("name").alias("_n")), F.col("id") == F.col("_t"), "left").withColumn("name", F.coalesce("_n", "name")).drop("_t", "_n")
    left = named.join(plan.select(F.col("source").alias("id")), "id", "left_anti")
    return left, remap(segments, "speaker_id", plan), remap(prints, "speaker_id", plan)


def rename(speakers: DataFrame, speaker_id: int, name: str) -> DataFrame:
    """A trimmed name; an empty one changes nothing."""
    new = name.strip()
    return speakers.withColumn("name", F.when(F.lit(bool(new)) & (F.col("id") == speaker_id), new).otherwise(F.col("name")))


def delete_speaker(speakers: DataFrame, segments: DataFrame, prints: DataFrame, speaker_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the speaker and their prints, their segments not attributed; oneself can't be deleted."""
    gone = speakers.filter((F.col("id") == speaker_id) & ~F.col("is_self")).select(F.col("id").alias("_gone"))
    kept = speakers.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    freed = segments.join(gone.distinct(), F.col("speaker_id") == F.col("_gone"), "left").withColumn("speaker_id", F.when(F.col("_gone").isNull(), F.col("speaker_id"))).drop("_gone")
    return kept, freed, prints.join(gone, F.col("speaker_id") == F.col("_gone"), "left_anti")


def create_speakers(speakers: DataFrame, high_water: int, n: int) -> DataFrame:
    """``n`` more speakers with ids above ``high_water``, which is never reused, named by id."""
    ids = speakers.sparkSession.range(high_water + 1, high_water + 1 + n)
    return speakers.unionByName(ids.select("id", F.concat(F.lit("Speaker "), F.col("id").cast("string")).alias("name"), F.lit(False).alias("is_self")))


def ensure_self(speakers: DataFrame) -> DataFrame:
    """The row of oneself added with id 0 if there is none."""
    own = speakers.sparkSession.createDataFrame([(0, "Me", True)], "id long, name string, is_self boolean")
    return speakers.unionByName(own.join(speakers.filter("is_self").select("is_self").limit(1), "is_self", "left_anti").select("id", "name", "is_self"))


def repair_stale(meetings: DataFrame, now: Column) -> DataFrame:
    """After a restart: live meetings end now, those being summarised are done with an error."""
    return meetings.select(
        "meeting_id",
        F.when(F.col("status").isin("live", "summarizing"), "done").otherwise(F.col("status")).alias("status"),
        F.when(F.col("status") == "live", now).otherwise(F.col("ended_at")).alias("ended_at"),
        F.when(F.col("status") == "summarizing", "interrupted").alias("summary_error"),
    )


def pair_by_rank(samples: DataFrame, prints: DataFrame) -> DataFrame:
    """Each speaker's k-th oldest sample with their k-th oldest print; what is left over on either side stays out."""
    one = ranked(samples, "speaker_id", ["id"]).withColumnRenamed("id", "sample_id")
    two = ranked(prints.select("speaker_id", "id"), "speaker_id", ["id"]).withColumnRenamed("id", "print_id")
    return one.join(two, ["speaker_id", "rank"])


def interleave(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Round robin: the first of each key, the second of each, and so on."""
    return ranked(rows, key, [order], "round").orderBy("round", key)


def split_column(rows: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows without the column, its non-null values by key): a column moved to a table of its own."""
    return rows.drop(column), rows.filter(F.col(column).isNotNull()).select(key, column)


def _merged(spark, d):
    people, segments, prints = merge_speakers(speakers(spark, d), timed_segments(spark, d), voice_prints(spark, d), 0, 1)
    held = prints.groupBy("speaker_id").agg(F.count("*").alias("prints"))
    said = segments.groupBy("speaker_id").agg(F.count("*").alias("segments"))
    return people.join(held.withColumnRenamed("speaker_id", "id"), "id", "left").join(said.withColumnRenamed("speaker_id", "id"), "id", "left").select("id", "name", F.coalesce("prints", F.lit(0)).cast("long").alias("prints"), F.coalesce("segments", F.lit(0)).cast("long").alias("segments"))


def _deleted(spark, d):
    _, segments, prints = delete_speaker(speakers(spark, d), timed_segments(spark, d), voice_prints(spark, d), 1)
    return segments.groupBy("speaker_id").agg(F.count("*").alias("segments")).join(prints.groupBy("speaker_id").agg(F.count("*").alias("prints")), "speaker_id", "full")


_NOW = "2025-01-01 00:00:00"
QUERIES = {
    "merge_plan": lambda s, d: merge_plan(speakers(s, d), timed_segments(s, d), 0, 1),
    "merge_apply": _merged,
    "rename_apply": lambda s, d: rename(speakers(s, d), 4, "  Ann  "),
    "delete_speaker": _deleted,
    "create_speaker": lambda s, d: create_speakers(ensure_self(speakers(s, d)), 1_000_000, 2),
    "stale_repair": lambda s, d: repair_stale(
        table(s, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.when(F.col("o_orderstatus") == "O", "live").when(F.col("o_orderstatus") == "P", "summarizing").otherwise("done").alias("status"), F.col("o_orderdate").alias("ended_at")),
        F.lit(_NOW).cast("timestamp_ntz"),
    ),
    "sample_pairing": lambda s, d: pair_by_rank(timed_segments(s, d).filter("speaker_id IS NOT NULL").select("speaker_id", "id"), voice_prints(s, d)),
    "round_robin": lambda s, d: interleave(voice_prints(s, d).select("id", "speaker_id"), "speaker_id", "id"),
}

_PLAN = f"""(WITH b AS (SELECT s.*, name <> '' AND name <> 'Speaker ' || id AS custom, (SELECT count(*) FROM {TIMED} t WHERE t.speaker_id = s.id) AS n FROM {SPEAKERS} s WHERE id IN (0, 1)),
  r AS (SELECT *, row_number() OVER (ORDER BY is_self DESC, custom DESC, n DESC, id) AS k FROM b)
  SELECT max(id) FILTER (k = 2) AS source, max(id) FILTER (k = 1) AS target, CASE WHEN NOT bool_or(custom) FILTER (k = 1) AND bool_or(custom) FILTER (k = 2) THEN max(name) FILTER (k = 2) ELSE max(name) FILTER (k = 1) END AS name FROM r)"""
SQL = {
    "merge_plan": f"SELECT * FROM {_PLAN}",
    "merge_apply": f"""SELECT s.id, CASE WHEN s.id = p.target THEN p.name ELSE s.name END AS name, (SELECT count(*) FROM {PRINTS} x WHERE CASE WHEN x.speaker_id = p.source THEN p.target ELSE x.speaker_id END = s.id) AS prints,
      (SELECT count(*) FROM {TIMED} t WHERE CASE WHEN t.speaker_id = p.source THEN p.target ELSE t.speaker_id END = s.id) AS segments FROM {SPEAKERS} s, {_PLAN} p WHERE s.id <> p.source""",
    "rename_apply": f"SELECT id, CASE WHEN id = 4 THEN 'Ann' ELSE name END AS name, is_self FROM {SPEAKERS}",
    "delete_speaker": f"""SELECT coalesce(a.speaker_id, b.speaker_id) AS speaker_id, segments, prints FROM (SELECT CASE WHEN speaker_id <> 1 THEN speaker_id END AS speaker_id, count(*) AS segments FROM {TIMED} GROUP BY 1) a
      FULL JOIN (SELECT speaker_id, count(*) AS prints FROM {PRINTS} WHERE speaker_id <> 1 GROUP BY 1) b ON a.speaker_id = b.speaker_id""",
    "create_speaker": f"SELECT * FROM {SPEAKERS} UNION ALL SELECT i, 'Speaker ' || i, false FROM range(1000001, 1000003) r(i)",
    "stale_repair": f"SELECT o_orderkey AS meeting_id, 'done' AS status, CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '{_NOW}' ELSE o_orderdate END AS ended_at, CASE WHEN o_orderstatus = 'P' THEN 'interrupted' END AS summary_error FROM orders",
    "sample_pairing": f"""SELECT speaker_id, rank::INTEGER AS rank, sample_id, print_id FROM (SELECT speaker_id, id AS sample_id, row_number() OVER (PARTITION BY speaker_id ORDER BY id) AS rank FROM {TIMED} WHERE speaker_id IS NOT NULL)
      JOIN (SELECT speaker_id, id AS print_id, row_number() OVER (PARTITION BY speaker_id ORDER BY id) AS rank FROM {PRINTS}) USING (speaker_id, rank)""",
    "round_robin": f"SELECT id, speaker_id, row_number() OVER (PARTITION BY speaker_id ORDER BY id)::INTEGER AS round FROM {PRINTS}",
}
