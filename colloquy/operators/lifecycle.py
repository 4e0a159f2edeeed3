"""A meeting's life as pure functions: it starts, is added to, ends once, is summed up again or goes; prints go too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lens import PRINTS, TIMED, table, timed_segments, voice_prints
from .ranks import ranked
from .views import known_or_first

#: Meetings whose counts are summed up beside each other; one window adds the spans.
MEETINGS_A_SPAN = 100_000

UNTITLED = "Untitled meeting"


def title_or_default(title: Column, default: str = UNTITLED) -> Column:
    """A trimmed title; nothing, or white space only, becomes the default."""
    return F.coalesce(F.nullif(F.btrim(title), F.lit("")), F.lit(default))


def start_meeting(meetings: DataFrame, asked: DataFrame, high_water: int, now: Column) -> DataFrame:
    """``meetings`` and one live row for each of ``asked`` (no, title, mode), with ids above ``high_water``, which is never reused.

    ``asked`` are requests of people, a few at a time; their order is that of ``no``.
    """
    rank = F.row_number().over(Window.orderBy("no")).cast("long") + high_water
    fresh = asked.select(rank.alias("meeting_id"), title_or_default(F.col("title")).alias("title"), known_or_first(F.col("mode")).alias("mode"), F.lit("live").alias("status"), now.alias("started_at"))
    return meetings.unionByName(fresh, allowMissingColumns=True)


def end_meeting(meetings: DataFrame, ended: Column, now: Column) -> DataFrame:
    """Meetings for which ``ended`` holds are done and end now, unless they have ended before."""
    due = F.coalesce(ended, F.lit(False)) & F.col("ended_at").isNull()
    return meetings.withColumns({"status": F.when(due, "done").otherwise(F.col("status")), "ended_at": F.when(due, now).otherwise(F.col("ended_at"))})


def append_segments(segments: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``segments`` and the ``new`` ones with ids after the largest there is, per meeting in ``order``.

    Ids are dealt per meeting from the table's largest id on: a count of each meeting's new rows, summed up over
    meetings in two levels (spans of meetings, and inside each), and a number inside each.
    """
    top = segments.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    counts = new.groupBy("meeting_id").agg(F.count("*").alias("n"))
    # Meetings of one span are next to each other, so that ids go up with the meetings.
    counts = counts.withColumn("span", F.floor(F.col("meeting_id") / MEETINGS_A_SPAN))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = counts.groupBy("span").agg(F.sum("n").alias("n")).select(F.col("span").alias("of_span"), upto(Window.orderBy("span")).alias("ahead"))
    both = counts.join(ahead, F.col("span").eqNullSafe(F.col("of_span")))
    starts = both.select(F.col("meeting_id").alias("of_meeting"), (F.col("ahead") + upto(Window.partitionBy("span").orderBy("meeting_id"))).alias("start"))
    placed = ranked(new, "meeting_id", order, "place").join(starts, F.col("meeting_id").eqNullSafe(F.col("of_meeting"))).join(F.broadcast(top))  # one row
    return segments.unionByName(placed.withColumn("id", F.col("top") + F.col("start") + F.col("place")).select(*segments.columns))


def delete_meetings(meetings: DataFrame, segments: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the meetings of ``gone`` (meeting_id)."""
    gone = gone.select("meeting_id").distinct()
    return meetings.join(gone, "meeting_id", "left_anti"), segments.join(gone, "meeting_id", "left_anti")


def summarise_again(meetings: DataFrame, asked: Column) -> tuple[DataFrame, DataFrame]:
    """(meetings with the asked ones being summarised and their error gone, the refused ones: those still live)."""
    asked = F.coalesce(asked, F.lit(False))
    due = asked & (F.col("status") != "live")
    after = meetings.withColumns({"summary_error": F.when(~due, F.col("summary_error")), "status": F.when(due, "summarizing").otherwise(F.col("status"))})
    return after, meetings.filter(asked & (F.col("status") == "live")).select("meeting_id")


def reassign(segments: DataFrame, chosen: Column, speaker_id: int | None) -> tuple[DataFrame, DataFrame]:
    """(segments with the chosen ones given to a speaker or to nobody, one row with how many that were)."""
    chosen = F.coalesce(chosen, F.lit(False))
    after = segments.withColumn("speaker_id", F.when(chosen, F.lit(speaker_id).cast("long")).otherwise(F.col("speaker_id")))
    return after, segments.agg(F.count_if(chosen).alias("changed"))


def remove_prints(prints: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prints without those of ``gone`` (speaker_id, print_id), the requests for prints that the speaker doesn't have)."""
    asked = gone.select(F.col("speaker_id").alias("of_speaker"), "print_id")
    same = (F.col("id") == F.col("print_id")) & (F.col("speaker_id") == F.col("of_speaker"))
    return prints.join(asked, same, "left_anti"), asked.join(prints, same, "left_anti").withColumnRenamed("of_speaker", "speaker_id")


def owned_file(prints: DataFrame, files: DataFrame, speaker_id: int, print_id: int) -> DataFrame:
    """The content of a print's recording, if the print is the speaker's and the file is there; else no row."""
    path = prints.filter((F.col("id") == print_id) & (F.col("speaker_id") == speaker_id)).select(F.col("audio_path").alias("path"))
    return files.join(path, "path", "left_semi").select("path", "content")


def rebuild(rows: DataFrame, keep: list[str], added: dict[str, Column]) -> DataFrame:
    """A table made anew: the columns kept, and new ones filled for every row."""
    return rows.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(c) for c, v in added.items()])


def pair_files(samples: DataFrame, prints: DataFrame, there: DataFrame) -> DataFrame:
    """Each speaker's k-th oldest sample that has a file with their k-th oldest print without a recording.

    Samples (id, speaker_id, path) whose file is missing take no print; what is left over on either side stays out.
    """
    ready = ranked(samples.join(there.select("path").distinct(), "path", "left_semi"), "speaker_id", ["id"]).select("speaker_id", "rank", F.col("id").alias("sample_id"), "path")
    free = ranked(prints.filter(F.col("audio_path").isNull()), "speaker_id", ["id"]).select("speaker_id", "rank", F.col("id").alias("print_id"))
    return ready.join(free, ["speaker_id", "rank"])


_NOW = "2025-01-01 00:00:00"


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp_ntz")


def _meetings(spark, d):
    """Meetings of the orders table: those with the status O are live, those with P have failed."""
    status = F.when(F.col("o_orderstatus") == "O", "live").otherwise("done")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("meeting_id"), F.concat(F.lit("Meeting "), F.col("o_custkey").cast("string")).alias("title"), F.lit("work").alias("mode"), status.alias("status"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("ended_at"), F.when(F.col("o_orderstatus") == "P", "no model").alias("summary_error"),
    )


_MEETINGS = """(SELECT o_orderkey AS meeting_id, 'Meeting ' || o_custkey AS title, 'work' AS mode, CASE WHEN o_orderstatus = 'O' THEN 'live' ELSE 'done' END AS status, o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS ended_at, CASE WHEN o_orderstatus = 'P' THEN 'no model' END AS summary_error FROM orders)"""
_ASKED = [(1, "  Plan  ", "study"), (2, " ", None), (3, None, "noise")]


def _started(spark, d):
    return start_meeting(_meetings(spark, d), spark.createDataFrame(_ASKED, "no long, title string, mode string"), 10_000_000, _now())


def _appended(spark, d):
    old = timed_segments(spark, d).select("id", "meeting_id", "speaker_id", "start_us")
    new = table(spark, d, "conversations").select(F.col("conv_id").alias("meeting_id"), F.lit(None).cast("long").alias("speaker_id"), (F.col("turn") * 1_000_000).alias("start_us"), "turn")
    return append_segments(old, new, ["start_us", "turn"])


def _deleted(spark, d):
    meetings, lines = delete_meetings(table(spark, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), "o_orderstatus"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id")), table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("meeting_id")))
    left = lines.groupBy(F.col("meeting_id").alias("of_meeting")).agg(F.count("*").alias("lines"))
    return meetings.join(left, F.col("meeting_id") == F.col("of_meeting"), "left").select("meeting_id", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))


def _again(spark, d):
    after, refused = summarise_again(_meetings(spark, d), F.col("meeting_id") < F.col("meeting_id") + 1)
    return after.join(refused.withColumn("refused", F.lit(True)), "meeting_id", "left").select("meeting_id", "status", "summary_error", F.coalesce("refused", F.lit(False)).alias("refused"))


def _reassigned(spark, d):
    after, changed = reassign(timed_segments(spark, d), F.col("channel") == "mic", None)
    return after.groupBy("speaker_id").agg(F.count("*").alias("segments")).join(F.broadcast(changed))


def _removed(spark, d):
    prints = voice_prints(spark, d)
    asked = prints.groupBy("speaker_id").agg(F.max("id").alias("print_id"))
    kept, refused = remove_prints(prints, asked.unionByName(asked.select((F.col("speaker_id") + 1).alias("speaker_id"), "print_id")))
    return kept.groupBy("speaker_id").agg(F.count("*").alias("prints")).join(refused.groupBy("speaker_id").agg(F.count("*").alias("refused")), "speaker_id", "full")


def _paired(spark, d):
    samples = timed_segments(spark, d).filter("speaker_id IS NOT NULL").select("id", "speaker_id", F.concat(F.lit("s"), (F.col("id") % 97).cast("string")).alias("path"))
    prints = voice_prints(spark, d).select("id", "speaker_id", F.when(F.get("centroid", F.lit(0)) > 0, "old").alias("audio_path"))
    there = samples.groupBy("path").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter(F.col("top") % 2 == 0)
    return pair_files(samples, prints, there).select("speaker_id", F.col("rank").cast("long").alias("rank"), "sample_id", "print_id")


QUERIES = {
    "meeting_start": _started,
    "meeting_end_once": lambda s, d: end_meeting(_meetings(s, d), F.lit(True), _now()),
    "segment_append": _appended,
    "meeting_delete": _deleted,
    "summary_again": _again,
    "segment_reassign": _reassigned,
    "print_remove": _removed,
    "table_rebuild": lambda s, d: rebuild(table(s, d, "orders"), ["o_orderkey", "o_orderdate"], {"meeting_mode": F.lit("work")}),
    "sample_files": _paired,
}
SQL = {
    "meeting_start": f"""SELECT * FROM {_MEETINGS} UNION ALL BY NAME SELECT 10000000 + no AS meeting_id, coalesce(nullif(trim(title), ''), '{UNTITLED}') AS title, CASE WHEN mode IN ('work', 'interview', 'study', 'talk') THEN mode ELSE 'work' END AS mode,
      'live' AS status, TIMESTAMP '{_NOW}' AS started_at FROM (VALUES (1::BIGINT, '  Plan  ', 'study'), (2, ' ', NULL), (3, NULL, 'noise')) AS v(no, title, mode)""",
    "meeting_end_once": f"SELECT * REPLACE (CASE WHEN ended_at IS NULL THEN 'done' ELSE status END AS status, coalesce(ended_at, TIMESTAMP '{_NOW}') AS ended_at) FROM {_MEETINGS}",
    "segment_append": f"""SELECT id, meeting_id, speaker_id, start_us FROM {TIMED} UNION ALL SELECT (SELECT max(id) FROM {TIMED}) + row_number() OVER (ORDER BY conv_id, turn) AS id, conv_id, NULL, turn * 1000000 FROM conversations""",
    "meeting_delete": "SELECT o_orderkey AS meeting_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders WHERE o_orderstatus <> 'P'",
    "summary_again": f"SELECT meeting_id, CASE WHEN status = 'live' THEN status ELSE 'summarizing' END AS status, CASE WHEN status = 'live' THEN summary_error END AS summary_error, status = 'live' AS refused FROM {_MEETINGS}",
    "segment_reassign": f"""SELECT CASE WHEN channel <> 'mic' THEN speaker_id END AS speaker_id, count(*) AS segments, (SELECT count(*) FROM {TIMED} WHERE channel = 'mic') AS changed FROM {TIMED} GROUP BY 1""",
    "print_remove": f"""WITH a AS (SELECT speaker_id, max(id) AS print_id FROM {PRINTS} GROUP BY 1), q AS (SELECT * FROM a UNION ALL SELECT speaker_id + 1, print_id FROM a),
      k AS (SELECT speaker_id, count(*) AS prints FROM {PRINTS} p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.print_id = p.id AND q.speaker_id = p.speaker_id) GROUP BY 1),
      r AS (SELECT speaker_id, count(*) AS refused FROM q WHERE NOT EXISTS (SELECT 1 FROM {PRINTS} p WHERE q.print_id = p.id AND q.speaker_id = p.speaker_id) GROUP BY 1)
      SELECT coalesce(k.speaker_id, r.speaker_id) AS speaker_id, prints, refused FROM k FULL JOIN r ON k.speaker_id = r.speaker_id""",
    "table_rebuild": "SELECT o_orderkey, o_orderdate, 'work' AS meeting_mode FROM orders",
    "sample_files": f"""WITH s AS (SELECT id, speaker_id, 's' || id % 97 AS path FROM {TIMED} WHERE speaker_id IS NOT NULL), t AS (SELECT path FROM s GROUP BY path HAVING max(id) % 2 = 0),
      a AS (SELECT speaker_id, id AS sample_id, row_number() OVER (PARTITION BY speaker_id ORDER BY id) AS rank FROM s WHERE path IN (SELECT path FROM t)),
      b AS (SELECT speaker_id, id AS print_id, row_number() OVER (PARTITION BY speaker_id ORDER BY id) AS rank FROM {PRINTS} WHERE NOT centroid[1] > 0) SELECT speaker_id, rank, sample_id, print_id FROM a JOIN b USING (speaker_id, rank)""",
}
