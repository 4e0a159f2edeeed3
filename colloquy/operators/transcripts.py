"""Transcript text: clock marks, rendering, truncation, packing into chunks, grouping of utterances."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lens import SPOKEN, TIMED, timed_segments, transcript
from .relational import UNKNOWN, or_unknown

CUT_MARK = "\n[...]\n"


def mmss(seconds: Column) -> Column:
    """Whole minutes without an upper end, and seconds: 3661 is 61:01."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def clock(seconds: Column) -> Column:
    """mm:ss, from an hour on h:mm:ss; negative times count as 0."""
    whole = F.greatest(F.floor(seconds).cast("long"), F.lit(0).cast("long"))
    hours, rest = F.floor(whole / 3600).cast("long"), whole % 3600
    short = F.format_string("%02d:%02d", F.floor(rest / 60).cast("long"), rest % 60)
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), short)).otherwise(short)


def lines(segments: DataFrame) -> DataFrame:
    return segments.withColumn("line", F.format_string("[%s] %s: %s", mmss(F.col("start_s")), or_unknown(F.col("speaker")), F.col("text")))


def render(segments: DataFrame) -> DataFrame:
    """Per meeting its lines, in order, one below the other."""
    return lines(segments).groupBy("meeting_id").agg(_joined().alias("transcript"))


def truncate_middle(text: Column, most: int) -> Column:
    """A quarter from the head and the rest from the tail of texts longer than ``most``; 0 or less keeps all."""
    if most <= 0:
        return text
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most // 4)), F.lit(CUT_MARK), F.right(text, F.lit(most - most // 4)))).otherwise(text)


def _joined(cond: Column | None = None) -> Column:
    """Lines of a group in order, one below the other."""
    row = F.struct("start_s", "id", "line")
    return F.array_join(F.transform(F.array_sort(F.collect_list(row if cond is None else F.when(cond, row))), lambda x: x["line"]), "\n")


def pack_lines(segments: DataFrame, most: int) -> DataFrame:
    """Chunks of whole lines of at most ``most`` characters, line ends counted; a longer line stands alone.

    A greedy fold over a meeting's ordered lines, which reach a task in batches; it holds a number and a size. A limit
    of 0 or less makes one chunk.
    """
    told = lines(segments).select("meeting_id", "start_s", "id", "line", F.length("line").cast("long").alias("chars"))
    if most <= 0:
        return told.groupBy("meeting_id").agg(F.lit(0).cast("long").alias("chunk"), _joined().alias("body"))
    dealt = told.repartition("meeting_id").sortWithinPartitions("meeting_id", "start_s", "id")

    def fold(batches):
        now, chunk, size = object(), 0, 0
        for rows in batches:
            out = []
            for meeting, chars in zip(rows.column("meeting_id").to_pylist(), rows.column("chars").to_pylist()):
                if meeting != now:
                    now, chunk, size = meeting, 0, 0
                if size and size + chars + 1 > most:
                    chunk, size = chunk + 1, 0
                size += chars + 1
                out.append(chunk)
            # Lines pass as they are; only their lengths are read.
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(out, pa.int64())], names=[*kept, "chunk"])

    kept, kinds = ["meeting_id", "start_s", "id", "line"], dict(told.dtypes)
    placed = dealt.mapInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", chunk long")
    return placed.groupBy("meeting_id", "chunk").agg(_joined().alias("body"))


def group_utterances(segments: DataFrame, gap_us: int) -> DataFrame:
    """Runs of one speaker without a pause above ``gap_us``; unknown speakers equal each other, another speaker breaks a run."""
    order = Window.partitionBy("meeting_id").orderBy("start_us", "id")
    who, last = F.coalesce("speaker_id", F.lit(-1)), F.lag(F.coalesce("speaker_id", F.lit(-1))).over(order)
    new = F.coalesce((who != last) | (F.col("start_us") - F.lag("end_us").over(order) > gap_us), F.lit(True))
    marked = segments.withColumn("_new", new.cast("long")).withColumn("run", F.sum("_new").over(order))
    return marked.groupBy("meeting_id", "run").agg(F.max("speaker_id").alias("speaker_id"), F.count("*").alias("utterances"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def woven(segments: DataFrame, hints: DataFrame, keep: int) -> DataFrame:
    """Per meeting its last ``keep`` lines and the hints (meeting_id, no, hint) among them: (meeting_id, no, kind, line).

    Hint n goes before line n, lines counted from 0, and after the last line if there is none; hints up to the first
    retained line's number are gone with what they followed.
    """
    order = Window.partitionBy("meeting_id").orderBy("start_s", "id")
    told = lines(segments).select("meeting_id", "line", (F.row_number().over(order) - 1).cast("long").alias("no"), F.count("*").over(Window.partitionBy("meeting_id")).alias("of"))
    held = told.filter(F.col("no") >= F.col("of") - keep)
    firsts = held.groupBy(F.col("meeting_id").alias("of_meeting")).agg(F.min("no").alias("first"))
    kept = hints.join(firsts, F.col("meeting_id") == F.col("of_meeting")).filter(F.col("no") > F.col("first"))
    asides = kept.select("meeting_id", "no", F.lit(0).alias("kind"), F.concat(F.lit("  [hint: "), F.col("hint"), F.lit("]")).alias("line"))
    return held.select("meeting_id", "no", F.lit(1).alias("kind"), "line").unionByName(asides)


def new_and_context(segments: DataFrame, boundary: int, keep: int, budget: int, hints: DataFrame | None = None) -> DataFrame:
    """Per meeting, of its last ``keep`` lines and their hints: from line ``boundary`` on as new text, what comes before as context.

    New text keeps its last ``budget`` characters; context gets what is left of the budget. Without a line from the
    boundary on, or with nothing before it, all is new.
    """
    none = segments.sparkSession.createDataFrame([], "meeting_id long, no long, hint string")
    rows = woven(segments, none if hints is None else hints, keep)
    fresh = rows.groupBy(F.col("meeting_id").alias("of_meeting")).agg(F.min(F.when((F.col("kind") == 1) & (F.col("no") >= boundary), F.col("no"))).alias("edge"))
    split = rows.join(fresh, F.col("meeting_id") == F.col("of_meeting")).withColumn("is_old", F.coalesce(F.struct("no", "kind") < F.struct("edge", F.lit(1)), F.lit(False)))
    part = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("no", "kind", "line")))), lambda x: x["line"]), "\n")
    both = split.groupBy("meeting_id").agg(part(~F.col("is_old")).alias("n"), part(F.col("is_old")).alias("c"))
    new = F.right("n", F.lit(budget))
    left = F.greatest(F.lit(budget) - F.length(new), F.lit(0))
    return both.select("meeting_id", new.alias("new_text"), F.when(left > 0, F.right(F.col("c"), left)).otherwise("").alias("context"))


def accumulated(deltas: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Each piece of an answer with the answer so far."""
    so_far = F.collect_list(text).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return deltas.select(key, order, F.array_join(so_far, "").alias("so_far"))


LINE_SQL = f"printf('[%02d:%02d] %s: %s', (start_s // 60)::BIGINT, start_s::BIGINT % 60, coalesce(speaker, '{UNKNOWN}'), text)"
_TEXT = f"(SELECT meeting_id, string_agg({LINE_SQL}, chr(10) ORDER BY start_s, id) AS transcript FROM {SPOKEN} GROUP BY meeting_id)"

_WOVEN = f"""(WITH l AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_s, id) - 1 AS no, count(*) OVER (PARTITION BY meeting_id) AS n, {LINE_SQL} AS line FROM {SPOKEN}), k AS (SELECT * FROM l WHERE no >= n - KEEP),
  h AS (SELECT meeting_id, id + 1 AS no, 'hint ' || id AS hint FROM {SPOKEN} WHERE speaker IS NOT NULL AND length(text) % 3 = 0)
  SELECT meeting_id, no, 1::BIGINT AS kind, line FROM k UNION ALL SELECT h.meeting_id, h.no, 0, '  [hint: ' || hint || ']' FROM h JOIN (SELECT meeting_id, min(no) AS f FROM k GROUP BY 1) f ON h.meeting_id = f.meeting_id WHERE h.no > f)"""


def _hints(spark, d):
    return transcript(spark, d).filter("length(text) % 3 = 0").select("meeting_id", (F.col("id") + 1).alias("no"), F.concat(F.lit("hint "), F.col("id").cast("string")).alias("hint"))


QUERIES = {
    "transcript_text": lambda s, d: render(transcript(s, d)),
    "transcript_truncated": lambda s, d: render(transcript(s, d)).select("meeting_id", truncate_middle(F.col("transcript"), 1000).alias("transcript")),
    "utterance_groups": lambda s, d: group_utterances(timed_segments(s, d), 300_000_000),
    "line_packing": lambda s, d: pack_lines(transcript(s, d), 2000),
    "new_vs_context": lambda s, d: new_and_context(transcript(s, d), 3, 6, 800),
    "hints_woven": lambda s, d: woven(transcript(s, d), _hints(s, d), 4).withColumn("kind", F.col("kind").cast("long")),
    "hints_in_context": lambda s, d: new_and_context(transcript(s, d), 4, 5, 900, _hints(s, d)),
    "answer_so_far": lambda s, d: accumulated(transcript(s, d), "meeting_id", "id", "text"),
    "clock_formats": lambda s, d: timed_segments(s, d).select("id", mmss(F.col("dur_us") / 1e3).alias("mmss"), clock(F.col("dur_us") / 1e2).alias("clock")),
}

SQL = {
    "transcript_text": f"SELECT * FROM {_TEXT}",
    "transcript_truncated": f"SELECT meeting_id, CASE WHEN length(transcript) > 1000 THEN left(transcript, 250) || chr(10) || '[...]' || chr(10) || right(transcript, 750) ELSE transcript END AS transcript FROM {_TEXT}",
    "utterance_groups": f"""WITH m AS (SELECT *, coalesce(coalesce(speaker_id, -1) <> lag(coalesce(speaker_id, -1)) OVER w OR start_us - lag(end_us) OVER w > 300000000, true) AS fresh FROM {TIMED} WINDOW w AS (PARTITION BY meeting_id ORDER BY start_us, id)),
      r AS (SELECT *, sum(fresh::BIGINT) OVER (PARTITION BY meeting_id ORDER BY start_us, id) AS run FROM m)
      SELECT meeting_id, run::BIGINT AS run, max(speaker_id) AS speaker_id, count(*) AS utterances, min(start_us) AS start_us, max(end_us) AS end_us FROM r GROUP BY meeting_id, run""",
    "line_packing": f"""WITH RECURSIVE l AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_s, id) AS i, {LINE_SQL} AS line FROM {SPOKEN}),
      p AS (SELECT meeting_id, i, line, 0::BIGINT AS chunk, (length(line) + 1)::BIGINT AS size FROM l WHERE i = 1 UNION ALL
        SELECT l.meeting_id, l.i, l.line, CASE WHEN p.size + length(l.line) + 1 > 2000 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.size + length(l.line) + 1 > 2000 THEN length(l.line) + 1 ELSE p.size + length(l.line) + 1 END
        FROM p JOIN l ON l.meeting_id = p.meeting_id AND l.i = p.i + 1)
      SELECT meeting_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body FROM p GROUP BY meeting_id, chunk""",
    "new_vs_context": f"""WITH l AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_s, id) - 1 AS i, row_number() OVER (PARTITION BY meeting_id ORDER BY start_s DESC, id DESC) AS back, {LINE_SQL} AS line FROM {SPOKEN}),
      k AS (SELECT *, max(i) OVER (PARTITION BY meeting_id) < 3 AS whole FROM l WHERE back <= 6),
      b AS (SELECT meeting_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (i >= 3 OR whole), '') AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (i < 3 AND NOT whole), '') AS c FROM k GROUP BY meeting_id)
      SELECT meeting_id, right(n, 800) AS new_text, CASE WHEN 800 - length(right(n, 800)) > 0 THEN right(c, 800 - length(right(n, 800))) ELSE '' END AS context FROM b""",
    "hints_woven": f"SELECT * FROM {_WOVEN.replace('KEEP', '4')}",
    "hints_in_context": f"""WITH w AS (SELECT *, min(CASE WHEN kind = 1 AND no >= 4 THEN no END) OVER (PARTITION BY meeting_id) AS edge FROM {_WOVEN.replace('KEEP', '5')}), o AS (SELECT *, coalesce(no < edge OR (no = edge AND kind = 0), false) AS old FROM w),
      b AS (SELECT meeting_id, coalesce(string_agg(line, chr(10) ORDER BY no, kind) FILTER (NOT old), '') AS n, coalesce(string_agg(line, chr(10) ORDER BY no, kind) FILTER (old), '') AS c FROM o GROUP BY meeting_id)
      SELECT meeting_id, right(n, 900) AS new_text, CASE WHEN 900 - length(right(n, 900)) > 0 THEN right(c, 900 - length(right(n, 900))) ELSE '' END AS context FROM b""",
    "answer_so_far": f"SELECT meeting_id, id, string_agg(text, '') OVER (PARTITION BY meeting_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM {SPOKEN}",
    "clock_formats": f"""SELECT id, printf('%02d:%02d', (dur_us // 60000)::BIGINT, (dur_us // 1000) % 60) AS mmss,
      CASE WHEN dur_us // 360000 > 0 THEN (dur_us // 360000) || ':' ELSE '' END || printf('%02d:%02d', (dur_us // 100) % 3600 // 60, (dur_us // 100) % 60) AS clock FROM {TIMED}""",
}
