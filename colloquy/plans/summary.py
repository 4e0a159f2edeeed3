"""Meeting protocols with a pluggable model: notes per chunk, their reduction, and the outcome."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import UNKNOWN, participants, segments_by_ids
from ..operators.transcripts import LINE_SQL, lines, pack_lines, render
from ..sources.lens import SPOKEN, table, transcript
from ..sources.tables import written

#: A model takes (system, prompt) and answers with text; TooLong says that the prompt did not fit.
Model = Callable[[str, str], str]
NOTES, PROTOCOL = "Take notes of this part of a meeting.", "Write the protocol of a meeting."


class TooLong(Exception):
    """The prompt or its answer did not fit the model."""


def notes_for(model: Model, chunk: str, depth: int = 0, deepest: int = 3) -> str:
    """Notes of a chunk; one that does not fit is halved by lines, ``deepest`` times at most."""
    try:
        return model(NOTES, chunk)
    except TooLong:
        parts = chunk.split("\n")
        if depth >= deepest or len(parts) < 2:
            raise
        half = len(parts) // 2
        return "\n".join(notes_for(model, "\n".join(p), depth + 1, deepest) for p in (parts[:half], parts[half:]))


def summarize(segments: DataFrame, model: Model, room: int, levels: int = 3, model_name: str = "") -> DataFrame:
    """Per meeting (status, summary, summary_model, error): whole where it fits ``room`` characters, else by notes of its chunks.

    Chunks of all meetings are spread over the tasks; notes are gathered per meeting and chunked again while they are
    too long, ``levels`` times at most. A level's notes are written before anything reads them, so that each chunk is
    asked once. A failure of the model is its meeting's error and nobody else's; of an unknown one the kind is told.
    """

    def asked(pdf_iter, question: Callable[[Model, str], str]):
        for pdf in pdf_iter:
            out, errors = [], []
            for body in pdf["body"]:
                try:
                    out.append(question(model, body))
                    errors.append(None)
                except TooLong:
                    out.append(None)
                    errors.append("did not fit")
                except Exception as e:
                    out.append(None)
                    errors.append(type(e).__name__)
            yield pd.DataFrame({"meeting_id": pdf["meeting_id"], "chunk": pdf["chunk"], "body": out, "error": errors})

    kind = "meeting_id long, chunk long, body string, error string"
    whole = render(segments).select("meeting_id", F.lit(0).cast("long").alias("chunk"), F.col("transcript").alias("body"))
    fits = (F.length("body") <= room) if room > 0 else F.lit(True)
    ready, broken = whole.filter(fits), []
    rest = written(pack_lines(segments.join(whole.filter(~fits).select("meeting_id"), "meeting_id", "left_semi"), room))
    for level in range(levels):
        if rest.isEmpty():
            break
        noted = written(rest.repartition("meeting_id", "chunk").mapInPandas(lambda it: asked(it, notes_for), kind))
        failed = noted.filter("error IS NOT NULL").groupBy("meeting_id").agg(F.min("error").alias("error"))
        broken.append(failed)
        notes = noted.join(failed.select("meeting_id"), "meeting_id", "left_anti").groupBy("meeting_id")
        notes = notes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "body"))), lambda x: x["body"]), "\n").alias("body"))
        one = notes.select("meeting_id", F.lit(0).cast("long").alias("chunk"), "body")
        ready = ready.unionByName(one if level == levels - 1 else one.filter(fits))
        text = one.filter(~fits).select("meeting_id", F.posexplode(F.split("body", "\n")).alias("id", "text"))
        rest = written(pack_lines(text.select("meeting_id", F.col("id").cast("long"), F.col("id").cast("double").alias("start_s"), F.lit("note").alias("speaker"), "text"), room))
    done = written(ready.repartition("meeting_id").mapInPandas(lambda it: asked(it, lambda m, body: m(PROTOCOL, body)), kind))
    answers = done.select("meeting_id", F.col("body").alias("summary"), "error")
    for failed in broken:
        answers = answers.unionByName(failed.select("meeting_id", F.lit(None).cast("string").alias("summary"), "error"))
    return answers.select("meeting_id", F.lit("done").alias("status"), "summary", F.when(F.col("summary") != "", model_name).alias("summary_model"), "error")


def question_context(segments: DataFrame, meeting_id: int, ids: list[int], budget: int) -> DataFrame:
    """(quoted, earlier) for a question: the chosen segments of this meeting in order, and the end of what else was said."""
    gather = lambda df: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "id", "line"))), lambda x: x["line"]), "\n")
    quoted = lines(segments_by_ids(segments, meeting_id, ids)).agg(gather(None).alias("quoted"))
    other = segments.filter(F.col("meeting_id") == meeting_id)
    other = other.filter(~F.col("id").isin(ids)) if ids else other
    return quoted.join(lines(other).agg(F.right(gather(None), F.lit(budget)).alias("earlier")))


def export(meetings: DataFrame, segments: DataFrame, form: str = "md") -> DataFrame:
    """One text per meeting: title, date, participants, summary where there is one, and the whole transcript.

    Markdown for the form "md", plain text for any other. A meeting without segments has an empty transcript.
    """
    marked = form == "md"
    date = F.coalesce(F.date_format("started_at", "dd.MM.yyyy HH:mm"), F.lit(""))
    people = F.coalesce("participants", F.lit(""))
    head = [F.concat(F.lit("# "), F.col("title")), F.concat(F.lit("*"), date, F.lit("*")), F.concat(F.lit("**Participants:** "), people)] if marked else [F.col("title"), date, F.concat(F.lit("Participants: "), people)]
    line = "---" if marked else "-" * 40
    summary = F.when(F.length("summary") > 0, F.concat(F.col("summary"), F.lit(f"\n\n{line}\n\n"))).otherwise("")
    title = "## Transcript\n\n" if marked else ""
    joined = meetings.join(render(segments), "meeting_id", "left").join(participants(segments, "speaker", ["start_s", "id"]), "meeting_id", "left")
    return joined.select("meeting_id", F.concat(F.concat_ws("\n", *head), F.lit("\n\n"), summary, F.lit(title), F.coalesce("transcript", F.lit("")), F.lit("\n")).alias("text"))


def _exported(spark, d):
    meetings = table(spark, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.concat(F.lit("Meeting "), F.col("o_custkey").cast("string")).alias("title"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("summary"))
    said = transcript(spark, d)
    return export(meetings, said).unionByName(export(meetings.select((-1 - F.col("meeting_id")).alias("meeting_id"), "title", "started_at", "summary"), said.withColumn("meeting_id", -1 - F.col("meeting_id")), "txt"))


def _notes(spark, d):
    """A model that counts: notes tell a chunk's length, protocols their own input's."""
    return summarize(transcript(spark, d), lambda system, prompt: f"{system.split()[0]} {len(prompt)}", 2_000, model_name="counting").drop("status")


QUERIES = {"meeting_export": _exported, "summary_in_parts": _notes}
_TOLD = f"""(SELECT meeting_id, string_agg({LINE_SQL}, chr(10) ORDER BY start_s, id) AS t FROM {SPOKEN} GROUP BY meeting_id)"""
_PEOPLE = f"""(SELECT meeting_id, string_agg(speaker || ' (' || n || ')', ', ' ORDER BY n DESC, first) AS p FROM (SELECT meeting_id, coalesce(speaker, '{UNKNOWN}') AS speaker, count(*) AS n, min(start_s) AS first FROM {SPOKEN} GROUP BY ALL) GROUP BY meeting_id)"""
SQL = {
    "meeting_export": f"""WITH m AS (SELECT o_orderkey AS meeting_id, 'Meeting ' || o_custkey AS title, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS date, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS summary, coalesce(t, '') AS t, coalesce(p, '') AS p
        FROM orders LEFT JOIN {_TOLD} a ON o_orderkey = a.meeting_id LEFT JOIN {_PEOPLE} b ON o_orderkey = b.meeting_id)
      SELECT meeting_id, '# ' || title || chr(10) || '*' || date || '*' || chr(10) || '**Participants:** ' || p || chr(10) || chr(10) || CASE WHEN summary <> '' THEN summary || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '## Transcript' || chr(10) || chr(10) || t || chr(10) AS text FROM m
      UNION ALL SELECT -1 - meeting_id, title || chr(10) || date || chr(10) || 'Participants: ' || p || chr(10) || chr(10) || CASE WHEN summary <> '' THEN summary || chr(10) || chr(10) || repeat('-', 40) || chr(10) || chr(10) ELSE '' END || t || chr(10) FROM m""",
}
