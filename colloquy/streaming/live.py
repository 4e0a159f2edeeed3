"""A meeting's rows in their order, utterances and merges together: what the batch fold and the live stream share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.steps import Live, attribute_step, merge_live

ATTRIBUTED = "meeting_id long, id long, speaker long, similarity double, is_new boolean, error string"
ROW = ["meeting_id", "id", "channel", "start_us", "end_us", "speech_us", "centroid", "source", "target"]


def in_order(utterances: DataFrame, merges: DataFrame | None, more: list[str] | None = None) -> DataFrame:
    """Utterances, with ``more`` of their columns, and merges as rows of one kind; merges have a source and a target and no id."""
    names, none = [*ROW, *(more or [])], F.lit(None).cast("long")
    rows = utterances.select(*[none.alias(c) if c in ("source", "target") else c for c in names])
    if merges is None:
        return rows
    given = {c: F.col(c).cast("long") for c in ("meeting_id", "start_us", "source", "target")}
    return rows.unionByName(merges.select(*[given.get(c, F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in names]))


def told_of(segments: DataFrame) -> DataFrame:
    """(meeting_id, start_us, id, no, value): what clients are told of segments; a new speaker comes before the segment that brought it."""
    place = ["meeting_id", "start_us", "id"]
    people = segments.filter("is_new").select(*place, F.lit(0).alias("no"), F.to_json(F.struct(F.lit("speaker_new").alias("type"), "speaker")).alias("value"))
    told = segments.select(*place, F.lit(1).alias("no"), F.to_json(F.struct(F.lit("segment").alias("type"), "id", "channel", "text", "speaker")).alias("value"))
    return people.unionByName(told)


def told(step, *args) -> tuple:
    """What a step finds and no error, or an empty finding and the error of a row that it refuses; its state stays then."""
    try:
        return (*step(*args), None)
    except (ValueError, TypeError) as e:
        return None, None, None, str(e) or type(e).__name__


def live_step(live: Live, row) -> tuple | None:
    """(speaker, similarity, is_new, error) of an utterance; None of a merge, which only changes what is remembered."""
    if not pd.isna(row.source):
        if not pd.isna(row.target):
            merge_live(live, int(row.source), int(row.target), "", [])
        return None
    missing = [c for c in ("channel", "start_us", "end_us", "speech_us") if pd.isna(getattr(row, c))]
    if missing:
        return None, None, None, f"no {missing[0]}"
    return told(attribute_step, live, row.centroid, row.channel, int(row.start_us), int(row.end_us), int(row.speech_us))


def attributed_frame(rows: list[tuple]) -> pd.DataFrame:
    column = lambda k, kind: pd.array([r[k] for r in rows], dtype=kind)
    whole = lambda k: pd.array([None if pd.isna(r[k]) else int(r[k]) for r in rows], dtype="Int64")
    return pd.DataFrame({"meeting_id": whole(0), "id": whole(1), "speaker": column(2, "Int64"), "similarity": column(3, "Float64").round(6), "is_new": column(4, "boolean"), "error": column(5, "string")})
