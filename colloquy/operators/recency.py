"""Who spoke lately: as-of donors and recent speakers, set-based and as an ordered fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import donor_step
from ..sources.lens import TIMED, timed_segments

COMPATIBLE = {"mic": ["mic", "mixed"], "system": ["system", "mixed"], "mixed": ["mic", "system", "mixed"]}


def donor_asof(segments: DataFrame, tolerance_us: int) -> DataFrame:
    """Unattributed segments take the latest attributed one before them on a compatible channel, ended less than the tolerance ago."""
    before = Window.partitionBy("meeting_id").orderBy("start_us", "id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("speaker_id").isNotNull()
    last = {c: F.max(F.when(known & (F.col("channel") == c), F.struct("end_us", "speaker_id"))).over(before) for c in COMPATIBLE}
    seen = segments.select("*", *[last[c].alias(f"_{c}") for c in COMPATIBLE])
    best = F.when(F.col("channel") == "mic", F.greatest("_mic", "_mixed")).when(F.col("channel") == "system", F.greatest("_system", "_mixed")).otherwise(F.greatest("_mic", "_system", "_mixed"))
    fresh = F.when(F.col("start_us") - best["end_us"] < tolerance_us, best["speaker_id"])
    return seen.filter(~known).select("id", "meeting_id", fresh.alias("donor"))


def donor_chained(segments: DataFrame, tolerance_us: int) -> DataFrame:
    """The same where who inherits a speaker hands it on: an ordered fold per meeting, one row of state per channel.

    A meeting's rows reach a task sorted, in batches; the fold holds the last donors only.
    """
    dealt = segments.select("meeting_id", "id", "channel", "start_us", "end_us", "speaker_id").repartition("meeting_id").sortWithinPartitions("meeting_id", "start_us", "id")

    def fold(batches):
        meeting, last = object(), {}
        for rows in batches:
            out = []
            for m, i, c, start, end, who in rows.itertuples(index=False):
                if m != meeting:
                    meeting, last = m, {}
                out.append(donor_step(last, c, start, end, None if pd.isna(who) else int(who), tolerance_us))
            yield pd.DataFrame({"id": rows["id"], "meeting_id": rows["meeting_id"], "speaker_id": pd.array(out, dtype="Int64"), "inherited": rows["speaker_id"].isna() & pd.notna(pd.Series(out, index=rows.index, dtype="object"))})

    return dealt.mapInPandas(fold, "id long, meeting_id long, speaker_id long, inherited boolean")


def recent_speakers(segments: DataFrame, tolerance_us: int) -> DataFrame:
    """Per segment how many speakers were heard within the tolerance before its start, both ends included.

    A speaker is recent from the end of each of their segments to their next end, or until the tolerance has passed:
    these spans of a speaker don't overlap, so a running sum of beginnings less endings counts speakers. No segment
    meets another one.
    """
    later = F.lead("end_us").over(Window.partitionBy("meeting_id", "speaker_id").orderBy("end_us"))
    spans = segments.filter("speaker_id IS NOT NULL").select("meeting_id", F.col("end_us").alias("begin"), F.least(F.coalesce(later, F.col("end_us") + tolerance_us + 1), F.col("end_us") + tolerance_us + 1).alias("stop"))
    none = F.lit(None).cast("long")
    marks = spans.select("meeting_id", F.col("begin").alias("at"), F.lit(1).alias("change"), none.alias("id")).unionByName(spans.select("meeting_id", F.col("stop").alias("at"), F.lit(-1).alias("change"), none.alias("id")))
    marks = marks.unionByName(segments.select("meeting_id", F.col("start_us").alias("at"), F.lit(0).alias("change"), "id"))
    heard = F.sum("change").over(Window.partitionBy("meeting_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("recent", heard).filter("id IS NOT NULL").select("id", F.col("recent").cast("long").alias("recent"))


_TOL = 600_000_000
QUERIES = {
    "donor_asof": lambda s, d: donor_asof(timed_segments(s, d), _TOL),
    "donor_chained": lambda s, d: donor_chained(timed_segments(s, d), _TOL),
    "recent_speakers": lambda s, d: recent_speakers(timed_segments(s, d), _TOL),
}
_LAST = ", ".join(f"CASE WHEN channel = '{c}' AND who IS NOT NULL THEN {{'e': end_us, 's': who}} ELSE {c}_ END AS {c}_" for c in COMPATIBLE)
_OFFER = " , ".join(f"CASE WHEN r.channel = '{c}' OR r.channel = 'mixed' OR '{c}' = 'mixed' THEN {c}_ END" for c in COMPATIBLE)
SQL = {
    "donor_chained": f"""WITH RECURSIVE t AS (SELECT meeting_id, id, channel, start_us, end_us, speaker_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_us, id) AS i FROM {TIMED}),
      f AS (SELECT meeting_id, i, id, speaker_id AS own, speaker_id AS who, CASE WHEN channel = 'mic' AND speaker_id IS NOT NULL THEN {{'e': end_us, 's': speaker_id}} END AS mic_, CASE WHEN channel = 'system' AND speaker_id IS NOT NULL THEN {{'e': end_us, 's': speaker_id}} END AS system_,
          CASE WHEN channel = 'mixed' AND speaker_id IS NOT NULL THEN {{'e': end_us, 's': speaker_id}} END AS mixed_ FROM t WHERE i = 1
        UNION ALL SELECT meeting_id, i, id, own, who, {_LAST} FROM (SELECT r.meeting_id, r.i, r.id, r.channel, r.end_us, r.speaker_id AS own, mic_, system_, mixed_,
          coalesce(r.speaker_id, list_max(list_filter([{_OFFER}], lambda o: o IS NOT NULL AND r.start_us - o.e < {_TOL})).s) AS who FROM f JOIN t r ON r.meeting_id = f.meeting_id AND r.i = f.i + 1))
      SELECT id, meeting_id, who AS speaker_id, own IS NULL AND who IS NOT NULL AS inherited FROM f""",
    "donor_asof": f"""WITH t AS (SELECT * FROM {TIMED}), c AS (SELECT a.id, arg_max(b.speaker_id, (b.end_us, b.speaker_id)) AS who, max(b.end_us) AS e FROM t a JOIN t b ON a.meeting_id = b.meeting_id AND (b.start_us, b.id) < (a.start_us, a.id)
      AND b.speaker_id IS NOT NULL AND (a.channel = b.channel OR a.channel = 'mixed' OR b.channel = 'mixed') WHERE a.speaker_id IS NULL GROUP BY a.id)
      SELECT t.id, t.meeting_id, CASE WHEN t.start_us - c.e < {_TOL} THEN who END AS donor FROM t LEFT JOIN c USING (id) WHERE t.speaker_id IS NULL""",
    "recent_speakers": f"""WITH t AS (SELECT * FROM {TIMED}) SELECT a.id, count(DISTINCT b.speaker_id) AS recent FROM t a LEFT JOIN t b ON a.meeting_id = b.meeting_id AND b.end_us <= a.start_us AND a.start_us - b.end_us <= {_TOL} AND b.speaker_id IS NOT NULL GROUP BY a.id""",
}
