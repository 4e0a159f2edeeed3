"""Set-based signal operators: alignment, channel dominance, its runs, and speech sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import absorb_short_runs
from ..sources.lens import PRINTS, TIMED, timed_segments, voice_prints

RATIO = 2.0


def dominance(mic: Column, system: Column, ratio: float = RATIO) -> Column:
    """The channel alone active, or the one more than ``ratio`` times as strong; else mixed."""
    return F.when((mic > 0) & (system <= 0), "mic").when((system > 0) & (mic <= 0), "system").when(mic > system * ratio, "mic").when(system > mic * ratio, "system").otherwise("mixed")


def channel_levels(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean square of both channels per key; a silent one is 0."""
    level = lambda c: F.coalesce(F.sqrt(F.avg(F.when(F.col("channel") == c, F.col("energy") * F.col("energy")))), F.lit(0.0))
    return frames.groupBy(*keys).agg(level("mic").alias("mic"), level("system").alias("system"))


def fill_labels(slots: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mixed slots take the label before them, else the one after; keys of mixed slots only stay mixed."""
    known = F.when(F.col("label") != "mixed", F.col("label"))
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return slots.withColumn("filled", F.coalesce(F.last(known, True).over(ahead), F.first(known, True).over(back), F.lit("mixed")))


def label_runs(slots: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Runs of equal labels with their lengths and spans of slots."""
    by = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce(F.col(label) != F.lag(label).over(by), F.lit(True)).cast("long")
    marked = slots.withColumn("_new", new).withColumn("run", F.sum("_new").over(by))
    return marked.groupBy(*keys, "run").agg(F.first(label).alias("label"), F.count("*").alias("n"), F.min(order).alias("first_slot"), F.max(order).alias("last_slot"))


def absorb(runs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Short runs merged into longer neighbours until none is shorter than ``least``; the runs of ``keys`` are one small group."""
    kinds = dict(runs.dtypes)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        merged = absorb_short_runs(list(zip(rows["label"], rows["n"])), least)
        held = {k: [rows[k].iloc[0]] * len(merged) for k in keys}
        return pd.DataFrame(held | {"run": range(1, len(merged) + 1), "label": [m[0] for m in merged], "n": [m[1] for m in merged]})

    return runs.groupBy(*keys).applyInPandas(fold, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", run long, label string, n long")


def sub_windows(spans: DataFrame, window_us: int) -> DataFrame:
    """Spans (start_us, end_us) cut into windows (slot, from_us, to_us); the last one takes the rest, a short span is one."""
    last = F.greatest(F.floor((F.col("end_us") - F.col("start_us")) / window_us), F.lit(1)).cast("long") - 1
    cut = spans.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begin = F.col("start_us") + F.col("slot") * window_us
    return cut.withColumns({"from_us": begin, "to_us": F.when(F.col("slot") == last, F.col("end_us")).otherwise(begin + window_us)})


def within_spans(spans: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames (meeting_id, at_us and more) with the span (start_us, end_us and more) of their meeting that they lie in.

    Spans of a meeting don't overlap: each frame takes the latest one begun, in one ordered pass, and none else.
    """
    own = [c for c in spans.columns if c != "meeting_id"]
    rest = [c for c in frames.columns if c != "meeting_id"]
    starts = spans.select("meeting_id", F.col("start_us").alias("at"), F.lit(0).alias("kind"), F.struct(*own).alias("of"), F.lit(None).cast(frames.select(F.struct(*rest)).dtypes[0][1]).alias("frame"))
    marks = frames.select("meeting_id", F.col("at_us").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["of"].dataType).alias("of"), F.struct(*rest).alias("frame"))
    latest = F.last("of", True).over(Window.partitionBy("meeting_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = starts.unionByName(marks).withColumn("of", latest).filter((F.col("kind") == 1) & (F.col("at") <= F.col("of.end_us")))
    return found.select("meeting_id", "of.*", "frame.*")


def split_by_dominance(spans: DataFrame, frames: DataFrame, window_us: int, least_us: int, ratio: float = RATIO) -> DataFrame:
    """Spans (meeting_id, span, start_us, end_us) cut where the dominant channel changes for good: part, label, start_us, end_us.

    Windows of ``window_us`` get the louder channel of their frames (meeting_id, at_us, channel, energy); mixed ones take
    their neighbour's, and runs under ``least_us`` go into the longer neighbour. A span of less than two windows, or of
    one channel, stays whole.
    """
    last = F.greatest(F.floor((F.col("end_us") - F.col("start_us")) / window_us), F.lit(1)).cast("long") - 1
    placed = within_spans(spans, frames).withColumn("slot", F.least(F.floor((F.col("at_us") - F.col("start_us")) / window_us).cast("long"), last))
    levels = channel_levels(placed, ["meeting_id", "span", "slot"])
    none = F.lit(0.0)
    slots = sub_windows(spans, window_us).join(levels, ["meeting_id", "span", "slot"], "left")
    slots = slots.withColumn("label", dominance(F.coalesce("mic", none), F.coalesce("system", none), ratio))
    keys = ["meeting_id", "span"]
    runs = absorb(label_runs(fill_labels(slots, keys, "slot"), keys, "slot", "filled"), keys, max(1, round(least_us / window_us)))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("run"))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    cut = runs.withColumns({"upto": upto, "of": whole}).join(spans, keys)
    stop = F.when(F.col("upto") == F.col("of"), F.col("end_us")).otherwise(F.col("start_us") + F.col("upto") * window_us)
    return cut.select(*keys, F.col("run").alias("part"), "label", (F.col("start_us") + (F.col("upto") - F.col("n")) * window_us).alias("start_us"), stop.alias("end_us"))


def speech_segments(marks: DataFrame, frame_us: int, gap_us: int, longest_us: int, pad_us: int, least_us: int) -> DataFrame:
    """Utterances from flagged frames: sessions of them, cut at the greatest length, without the short ones, padded on both sides.

    ``speech_us`` is the length without padding; a padded start stays at 0 or above.
    """
    held = sessions(marks, gap_us, longest_us).withColumn("speech_us", F.col("end_us") + frame_us - F.col("start_us")).filter(F.col("speech_us") >= least_us)
    return held.select("meeting_id", "session", "part", F.greatest(F.col("start_us") - pad_us, F.lit(0)).alias("start_us"), (F.col("end_us") + frame_us + pad_us).alias("end_us"), "speech_us")


def reblock(chunks: DataFrame, key: str, order: str, values: str, size: int) -> DataFrame:
    """Chunks of any length, in order, as blocks of ``size`` values (key, block, values, full); the last one may lack some.

    A chunk knows where it begins by a running sum of lengths; its values then find their block alone.
    """
    ends = F.sum(F.size(values)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    begun = chunks.withColumn("from", ends - F.size(values)).select(key, "from", F.posexplode(values).alias("at", "x"))
    placed = begun.select(key, F.floor((F.col("from") + F.col("at")) / size).cast("long").alias("block"), (F.col("from") + F.col("at")).alias("place"), "x")
    blocks = placed.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("held"))
    return blocks.select(key, "block", F.transform("held", lambda v: v["x"]).alias(values), (F.size("held") == size).alias("full"))


def retained(frames: DataFrame, keep_us: int) -> DataFrame:
    """The frames that end within ``keep_us`` of their meeting's last end."""
    last = F.max("end_us").over(Window.partitionBy("meeting_id"))
    return frames.withColumn("last_us", last).filter(F.col("end_us") > F.col("last_us") - keep_us).drop("last_us")


def buffer_from(processed: Column, speech_start: Column, pad: int, block: int, idle: int) -> Column:
    """The first sample to keep: some before the phrase that goes on, else the last ``idle`` ones; 0 at least."""
    return F.greatest(F.coalesce(speech_start - pad - block, processed - idle), F.lit(0))


def sessions(marks: DataFrame, gap_us: int, longest_us: int) -> DataFrame:
    """Speech sessions per meeting: marks at most ``gap_us`` apart, cut anew every ``longest_us`` from a session's start."""
    by = Window.partitionBy("meeting_id").orderBy("start_us", "id")
    new = F.coalesce(F.col("start_us") - F.lag("start_us").over(by) > gap_us, F.lit(True)).cast("long")
    told = marks.withColumn("_new", new).withColumn("session", F.sum("_new").over(by))
    begun = told.withColumn("_begin", F.min("start_us").over(Window.partitionBy("meeting_id", "session")))
    cut = begun.withColumn("part", F.floor((F.col("start_us") - F.col("_begin")) / longest_us).cast("long"))
    return cut.groupBy("meeting_id", "session", "part").agg(F.count("*").alias("marks"), F.min("start_us").alias("start_us"), F.max("start_us").alias("end_us"))


def align(frames: DataFrame, slot_us: int) -> DataFrame:
    """Both channels on one axis of slots, summed and clipped to 1; what a channel lacks is silence."""
    slotted = frames.withColumn("slot", F.floor(F.col("start_us") / slot_us).cast("long")).withColumn("x", F.col("energy") / 100)
    side = lambda c: slotted.filter(F.col("channel") == c).groupBy("slot").agg(F.max("x").alias(c))
    both = side("mic").join(side("system"), "slot", "full")
    zero = F.lit(0.0)
    return both.select("slot", F.greatest(F.least(F.coalesce("mic", zero) + F.coalesce("system", zero), F.lit(1.0)), F.lit(-1.0)).alias("value"))


HOUR = 3_600_000_000


def _slots(spark, d):
    rows = timed_segments(spark, d).withColumn("slot", F.floor(F.col("start_us") / HOUR).cast("long"))
    levels = channel_levels(rows, ["meeting_id", "slot"])
    return levels.select("meeting_id", "slot", dominance(F.col("mic"), F.col("system"), 1.2).alias("label"))


def _filled(spark, d):
    return fill_labels(_slots(spark, d), ["meeting_id"], "slot")


_ZERO = 1_704_067_200_000_000


def _from_zero(spark, d):
    """Times from the first day on."""
    return timed_segments(spark, d).withColumns({"start_us": F.col("start_us") - _ZERO, "end_us": F.col("end_us") - _ZERO})


def _split(spark, d):
    rows = timed_segments(spark, d)
    spans = sessions(rows, 900_000_000, 1 << 60).select("meeting_id", F.col("session").alias("span"), "start_us", "end_us")
    return split_by_dominance(spans, rows.select("meeting_id", F.col("start_us").alias("at_us"), "channel", "energy"), 300_000_000, 600_000_000, 1.2)


_DOM = "CASE WHEN mic > 0 AND sys <= 0 THEN 'mic' WHEN sys > 0 AND mic <= 0 THEN 'system' WHEN mic > sys * {r} THEN 'mic' WHEN sys > mic * {r} THEN 'system' ELSE 'mixed' END"
_LEVELS = "coalesce(sqrt(avg(CASE WHEN channel = 'mic' THEN energy * energy END)), 0) AS mic, coalesce(sqrt(avg(CASE WHEN channel = 'system' THEN energy * energy END)), 0) AS sys"
_SLOTS = f"(SELECT meeting_id, slot, {_DOM.format(r=1.2)} AS label FROM (SELECT meeting_id, start_us // {HOUR} AS slot, {_LEVELS} FROM {TIMED} GROUP BY ALL))"
_FILLED = f"""(SELECT meeting_id, slot, label, coalesce(last_value(CASE WHEN label <> 'mixed' THEN label END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(CASE WHEN label <> 'mixed' THEN label END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'mixed') AS filled FROM {_SLOTS})"""
_SESSIONS = f"""WITH m AS (SELECT *, coalesce(start_us - lag(start_us) OVER w > 600000000, true)::BIGINT AS fresh FROM {TIMED} WINDOW w AS (PARTITION BY meeting_id ORDER BY start_us, id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY meeting_id ORDER BY start_us, id) AS session FROM m),
  b AS (SELECT *, (start_us - min(start_us) OVER (PARTITION BY meeting_id, session)) // 1800000000 AS part FROM s)
  SELECT meeting_id, session::BIGINT AS session, part, count(*) AS marks, min(start_us) AS start_us, max(start_us) AS end_us FROM b GROUP BY meeting_id, session, part"""

QUERIES = {
    "channel_dominance": lambda s, d: channel_levels(timed_segments(s, d), ["meeting_id"]).select("meeting_id", F.round("mic", 6).alias("mic"), F.round("system", 6).alias("system"), dominance(F.col("mic"), F.col("system"), 1.05).alias("label")),
    "dominance_fill": _filled,
    "dominance_runs": lambda s, d: label_runs(_filled(s, d), ["meeting_id"], "slot", "filled"),
    "dominance_absorb": lambda s, d: absorb(label_runs(_filled(s, d), ["meeting_id"], "slot", "filled"), ["meeting_id"], 2),
    "speech_sessions": lambda s, d: sessions(timed_segments(s, d), 600_000_000, 1_800_000_000),
    "sub_windows": lambda s, d: sub_windows(timed_segments(s, d).select("id", "start_us", "end_us"), 250_000),
    "dominance_split": _split,
    "speech_segments": lambda s, d: speech_segments(_from_zero(s, d), 20_000_000, 600_000_000, 1_800_000_000, 150_000_000, 60_000_000),
    "frame_blocks": lambda s, d: reblock(voice_prints(s, d), "speaker_id", "id", "centroid", 48).select("speaker_id", "block", "full", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.size("centroid").cast("long").alias("n")),
    "frames_retained": lambda s, d: retained(timed_segments(s, d).select("meeting_id", "id", "end_us"), 7_200_000_000),
    "buffer_start": lambda s, d: _from_zero(s, d).select("id", buffer_from(F.col("end_us"), F.when(F.col("channel") == "mic", F.col("start_us")), 2_400, 512, 32_000).alias("keep_from")),
    "frame_align": lambda s, d: align(timed_segments(s, d), 60_000_000).withColumn("value", F.round("value", 6)),
}

_ZEROED = f"(SELECT * REPLACE (start_us - {_ZERO} AS start_us, end_us - {_ZERO} AS end_us) FROM {TIMED})"
_RUN = "{{'l': x[{at}].l, 'n': {n}}}"
_N = "x[k {0}].n + x[k].n"
_ABSORBED = f"""CASE WHEN k = 1 THEN [{_RUN.format(at=2, n="x[1].n + x[2].n")}] || x[3:] WHEN k = len(x) THEN x[1:k - 2] || [{_RUN.format(at="k - 1", n=_N.format("- 1"))}]
  WHEN x[k - 1].l = x[k + 1].l THEN x[1:k - 2] || [{_RUN.format(at="k - 1", n="x[k - 1].n + x[k].n + x[k + 1].n")}] || x[k + 2:]
  WHEN x[k - 1].n >= x[k + 1].n THEN x[1:k - 2] || [{_RUN.format(at="k - 1", n=_N.format("- 1"))}] || x[k + 1:] ELSE x[1:k - 1] || [{_RUN.format(at="k + 1", n=_N.format("+ 1"))}] || x[k + 2:] END"""
SQL = {
    "sub_windows": f"""WITH t AS (SELECT id, start_us, end_us, greatest((end_us - start_us) // 250000, 1) - 1 AS last FROM {TIMED}), s AS (SELECT *, unnest(range(last + 1)) AS slot FROM t)
      SELECT id, start_us, end_us, slot, start_us + slot * 250000 AS from_us, CASE WHEN slot = last THEN end_us ELSE start_us + (slot + 1) * 250000 END AS to_us FROM s""",
    "speech_segments": f"""WITH x AS ({_SESSIONS.replace(TIMED, _ZEROED)}) SELECT meeting_id, session, part, greatest(start_us - 150000000, 0) AS start_us, end_us + 20000000 + 150000000 AS end_us, end_us + 20000000 - start_us AS speech_us FROM x WHERE end_us + 20000000 - start_us >= 60000000""",
    "frame_blocks": f"""WITH v AS (SELECT speaker_id, id, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM {PRINTS}), n AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY id, i) - 1 AS p FROM v)
      SELECT speaker_id, p // 48 AS block, count(*) = 48 AS "full", round(arg_min(x, p), 6) AS first, count(*) AS n FROM n GROUP BY ALL""",
    "frames_retained": f"SELECT meeting_id, id, end_us FROM (SELECT *, max(end_us) OVER (PARTITION BY meeting_id) AS last FROM {TIMED}) WHERE end_us > last - 7200000000",
    "buffer_start": f"SELECT id, greatest(CASE WHEN channel = 'mic' THEN start_us - 2912 ELSE end_us - 32000 END, 0) AS keep_from FROM {_ZEROED}",
    "channel_dominance": f"SELECT meeting_id, round(mic, 6) AS mic, round(sys, 6) AS system, {_DOM.format(r=1.05)} AS label FROM (SELECT meeting_id, {_LEVELS} FROM {TIMED} GROUP BY meeting_id)",
    "dominance_fill": f"SELECT * FROM {_FILLED}",
    "dominance_runs": f"""WITH m AS (SELECT *, coalesce(filled <> lag(filled) OVER w, true)::BIGINT AS fresh FROM {_FILLED} WINDOW w AS (PARTITION BY meeting_id ORDER BY slot)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY meeting_id ORDER BY slot) AS run FROM m)
      SELECT meeting_id, run::BIGINT AS run, min(filled) AS label, count(*) AS n, min(slot) AS first_slot, max(slot) AS last_slot FROM r GROUP BY meeting_id, run""",
    "dominance_absorb": f"""WITH RECURSIVE m AS (SELECT *, coalesce(filled <> lag(filled) OVER w, true)::BIGINT AS fresh FROM {_FILLED} WINDOW w AS (PARTITION BY meeting_id ORDER BY slot)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY meeting_id ORDER BY slot) AS run FROM m), u AS (SELECT meeting_id, run, min(filled) AS l, count(*) AS n FROM r GROUP BY meeting_id, run),
      a AS (SELECT meeting_id, 0 AS step, list({{'l': l, 'n': n}} ORDER BY run) AS x FROM u GROUP BY meeting_id UNION ALL
        SELECT meeting_id, step + 1, {_ABSORBED} FROM (SELECT *, list_position(list_transform(x, lambda e: e.n), list_min(list_transform(x, lambda e: e.n))) AS k FROM a) WHERE len(x) > 1 AND x[k].n < 2),
      z AS (SELECT meeting_id, unnest(x) AS e, generate_subscripts(x, 1) AS run FROM (SELECT meeting_id, arg_max(x, step) AS x FROM a GROUP BY meeting_id))
      SELECT meeting_id, run::BIGINT AS run, e.l AS label, e.n AS n FROM z""",
    "dominance_split": f"""WITH RECURSIVE g AS (SELECT *, coalesce(start_us - lag(start_us) OVER w > 900000000, true)::BIGINT AS fresh FROM {TIMED} WINDOW w AS (PARTITION BY meeting_id ORDER BY start_us, id)),
      o AS (SELECT *, sum(fresh) OVER (PARTITION BY meeting_id ORDER BY start_us, id)::BIGINT AS span FROM g),
      p AS (SELECT meeting_id, span, min(start_us) AS b, max(start_us) AS e, greatest((max(start_us) - min(start_us)) // 300000000, 1) AS slots FROM o GROUP BY meeting_id, span),
      v AS (SELECT meeting_id, span, slot, {_LEVELS} FROM (SELECT o.meeting_id, o.span, o.channel, o.energy, least((o.start_us - p.b) // 300000000, p.slots - 1) AS slot FROM o JOIN p ON p.meeting_id = o.meeting_id AND p.span = o.span) GROUP BY ALL),
      d AS (SELECT meeting_id, span, slot, {_DOM.format(r=1.2)} AS label FROM (SELECT k.meeting_id, k.span, k.slot, coalesce(v.mic, 0) AS mic, coalesce(v.sys, 0) AS sys FROM (SELECT meeting_id, span, unnest(range(slots)) AS slot FROM p) k LEFT JOIN v ON v.meeting_id = k.meeting_id AND v.span = k.span AND v.slot = k.slot)),
      f AS (SELECT meeting_id, span, slot, coalesce(last_value(CASE WHEN label <> 'mixed' THEN label END IGNORE NULLS) OVER (PARTITION BY meeting_id, span ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(CASE WHEN label <> 'mixed' THEN label END IGNORE NULLS) OVER (PARTITION BY meeting_id, span ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'mixed') AS filled FROM d),
      m AS (SELECT *, coalesce(filled <> lag(filled) OVER w, true)::BIGINT AS fresh FROM f WINDOW w AS (PARTITION BY meeting_id, span ORDER BY slot)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY meeting_id, span ORDER BY slot) AS run FROM m), u AS (SELECT meeting_id, span, run, min(filled) AS l, count(*) AS n FROM r GROUP BY meeting_id, span, run),
      a AS (SELECT meeting_id, span, 0 AS step, list({{'l': l, 'n': n}} ORDER BY run) AS x FROM u GROUP BY meeting_id, span UNION ALL
        SELECT meeting_id, span, step + 1, {_ABSORBED} FROM (SELECT *, list_position(list_transform(x, lambda e: e.n), list_min(list_transform(x, lambda e: e.n))) AS k FROM a) WHERE len(x) > 1 AND x[k].n < 2),
      z AS (SELECT meeting_id, span, unnest(x) AS e, generate_subscripts(x, 1)::BIGINT AS part, list_transform(x, lambda y: y.n) AS ns FROM (SELECT meeting_id, span, arg_max(x, step) AS x FROM a GROUP BY meeting_id, span))
      SELECT z.meeting_id, z.span, part, z.e.l AS label, (p.b + coalesce(list_sum(ns[1:part - 1]), 0) * 300000000)::BIGINT AS start_us, CASE WHEN part = len(ns) THEN p.e ELSE p.b + list_sum(ns[1:part]) * 300000000 END::BIGINT AS end_us FROM z JOIN p ON p.meeting_id = z.meeting_id AND p.span = z.span""",
    "speech_sessions": _SESSIONS,
    "frame_align": f"""WITH s AS (SELECT start_us // 60000000 AS slot, channel, max(energy / 100) AS x FROM {TIMED} WHERE channel <> 'mixed' GROUP BY ALL)
      SELECT slot, round(greatest(least(coalesce(m.x, 0) + coalesce(y.x, 0), 1.0), -1.0), 6) AS value FROM (SELECT * FROM s WHERE channel = 'mic') m FULL JOIN (SELECT * FROM s WHERE channel = 'system') y USING (slot)""",
}
