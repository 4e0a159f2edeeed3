"""Order-dependent operators as folds over ordered rows, and speech sessions as a structured stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.steps import BACKOFF_MOST_S, BACKOFF_S, DONOR_US, GAP_S, LEAST_CHARS, LEAST_SPEECH_US, MOST_ERRORS, RECENT_US, SKIP_MOST_S, SKIP_STEP_S, Library, Live, MatchRules, Trigger, TurnLibrary, match_step, trigger_step
from ..operators.ranks import ranked
from ..operators.signal import SQL as SIGNAL_SQL
from ..operators.signal import sessions
from ..operators.vectors import STEPS, assignment_errors
from ..sources.lens import PRINTS, SPOKEN, TIMED, table, timed_segments, transcript, voice_prints
from .live import ATTRIBUTED, attributed_frame, in_order, live_step, told, told_of


def match_online(utterances: DataFrame, key: str = "stream") -> DataFrame:
    """Identity matching that learns as it goes: one library per ``key``, its rows in order of id.

    The state is a total order's: rows of a key go through one task, sorted, in batches, and only the library is held.
    Independent streams run in parallel; a corpus that needs no learning takes ``match_frozen`` instead. A vector that
    cannot be compared (null, not finite, of another length) costs its row only: ``error`` says why, nothing is learned.
    """
    dealt = utterances.select(key, "id", "centroid", "mic", "seconds").repartition(key).sortWithinPartitions(key, "id")
    kind = dict(dealt.dtypes)[key]

    def fold(batches):
        now, lib = object(), Library()
        for rows in batches:
            out = []
            for k, vector, mic, seconds in zip(rows[key], rows["centroid"], rows["mic"], rows["seconds"]):
                if k != now:
                    now, lib = k, Library()
                out.append(told(match_step, lib, vector, bool(mic), float(seconds)))
            yield pd.DataFrame({key: rows[key], "id": rows["id"], "speaker": pd.array([o[0] for o in out], dtype="Int64"), "similarity": pd.array([o[1] for o in out], dtype="Float64").round(6), "is_new": pd.array([o[2] for o in out], dtype="boolean"), "error": [o[3] for o in out]})

    return dealt.mapInPandas(fold, f"{key} {kind}, id long, speaker long, similarity double, is_new boolean, error string")


def threshold_simulation(prints: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, profiles, splits, merges): prints of all speakers by turns through the learning match, once per threshold.

    The order is total, so one task walks the prints of a threshold, and holds what its library keeps; thresholds run side
    by side. Turns come from ranges: no task orders a speaker.
    """
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    mixed = ranked(prints.select("speaker_id", "id", "centroid"), "speaker_id", ["id"], "turn").select(steps.alias("threshold"), "speaker_id", "turn", "centroid")
    dealt = mixed.repartition(8 * len(thresholds), "threshold").sortWithinPartitions("threshold", "turn", "speaker_id")

    def fold(batches):
        now, library = None, None
        for rows in batches:
            for threshold, part in rows.groupby("threshold"):
                if threshold != now:
                    now, library = threshold, TurnLibrary(MatchRules(threshold=threshold))
                yield pd.DataFrame({"threshold": threshold, "person": part["speaker_id"], "profile": library.take(part["centroid"].tolist())}).drop_duplicates()

    return assignment_errors(dealt.mapInPandas(fold, "threshold double, person long, profile long"), ["threshold"])


def attribute(utterances: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Who speaks, per meeting in order of time: too little speech takes a donor, the rest is matched with recent speakers favoured.

    Rows (meeting_id, id, channel, start_us, end_us, speech_us, centroid) of a meeting go through one task, sorted, in
    batches; the fold holds what a running meeting remembers. ``merges`` (meeting_id, start_us, source, target) reach it
    in their place, before utterances of the same time: from then on the two speakers are one. A row that cannot be
    attributed (a vector that is none, a null time) costs itself only: ``error`` says why, and the meeting goes on as if
    it had not been; rows of a null time come first in their meeting.
    """
    dealt = in_order(utterances, merges).repartition("meeting_id").sortWithinPartitions("meeting_id", "start_us", F.asc_nulls_first("id"))

    def fold(batches):
        now, live = object(), Live()
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                if row.meeting_id != now:
                    now, live = row.meeting_id, Live()
                if (found := live_step(live, row)) is not None:
                    out.append((row.meeting_id, row.id, *found))
            yield attributed_frame(out)

    return dealt.mapInPandas(fold, ATTRIBUTED)


def assemble(utterances: DataFrame, texts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, events): utterances with a text and their speaker, and what clients are told of them, in order.

    Utterances without text go before anybody is matched to them. A new speaker is told before the segment that brought
    it; events are (meeting_id, start_us, id, no, value).
    """
    said = utterances.join(texts.filter(F.length("text") > 0), ["meeting_id", "id"])
    segments = said.join(found, ["meeting_id", "id"], "left").select("meeting_id", "id", "channel", "start_us", "end_us", "text", "speaker", "similarity", F.coalesce("is_new", F.lit(False)).alias("is_new"))
    return segments, told_of(segments)


def hint_trigger(lines: DataFrame) -> DataFrame:
    """When the assistant would act: a state machine per meeting over (now, chars, outcome) rows in order."""
    dealt = lines.select("meeting_id", "id", "now", "chars", "outcome").repartition("meeting_id").sortWithinPartitions("meeting_id", "now", "id")

    def fold(batches):
        meeting, state = object(), Trigger()
        for rows in batches:
            fired, gaps = [], []
            for m, _, now, chars, outcome in rows.itertuples(index=False):
                if m != meeting:
                    meeting, state = m, Trigger()
                state, hit = trigger_step(state, float(now), int(chars), outcome)
                fired.append(hit)
                gaps.append(state.gap)
            yield pd.DataFrame({"meeting_id": rows["meeting_id"], "id": rows["id"], "fired": fired, "gap": gaps})

    return dealt.mapInPandas(fold, "meeting_id long, id long, fired boolean, gap double")


def stream_sessions(spark, folder: str, gap: str, delay: str, out: str, checkpoint: str) -> DataFrame:
    """Session windows per meeting over Parquet files as they come, each closed once the watermark passes it.

    Append mode holds the last sessions back; what the watermark has not passed when the input ends comes from the batch path.
    """
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).parquet(folder)
    marks = events.select(F.col("ts").cast("timestamp").alias("at"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("meeting_id"))
    windows = marks.withWatermark("at", delay).groupBy("meeting_id", F.session_window("at", gap)).agg(F.count("*").alias("marks"), F.min("at").alias("first"), F.max("at").alias("last"))
    rows = windows.select("meeting_id", "marks", F.unix_micros("first").alias("start_us"), F.unix_micros("last").alias("end_us"))
    rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _online(spark, d):
    prints = voice_prints(spark, d)
    return match_online(prints.select((F.col("id") % 4).alias("stream"), "id", "centroid", (F.col("id") % 3 == 0).alias("mic"), F.lit(2.5).alias("seconds"))).drop("stream", "error")


def _triggers(spark, d):
    rows = table(spark, d, "conversations")
    outcome = F.when(F.col("turn") % 3 == 0, "skip").when(F.col("turn") % 5 == 1, "error").otherwise("ok")
    return hint_trigger(rows.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("id"), (F.col("turn") * 9.0).alias("now"), F.length("text").alias("chars"), outcome.alias("outcome")))


def _attributed(spark, d):
    """Every segment; those that have a print of their id bring its vector. Half-way through each meeting two speakers are merged."""
    rows = timed_segments(spark, d).withColumn("speech_us", F.when(F.col("id") % 3 == 0, 300_000).otherwise(2_500_000))
    half = rows.groupBy("meeting_id").agg(((F.min("start_us") + F.max("start_us")) / 2).cast("long").alias("start_us")).select("meeting_id", "start_us", F.lit(2).cast("long").alias("source"), F.lit(1).cast("long").alias("target"))
    return attribute(rows.join(voice_prints(spark, d).select("id", "centroid"), "id", "left"), half).drop("error")


def _events(spark, d):
    texts = transcript(spark, d).select("meeting_id", "id", F.when(F.col("id") % 4 != 3, F.col("text")).otherwise("").alias("text"))
    rows = transcript(spark, d).select("meeting_id", "id", F.lit("mic").alias("channel"), (F.col("start_s") * 1e6).cast("long").alias("start_us"), (F.col("start_s") * 1e6 + 900_000).cast("long").alias("end_us"))
    found = rows.select("meeting_id", "id", (F.col("id") % 2).alias("speaker"), F.lit(None).cast("double").alias("similarity"), (F.col("id") < 2).alias("is_new"))
    return assemble(rows, texts, found)[1].select("meeting_id", "id", F.col("no").cast("long").alias("no"), F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.speaker").cast("long").alias("speaker"), F.length(F.get_json_object("value", "$.text")).cast("long").alias("chars"))


QUERIES = {
    "voice_match_online": _online,
    "threshold_simulation": lambda s, d: threshold_simulation(voice_prints(s, d, "float"), STEPS),
    "attribution": _attributed,
    "segment_events": _events,
    "hint_trigger": _triggers,
    "session_windows": lambda s, d: sessions(timed_segments(s, d), 900_000_000, 1 << 60).drop("part"),
}
_FIRES = f"NOT f.off AND l.now >= f.until AND f.chars + l.n >= {LEAST_CHARS} AND l.now - f.last >= f.gap"
def _unit_sql(v: str) -> str:
    return f"CASE WHEN list_dot_product({v}, {v}) > 0 THEN list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v}))) ELSE {v} END"


def _match_sql(rows: str, threshold: str = "0.35") -> str:
    """The learning match in recursive SQL over ``rows`` (s, i, id, v, mic, seconds), v of length 1: (s, id, speaker, similarity, is_new).

    A step carries the library, a list of prints in its order: the first best of those that reach their own need wins.
    """
    return f"""(WITH RECURSIVE r AS ({rows}),
      f AS (SELECT s, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS speaker, NULL::DOUBLE AS sim, false AS fresh, 1::BIGINT AS next_id, []::STRUCT(sp BIGINT, v DOUBLE[], n BIGINT)[] AS lib FROM (SELECT DISTINCT s FROM r)
      UNION ALL SELECT s, i, id, speaker, sim, fresh, CASE WHEN fresh THEN next_id + 1 ELSE next_id END,
        CASE WHEN first_self OR fresh THEN list_append(lib, {{'sp': speaker, 'v': v, 'n': 1::BIGINT}})
          WHEN (speaker = 0) <> mic THEN lib
          WHEN sim >= {threshold} THEN list_concat(list_concat(lib[1:k - 1], [{{'sp': speaker, 'v': {_unit_sql("w")}, 'n': lib[k].n + 1}}]), lib[k + 1:])
          WHEN own < {MatchRules.most_prints} AND seconds >= {MatchRules.least_new_print_s} THEN list_concat(list_append(lib[1:final], {{'sp': speaker, 'v': v, 'n': 1::BIGINT}}), lib[final + 1:]) ELSE lib END
      FROM (SELECT *, list_transform(range(1, len(v) + 1), lambda j: (coalesce(lib[k].v[j], 0) * least(coalesce(lib[k].n, 1), {MatchRules.count_cap}) + v[j]) / (least(coalesce(lib[k].n, 1), {MatchRules.count_cap}) + 1)) AS w,
          len(list_filter(lib, lambda x: x.sp = speaker)) AS own, list_max(list_filter(range(1, len(lib) + 1), lambda j: lib[j].sp = speaker)) AS final
        FROM (SELECT *, CASE WHEN first_self THEN 0 WHEN k IS NULL THEN next_id ELSE lib[k].sp END::BIGINT AS speaker, NOT first_self AND k IS NULL AS fresh, CASE WHEN first_self THEN NULL WHEN k IS NULL THEN list_max(sims) ELSE sims[k] END AS sim
          FROM (SELECT *, CASE WHEN NOT first_self THEN list_min(list_filter(able, lambda j: sims[j] = list_max(list_transform(able, lambda x: sims[x])))) END AS k
            FROM (SELECT *, mic AND len(list_filter(lib, lambda x: x.sp = 0)) = 0 AS first_self, list_filter(range(1, len(lib) + 1), lambda j: sims[j] >= {threshold} - CASE WHEN mic AND lib[j].sp = 0 THEN {MatchRules.self_bonus} ELSE 0 END) AS able
              FROM (SELECT r.s, r.i, r.id, r.v, r.mic, r.seconds, f.next_id, f.lib, list_transform(f.lib, lambda x: list_dot_product(x.v, r.v)) AS sims FROM f JOIN r ON r.s = f.s AND r.i = f.i + 1))))))
      SELECT s, id, speaker, sim AS similarity, fresh AS is_new FROM f WHERE i > 0)"""


_ONLINE = f"SELECT id % 4 AS s, row_number() OVER (PARTITION BY id % 4 ORDER BY id) AS i, id, {_unit_sql('centroid')} AS v, id % 3 = 0 AS mic, 2.5::DOUBLE AS seconds FROM {PRINTS}"
_TURNS = f"SELECT 0 AS s, row_number() OVER (ORDER BY turn, speaker_id) AS i, speaker_id AS id, {_unit_sql('centroid')} AS v, false AS mic, 0.0::DOUBLE AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY id) AS turn FROM {PRINTS})"


def _simulated_sql(threshold: float) -> str:
    """Profiles, splits and merges of one threshold: ``id`` of the match is the person."""
    return f"""(WITH h AS (SELECT DISTINCT id AS person, speaker AS profile FROM {_match_sql(_TURNS, str(threshold))})
      SELECT {threshold}::DOUBLE AS threshold, (SELECT count(DISTINCT profile) FROM h) AS profiles, (SELECT count(*) FROM (SELECT person FROM h GROUP BY person HAVING count(*) > 1)) AS splits,
        (SELECT count(*) FROM (SELECT DISTINCT a.person, b.person FROM h a JOIN h b ON a.profile = b.profile AND a.person < b.person)) AS merges)"""


_MEETING_ROWS = f"""SELECT *, row_number() OVER (PARTITION BY m ORDER BY a, id NULLS FIRST) AS i FROM (
        SELECT t.meeting_id AS m, t.id, {_unit_sql('p.centroid')} AS v, t.channel AS ch, t.start_us AS a, t.end_us AS b, CASE WHEN t.id % 3 = 0 THEN 300000 ELSE 2500000 END AS speech, NULL::BIGINT AS source, NULL::BIGINT AS target FROM {TIMED} t LEFT JOIN {PRINTS} p ON p.id = t.id
        UNION ALL SELECT meeting_id, NULL, NULL, NULL, (min(start_us) + max(start_us)) // 2, NULL, NULL, 2, 1 FROM {TIMED} GROUP BY meeting_id)"""
_NEED = f"{MatchRules.threshold} - greatest(CASE WHEN ch = 'mic' AND lib[j].sp = 0 THEN {MatchRules.self_bonus} ELSE 0 END, CASE WHEN list_contains(near, lib[j].sp) THEN {MatchRules.recent_bonus} ELSE 0 END)"
#: Attribution with merges; a step carries the library, each channel's last speaker and each speaker's last end.
_ATTRIBUTED_SQL = f"""WITH RECURSIVE r AS ({_MEETING_ROWS}),
      f AS (SELECT m, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS speaker, NULL::DOUBLE AS sim, false AS fresh, 1::BIGINT AS next_id, []::STRUCT(sp BIGINT, v DOUBLE[], n BIGINT)[] AS lib, []::STRUCT(ch VARCHAR, e BIGINT, sp BIGINT)[] AS last, []::STRUCT(sp BIGINT, e BIGINT)[] AS recent FROM (SELECT DISTINCT m FROM r)
      UNION ALL SELECT m, i, id, speaker, sim, fresh, CASE WHEN fresh THEN next_id + 1 ELSE next_id END,
        CASE WHEN source IS NOT NULL THEN list_concat(list_concat(rest[1:target_at], list_transform(list_filter(lib, lambda x: x.sp = source), lambda x: {{'sp': target, 'v': x.v, 'n': x.n}})), rest[target_at + 1:])
          WHEN NOT voiced THEN lib WHEN first_self OR fresh THEN list_append(lib, {{'sp': speaker, 'v': v, 'n': 1::BIGINT}})
          WHEN (speaker = 0) <> (ch = 'mic') THEN lib
          WHEN sim >= {MatchRules.threshold} THEN list_concat(list_concat(lib[1:k - 1], [{{'sp': speaker, 'v': {_unit_sql("w")}, 'n': lib[k].n + 1}}]), lib[k + 1:])
          WHEN own < {MatchRules.most_prints} AND speech / 1e6 >= {MatchRules.least_new_print_s} THEN list_concat(list_append(lib[1:final], {{'sp': speaker, 'v': v, 'n': 1::BIGINT}}), lib[final + 1:]) ELSE lib END,
        CASE WHEN source IS NOT NULL THEN list_transform(last, lambda x: {{'ch': x.ch, 'e': x.e, 'sp': CASE WHEN x.sp = source THEN target ELSE x.sp END}}) WHEN speaker IS NULL THEN last ELSE list_append(list_filter(last, lambda x: x.ch <> ch), {{'ch': ch, 'e': b, 'sp': speaker}}) END,
        CASE WHEN source IS NOT NULL THEN list_filter(recent, lambda x: x.sp <> source) WHEN speaker IS NULL THEN recent ELSE list_append(list_filter(recent, lambda x: x.sp <> speaker), {{'sp': speaker, 'e': b}}) END
      FROM (SELECT *, list_transform(range(1, coalesce(len(v), 0) + 1), lambda j: (coalesce(lib[k].v[j], 0) * least(coalesce(lib[k].n, 1), {MatchRules.count_cap}) + v[j]) / (least(coalesce(lib[k].n, 1), {MatchRules.count_cap}) + 1)) AS w,
          len(list_filter(lib, lambda x: x.sp = speaker)) AS own, list_max(list_filter(range(1, len(lib) + 1), lambda j: lib[j].sp = speaker)) AS final, coalesce(list_max(list_filter(range(1, len(rest) + 1), lambda j: rest[j].sp = target)), len(rest)) AS target_at
        FROM (SELECT *, CASE WHEN source IS NOT NULL THEN NULL WHEN NOT voiced THEN donor WHEN first_self THEN 0 WHEN k IS NULL THEN next_id ELSE lib[k].sp END::BIGINT AS speaker, voiced AND NOT first_self AND k IS NULL AS fresh,
            CASE WHEN NOT voiced OR first_self THEN NULL WHEN k IS NULL THEN list_max(sims) ELSE sims[k] END AS sim, list_filter(lib, lambda x: source IS NULL OR x.sp <> source) AS rest
          FROM (SELECT *, CASE WHEN voiced AND NOT first_self THEN list_min(list_filter(able, lambda j: sims[j] = list_max(list_transform(able, lambda x: sims[x])))) END AS k
            FROM (SELECT *, voiced AND ch = 'mic' AND len(list_filter(lib, lambda x: x.sp = 0)) = 0 AS first_self, list_filter(range(1, len(sims) + 1), lambda j: sims[j] >= {_NEED}) AS able
              FROM (SELECT r.*, f.next_id, f.lib, f.last, f.recent, source IS NULL AND v IS NOT NULL AND speech >= {LEAST_SPEECH_US} AS voiced, CASE WHEN v IS NOT NULL THEN list_transform(f.lib, lambda x: list_dot_product(x.v, r.v)) ELSE [] END AS sims,
                  list_transform(list_filter(f.recent, lambda x: r.a - x.e BETWEEN 0 AND {RECENT_US}), lambda x: x.sp) AS near,
                  (list_sort(list_transform(list_filter(f.last, lambda x: (x.ch = r.ch OR x.ch = 'mixed' OR r.ch = 'mixed') AND r.a - x.e < {DONOR_US}), lambda x: {{'e': x.e, 'sp': x.sp}}), 'DESC')[1]).sp AS donor
                FROM f JOIN r ON r.m = f.m AND r.i = f.i + 1))))))
      SELECT m AS meeting_id, id, speaker, round(sim, 6) AS similarity, fresh AS is_new FROM f WHERE id IS NOT NULL"""


SQL = {
    "attribution": _ATTRIBUTED_SQL,
    "voice_match_online": f"SELECT id, speaker, round(similarity, 6) AS similarity, is_new FROM {_match_sql(_ONLINE)}",
    "threshold_simulation": " UNION ALL ".join(_simulated_sql(t) for t in STEPS),
    "session_windows": SIGNAL_SQL["speech_sessions"].replace("600000000", "900000000").replace("1800000000", str(1 << 60)).replace(" part, count", " count").replace(", session, part", ", session"),
    "segment_events": f"""SELECT meeting_id, id, no, CASE no WHEN 0 THEN 'speaker_new' ELSE 'segment' END AS type, id % 2 AS speaker, CASE no WHEN 1 THEN length(text) END AS chars FROM {SPOKEN}, (VALUES (0::BIGINT), (1)) AS v(no) WHERE id % 4 <> 3 AND length(text) > 0 AND (no = 1 OR id < 2)""",
    "hint_trigger": f"""WITH RECURSIVE l AS (SELECT conv_id AS m, turn AS id, turn * 9.0::DOUBLE AS now, length(text) AS n, CASE WHEN turn % 3 = 0 THEN 'skip' WHEN turn % 5 = 1 THEN 'error' ELSE 'ok' END AS o, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
      f AS (SELECT m, -1::BIGINT AS id, 0::BIGINT AS i, 0::BIGINT AS chars, -1e18::DOUBLE AS last, {GAP_S}::DOUBLE AS gap, 0::BIGINT AS skips, 0::BIGINT AS errors, -1e18::DOUBLE AS until, false AS off, false AS fired FROM (SELECT DISTINCT m FROM l)
        UNION ALL SELECT l.m, l.id, l.i, CASE WHEN {_FIRES} THEN 0 ELSE f.chars + l.n END, CASE WHEN {_FIRES} THEN l.now ELSE f.last END,
          CASE WHEN {_FIRES} AND o = 'ok' THEN {GAP_S} WHEN {_FIRES} AND o = 'skip' THEN least({SKIP_STEP_S} * (f.skips + 1), {SKIP_MOST_S}) ELSE f.gap END, CASE WHEN {_FIRES} AND o = 'ok' THEN 0 WHEN {_FIRES} AND o = 'skip' THEN f.skips + 1 ELSE f.skips END,
          CASE WHEN {_FIRES} AND o = 'error' THEN f.errors + 1 WHEN {_FIRES} THEN 0 ELSE f.errors END, CASE WHEN {_FIRES} AND o = 'error' THEN l.now + least({BACKOFF_S} * 2 ** (f.errors + 1), {BACKOFF_MOST_S}) WHEN {_FIRES} AND o = 'ok' THEN -1e18 ELSE f.until END,
          f.off OR ({_FIRES} AND o = 'error' AND f.errors + 1 >= {MOST_ERRORS}), {_FIRES} FROM f JOIN l ON l.m = f.m AND l.i = f.i + 1)
      SELECT m AS meeting_id, id, fired, gap FROM f WHERE i > 0""",
}
