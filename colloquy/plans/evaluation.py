"""Evaluation and telemetry: percentiles, slopes, rates, verdicts and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lens import TIMED, table, timed_segments


#: Ranges of values that a key's values are counted in.
RANGES = 1_024


def values_at_ranks(rows: DataFrame, key: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """Per key its number of values ``n``, and those at ``ranks`` (1-based, from ``n``) in their order.

    Equal values are counted first; ranges of values are counted next, and only the range that holds a rank is put in
    order: no key's values meet in one task.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    whole = counts.groupBy(F.col("key").alias("of")).agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / RANGES
    ranged = counts.join(whole, F.col("key").eqNullSafe(F.col("of"))).withColumn("range", F.when(width > 0, F.floor((F.col("x") - F.col("lo")) / width)).otherwise(0).cast("long"))
    sums = ranged.groupBy("key", "range").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy("key").orderBy("range"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])).alias("a")
    holding = sums.withColumn("before", upto - F.col("c")).select(F.col("key").alias("of_key"), F.col("range").alias("of_range"), "before", "c", asked)
    holding = holding.filter((F.col("a.rank") > F.col("before")) & (F.col("a.rank") <= F.col("before") + F.col("c"))).drop("c")
    inside = F.sum("c").over(Window.partitionBy("key", "range", "a.name").orderBy("x"))
    near = ranged.join(holding, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("range") == F.col("of_range"))).withColumn("end", F.col("before") + inside)
    hit = near.filter((F.col("end") >= F.col("a.rank")) & (F.col("end") - F.col("c") < F.col("a.rank")))
    return hit.groupBy(F.col("key").alias(key)).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("a.name") == name, F.col("x"))).alias(name) for name in ranks])


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median, the mean of the two middle values, and nearest-rank 95th percentile per key."""
    n = F.col("n")
    found = values_at_ranks(rows, key, value, {"lower": F.floor((n + 1) / 2), "higher": F.floor((n + 2) / 2), "p95": F.ceil(n * 95 / 100)})
    return found.select(key, F.round((F.col("lower") + F.col("higher")) / 2, 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


def naive_p95(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value at place floor(0.95 n), at least 1, of the sorted ones: kept to compare with old numbers."""
    return values_at_ranks(rows, key, value, {"p95": F.greatest(F.floor(F.col("n") * 95 / 100), F.lit(1))}).select(key, F.round("p95", 6).alias("p95"))


def late_slope(samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Growth per hour over the later half of each key's samples, the middle one included; under three of them 0.

    The time at the middle rank comes from counts by ranges, the slope from sums (n, t, v, tt, tv) that tasks add up:
    no key's samples meet in one task. Where several samples share the middle's time, each counts with the share of them
    that belongs to the later half. Samples without a time are none; those without a value count in ``n`` alone.
    """
    rows = samples.select(F.col(key).alias("key"), F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v")).filter("t IS NOT NULL")
    middle = values_at_ranks(rows, "key", "t", {"middle": F.floor(F.col("n") / 2) + 1}).select(F.col("key").alias("of"), F.col("n").alias("all"), "middle")
    shifted = rows.join(middle, F.col("key").eqNullSafe(F.col("of"))).filter("t >= middle").withColumn("t", F.col("t") - F.col("middle"))
    told = F.col("v").isNotNull()
    total = lambda x, name: F.sum(F.when(told, x)).alias(name)
    sums = shifted.groupBy("key", "all", (F.col("t") == 0).alias("tied")).agg(F.count("*").alias("rows"), F.count("v").alias("n"), total(F.col("t"), "st"), total(F.col("v"), "sv"), total(F.col("t") * F.col("t"), "stt"), total(F.col("t") * F.col("v"), "stv"))
    # The later half has all - floor(all / 2) samples; the tied ones fill what the later ones leave.
    half = F.col("all") - F.floor(F.col("all") / 2)
    later = F.sum(F.when(~F.col("tied"), F.col("rows")).otherwise(0)).over(Window.partitionBy("key"))
    weighed = sums.withColumn("w", F.when(F.col("tied"), (half - later) / F.col("rows")).otherwise(1.0))  # two rows a key
    m = lambda c: F.coalesce(F.sum(F.col("w") * F.col(c)), F.lit(0.0))
    spread = m("n") * m("stt") - m("st") * m("st")
    slope = F.when((F.sum(F.col("w") * F.col("rows")) >= 2.5) & (spread > 0), (m("n") * m("stv") - m("st") * m("sv")) / spread * 3600).otherwise(0.0)
    return weighed.groupBy(F.col("key").alias(key)).agg(F.round(slope, 4).alias("per_hour"), F.round(F.sum(F.col("w") * F.col("rows"))).cast("long").alias("n"))


def early_late(marks: DataFrame, key: str, at: str, window: float) -> DataFrame:
    """Events per minute within ``window`` of the first and of the last; under four events (0, 0)."""
    rows = marks.select(F.col(key).alias("key"), F.col(at).alias("t"))
    ends = rows.groupBy(F.col("key").alias("of")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    told = rows.join(ends, F.col("key").eqNullSafe(F.col("of")))
    span = F.greatest(F.least(F.lit(window), F.max("last") - F.min("first")), F.lit(1e-6)) / 60
    rate = lambda near: F.round(F.when(F.count("*") >= 4, F.count_if(near) / span).otherwise(0.0), 6)
    return told.groupBy(F.col("key").alias(key)).agg(rate(F.col("t") - F.col("first") <= window).alias("early"), rate(F.col("last") - F.col("t") <= window).alias("late"))


def load_verdict(limit: float) -> Column:
    """The first sign that a load step failed, or null."""
    c = F.col
    return (
        F.when(c("restarted"), "restarted")
        .when(c("status") != "running", F.concat(F.lit("status "), c("status")))
        .when(c("errors") > 0, "errors")
        .when(c("segments") == 0, "nothing recognised")
        .when(c("segments") < c("meetings"), F.concat((c("meetings") - c("segments")).cast("string"), F.lit(" lost")))
        .when(c("p95") > limit, "slow")
    )


def rest_steps(requests: DataFrame, key: str) -> DataFrame:
    """Per key what became of its requests (status, ms): counts by kind and, as text, by status; 0 is no answer at all."""
    by_code = requests.groupBy(key, "status").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))
    code = F.col("status")
    count = lambda cond, to: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long").alias(to)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda c: F.concat_ws(":", c["status"].cast("string"), c["n"].cast("string"))), ",")
    return by_code.groupBy(key).agg(
        F.sum("n").cast("long").alias("total"), count(code.between(200, 299), "ok"), count(~code.between(200, 299), "failed"), count(code == 429, "rate_limited"), count(code >= 500, "server_errors"), count(code == 0, "network_errors"), listed.alias("codes")
    )


def rest_verdict(limit_ms: float) -> Column:
    """The first sign that a step of requests went badly, or null."""
    c = F.col
    return (
        F.when(c("network_errors") > 0, F.concat(F.lit("no answer: "), c("network_errors").cast("string")))
        .when(c("server_errors") > 0, F.concat(F.lit("5xx: "), c("server_errors").cast("string")))
        .when(c("rate_limited") > 0, F.concat(F.lit("429: "), c("rate_limited").cast("string")))
        .when(c("p95") > limit_ms, "slow")
    )


def running_peak(samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Samples with the greatest value of their key so far."""
    return samples.withColumn("peak", F.max(value).over(Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)))


def load_ratios(steps: DataFrame) -> DataFrame:
    """``steps`` (meetings, seconds, segments, wall_s) with how many times faster than speech they ran and segments per second."""
    per_wall = lambda x, places: F.when(F.col("wall_s") > 0, F.round(x / F.col("wall_s"), places)).otherwise(0.0)
    return steps.withColumns({"speedup": per_wall(F.col("meetings") * F.col("seconds"), 2), "rate": per_wall(F.col("segments"), 1)})


def growth(sizes: DataFrame, size: str, cost: str) -> DataFrame:
    """How many times the largest size and its cost are those of the smallest one; a cost of 0 gives 0."""
    ends = sizes.agg(F.max(size).alias("big"), F.min(size).alias("small"), F.max_by(cost, size).alias("late"), F.min_by(cost, size).alias("early"))
    return ends.select(F.round(F.col("big") / F.col("small"), 6).alias("grew_size"), F.round(F.when(F.col("early") != 0, F.col("late") / F.col("early")).otherwise(0.0), 6).alias("grew_cost"))


def worst_last(rows: DataFrame, measure: str, tie: str) -> DataFrame:
    """Rows by rising measure, the unknown first, with their place."""
    return rows.orderBy(F.asc_nulls_first(measure), tie)


def test_totals(cases: DataFrame) -> DataFrame:
    """Per suite, and for all (suite null): tests, passed, failed, skipped, the share passed and its bar."""
    of = lambda *names: F.count_if(F.col("status").isin(*names)).alias(names[0])
    totals = cases.rollup("suite").agg(F.count("*").alias("tests"), of("passed"), of("failed", "error"), of("skipped"))
    share = F.round(F.col("passed") / F.col("tests") * 100, 1)
    return totals.withColumns({"share": share, "bar": progress_bar(share)})


def offered_models(models: DataFrame, least_context: int = 32_768) -> DataFrame:
    """(offered, rejected): how many models a catalogue has that fit, and how many not."""
    return models.agg(F.count_if(fits(least_context)).alias("offered"), F.count_if(~fits(least_context)).alias("rejected"))


def window_chars(hint_tokens: Column, overhead_chars: Column, most: Column, least: int = 80, chars_per_token: float = 2.5) -> Column:
    """Characters of talk that fit a request for a hint: what the budget leaves beside the prompt, between ``least`` and ``most``; no budget is ``most``."""
    free = ((hint_tokens - overhead_chars / chars_per_token) * chars_per_token).cast("long")
    return F.when(hint_tokens == 0, most).otherwise(F.greatest(F.lit(least).cast("long"), F.least(most, free)))


def soak_verdict(slope: Column, early: Column, late: Column, minutes: Column) -> Column:
    return F.when(minutes < 10, "too short").when(slope > 50, "leak").when(slope > 15, "growing").when((late < early * 0.7) & (early > 0), "slowing").otherwise("stable")


def regression_problems(now: DataFrame, base: dict[str, float], slack: float = 0.02) -> DataFrame:
    """Measures that got worse: an error rate above its base and slack, more splits or more merges."""
    worse = [F.when(F.col("wer") > base["wer"] + slack, F.lit("wer")), F.when(F.col("splits") > base["splits"], F.lit("splits")), F.when(F.col("merges") > base["merges"], F.lit("merges"))]
    return now.withColumn("problems", F.concat_ws(",", *worse))


def ramp_limit(steps: DataFrame, load: str, verdict: str) -> DataFrame:
    """(last_ok, first_bad) over recorded load steps: the worst of a load's repeats counts, what comes after a failure doesn't."""
    worst = steps.groupBy(load).agg(F.max(F.col(verdict).isNotNull()).alias("bad"))
    first = worst.agg(F.min(F.when(F.col("bad"), F.col(load))).alias("first_bad"))
    fine = F.when(~F.col("bad") & (F.col("first_bad").isNull() | (F.col(load) < F.col("first_bad"))), F.col(load))
    return worst.join(F.broadcast(first)).agg(F.max(fine).alias("last_ok"), F.max("first_bad").alias("first_bad"))


def progress_bar(percent: Column, width: int = 22) -> Column:
    """Filled and empty blocks."""
    full = F.round(percent / 100 * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def _steps(spark, d):
    rows = timed_segments(spark, d)
    return rows.groupBy("meeting_id").agg(F.count_distinct("speaker_id").alias("meetings"), F.count_if(F.col("channel") == "mixed").alias("errors0"), F.count("*").alias("segments0"), F.max("energy").alias("p95")).select(
        "meeting_id", (F.col("meeting_id") % 7 == 6).alias("restarted"), F.when(F.col("meeting_id") % 5 == 4, "exited").otherwise("running").alias("status"), F.when(F.col("meeting_id") % 3 == 2, F.col("errors0")).otherwise(0).alias("errors"),
        F.when(F.col("meeting_id") % 4 == 1, F.lit(1)).otherwise(F.col("segments0")).alias("segments"), "meetings", "p95",
    )


_STEP = f"""(SELECT meeting_id, meeting_id % 7 = 6 AS restarted, CASE WHEN meeting_id % 5 = 4 THEN 'exited' ELSE 'running' END AS status, CASE WHEN meeting_id % 3 = 2 THEN count(*) FILTER (channel = 'mixed') ELSE 0 END AS errors,
  CASE WHEN meeting_id % 4 = 1 THEN 1 ELSE count(*) END AS segments, count(DISTINCT speaker_id) AS meetings, max(energy) AS p95 FROM {TIMED} GROUP BY meeting_id)"""
_S = "start_us / 1e6"


def _timed_s(spark, d):
    return timed_segments(spark, d).withColumn("t", (F.col("start_us") - 1704067200000000) / 1e6)


_T = f"(SELECT *, (start_us - 1704067200000000) / 1e6 AS t FROM {TIMED})"
_SLOPE = f"""(SELECT meeting_id, round(CASE WHEN count(*) >= 3 THEN coalesce(regr_slope(energy, t) * 3600, 0) ELSE 0 END, 4) AS per_hour, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY t) AS i, count(*) OVER (PARTITION BY meeting_id) AS k FROM {_T}) WHERE i > k // 2 GROUP BY meeting_id)"""
_RATES = f"""(SELECT meeting_id, round(CASE WHEN count(*) >= 4 THEN count(*) FILTER (t - f <= 7200) / (greatest(least(7200.0, max(l) - min(f)), 1e-6) / 60) ELSE 0 END, 6) AS early,
  round(CASE WHEN count(*) >= 4 THEN count(*) FILTER (l - t <= 7200) / (greatest(least(7200.0, max(l) - min(f)), 1e-6) / 60) ELSE 0 END, 6) AS late
  FROM (SELECT *, min(t) OVER (PARTITION BY meeting_id) AS f, max(t) OVER (PARTITION BY meeting_id) AS l FROM {_T}) GROUP BY meeting_id)"""


def _soak(spark, d):
    rows = _timed_s(spark, d)
    both = late_slope(rows, "meeting_id", "t", "energy").join(early_late(rows, "meeting_id", "t", 7200.0), "meeting_id")
    return both.select("meeting_id", soak_verdict(F.col("per_hour") * 100, F.col("early"), F.col("late"), F.col("n")).alias("verdict"))


def _rollup(spark, d):
    rows = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    counts = rows.rollup("o_orderpriority").agg(F.sum("n").cast("long").alias("total"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("n"))).cast("long").alias("passed"))
    return counts.withColumn("share", F.round(F.col("passed") / F.col("total") * 100, 6))


# Parts as a provider's models, as limits and as evaluation runs, by expressions that both engines read.
_MODEL = """concat('m', p_partkey) AS id, CAST(CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE p_size * 2048 END AS BIGINT) AS context, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN {text} WHEN 2 THEN {audio} ELSE {both} END AS modalities"""
_LIMIT = "p_partkey AS id, CAST(CASE p_size % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE p_size * 700 END AS BIGINT) AS tpm"
_RUN = "p_partkey AS run, CAST(p_size AS DOUBLE) / 1000 AS wer, CAST(p_partkey % 3 AS BIGINT) AS splits, CAST(p_partkey % 5 AS BIGINT) AS merges"


def _parts(spark, d, columns: str):
    names = {"text": "array('text')", "audio": "array('audio')", "both": "array('text', 'image')"}
    return table(spark, d, "part").selectExpr(*columns.format(**names).replace(", CAST", ",\0CAST").replace(", CASE", ",\0CASE").split(",\0"))


def _parts_sql(columns: str) -> str:
    return f"(SELECT {columns.format(text="['text']", audio="['audio']", both="['text', 'image']")} FROM part)"




def fits(least_context: int) -> Column:
    """Takes text and enough context, where that is known."""
    return F.coalesce(F.array_contains("modalities", "text"), F.lit(True)) & (F.coalesce(F.nullif(F.col("context"), F.lit(0)), F.lit(least_context)) >= least_context)


def model_catalogue(models: DataFrame, least_context: int = 32_768) -> DataFrame:
    """Models that fit, widest first; unknown properties pass, unknown context comes last."""
    return models.filter(fits(least_context)).select("id", F.coalesce("context", F.lit(0)).cast("long").alias("context")).orderBy(F.desc("context"), "id")


def budgets(limits: DataFrame, reserve: float = 0.25, gap_s: float = 15.0) -> DataFrame:
    """Token budgets of a per-minute limit: summaries get all but the reserve, hints that per minute's share; unknown is 6000, none is unlimited (0)."""
    tpm = F.coalesce(F.col("tpm"), F.lit(6000))
    summary = F.when(tpm > 0, F.floor(tpm * (1 - reserve))).otherwise(0)
    return limits.select("id", summary.cast("long").alias("summary_tokens"), F.floor(summary / (60 / max(gap_s, 1.0))).cast("long").alias("hint_tokens"))


def chunk_plan(sizes: DataFrame, summary_tokens: int, overhead: int, least: int = 4_000) -> DataFrame:
    """How each transcript goes to the model: whole, in about how many parts, or refused for want of room. 2.5 characters a token."""
    room = int(summary_tokens * 2.5) - overhead
    way = F.when(F.lit(summary_tokens <= 0) | (F.col("chars") <= room), "whole").when(F.lit(room < least), "refused").otherwise("parts")
    return sizes.withColumn("way", way).withColumn("parts", F.when(way == "parts", F.ceil(F.col("chars") / room)).when(way == "whole", 1).otherwise(0).cast("long"))


def _histogram(spark, d):
    rows = table(spark, d, "events").withColumn("code", 200 + F.col("user_id") % 4 * 100)
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("code") == 200).alias("ok"), F.count_if(F.col("code") == 400).alias("limited"), F.count_if(F.col("code") >= 500).alias("server"), F.count("*").alias("total"))


def _requests(spark, d):
    """Events as requests: the status from the user and the day, most of them fine."""
    code = F.when(F.col("user_id") % 50 == 7, 0).when(F.col("user_id") % 40 == 3, 503).when(F.col("user_id") % 11 == 1, 429).when(F.col("user_id") % 13 == 2, 404).otherwise(200)
    bad = F.dayofmonth("ts") % 2 == 0
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(bad, code).otherwise(F.when(F.dayofmonth("ts") % 3 == 0, F.when(code == 429, 429).otherwise(200)).otherwise(200)).alias("status"), F.col("value").alias("ms"))


_REQUESTS = """(SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN day(ts) % 2 = 0 THEN c WHEN day(ts) % 3 = 0 AND c = 429 THEN 429 ELSE 200 END AS status, value AS ms
  FROM (SELECT *, CASE WHEN user_id % 50 = 7 THEN 0 WHEN user_id % 40 = 3 THEN 503 WHEN user_id % 11 = 1 THEN 429 WHEN user_id % 13 = 2 THEN 404 ELSE 200 END AS c FROM events))"""


def _rest(spark, d):
    rows = _requests(spark, d)
    return rest_steps(rows, "day").join(naive_p95(rows, "day", "ms"), "day").withColumn("verdict", rest_verdict(130.0)).drop("p95")


def _ratios(spark, d):
    steps = timed_segments(spark, d).groupBy("meeting_id").agg(F.count_distinct("speaker_id").alias("meetings"), F.count("*").alias("segments"), F.round(F.max("energy")).alias("wall_s")).withColumn("seconds", F.col("meeting_id") % 100 + 1)
    return load_ratios(steps.withColumn("wall_s", F.when(F.col("meeting_id") % 7 == 0, 0.0).otherwise(F.col("wall_s"))))


def _cases(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("suite"), F.when(F.col("p_size") % 10 == 0, "failed").when(F.col("p_size") % 10 == 1, "error").when(F.col("p_size") % 10 == 2, "skipped").otherwise("passed").alias("status"))


QUERIES = {
    "rest_steps": _rest,
    "memory_peak": lambda s, d: running_peak(_timed_s(s, d).select("meeting_id", "id", "start_us", "energy"), "meeting_id", "start_us", "energy"),
    "load_ratios": _ratios,
    "library_growth": lambda s, d: growth(table(s, d, "part").groupBy("p_size").agg(F.round(F.sum("p_retailprice"), 4).alias("cost")).withColumn("p_size", F.col("p_size").cast("long")), "p_size", "cost"),
    "kinds_by_rate": lambda s, d: worst_last(table(s, d, "part").groupBy("p_type").agg(F.round(F.avg("p_size"), 6).alias("rate")), "rate", "p_type"),
    "test_totals": lambda s, d: test_totals(_cases(s, d)),
    "model_counts": lambda s, d: offered_models(_parts(s, d, _MODEL)),
    "window_budget": lambda s, d: table(s, d, "part").select("p_partkey", window_chars((F.col("p_size") % 40 * 100).cast("long"), (F.col("p_partkey") % 3000).cast("long"), F.lit(6000).cast("long")).alias("chars")),
    "latency_percentiles": lambda s, d: percentiles(timed_segments(s, d), "channel", "energy"),
    "latency_p95_naive": lambda s, d: naive_p95(timed_segments(s, d), "channel", "energy"),
    "memory_slope": lambda s, d: late_slope(_timed_s(s, d), "meeting_id", "t", "energy"),
    "rate_early_late": lambda s, d: early_late(_timed_s(s, d), "meeting_id", "t", 7200.0),
    "status_histogram": _histogram,
    "error_kinds": lambda s, d: table(s, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind")).agg(F.count("*").alias("n")),
    "degradation_verdict": lambda s, d: _steps(s, d).select("meeting_id", load_verdict(60.0).alias("verdict")),
    "soak_verdict": _soak,
    "ramp_limit": lambda s, d: ramp_limit(_steps(s, d).withColumn("verdict", load_verdict(1e9)), "meeting_id", "verdict"),
    "progress_bars": lambda s, d: table(s, d, "part").select("p_partkey", progress_bar(F.col("p_size") * 2).alias("bar")),
    "regression_gate": lambda s, d: regression_problems(_parts(s, d, _RUN), {"wer": 0.016, "splits": 1, "merges": 3}).select("run", "problems"),
    "level_rollup": _rollup,
    "model_catalogue": lambda s, d: model_catalogue(_parts(s, d, _MODEL)),
    "budget_table": lambda s, d: budgets(_parts(s, d, _LIMIT)),
    "chunk_plan": lambda s, d: chunk_plan(table(s, d, "conversations").groupBy(F.col("conv_id").alias("meeting_id")).agg(F.sum(F.length("text") + 1).alias("chars")), 3000, 1500),
}
_FIT = "coalesce(list_contains(modalities, 'text'), true) AND coalesce(nullif(context, 0), 32768) >= 32768"
_SHARE = "round(count(*) FILTER (status = 'passed') / count(*) * 100, 1)"
SQL = {
    "rest_steps": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ms) AS i, count(*) OVER (PARTITION BY day) AS k FROM {_REQUESTS}), c AS (SELECT day, string_agg(status || ':' || n, ',' ORDER BY status) AS codes FROM (SELECT day, status, count(*) AS n FROM r GROUP BY ALL) GROUP BY day),
      s AS (SELECT day, count(*) AS total, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (status NOT BETWEEN 200 AND 299) AS failed, count(*) FILTER (status = 429) AS rate_limited, count(*) FILTER (status >= 500) AS server_errors, count(*) FILTER (status = 0) AS network_errors,
        max(ms) FILTER (i = greatest(k * 95 // 100, 1)) AS p95 FROM r GROUP BY day)
      SELECT s.* EXCLUDE (p95), codes, CASE WHEN network_errors > 0 THEN 'no answer: ' || network_errors WHEN server_errors > 0 THEN '5xx: ' || server_errors WHEN rate_limited > 0 THEN '429: ' || rate_limited WHEN p95 > 130 THEN 'slow' END AS verdict FROM s JOIN c USING (day)""",
    "memory_peak": f"SELECT meeting_id, id, start_us, energy, max(energy) OVER (PARTITION BY meeting_id ORDER BY start_us) AS peak FROM {TIMED}",
    "load_ratios": f"""SELECT *, CASE WHEN wall_s > 0 THEN round(meetings * seconds / wall_s, 2) ELSE 0 END AS speedup, CASE WHEN wall_s > 0 THEN round(segments / wall_s, 1) ELSE 0 END AS rate
      FROM (SELECT meeting_id, count(DISTINCT speaker_id) AS meetings, count(*) AS segments, CASE WHEN meeting_id % 7 = 0 THEN 0 ELSE round(max(energy)) END AS wall_s, meeting_id % 100 + 1 AS seconds FROM {TIMED} GROUP BY meeting_id)""",
    "library_growth": "WITH s AS (SELECT p_size::BIGINT AS size, round(sum(p_retailprice), 4) AS cost FROM part GROUP BY 1) SELECT round(max(size) / min(size), 6) AS grew_size, round(CASE WHEN arg_min(cost, size) <> 0 THEN arg_max(cost, size) / arg_min(cost, size) ELSE 0 END, 6) AS grew_cost FROM s",
    "kinds_by_rate": "SELECT p_type, round(avg(p_size), 6) AS rate FROM part GROUP BY 1",
    "test_totals": f"""SELECT p_type AS suite, count(*) AS tests, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status IN ('failed', 'error')) AS failed, count(*) FILTER (status = 'skipped') AS skipped, {_SHARE} AS share,
      repeat('█', round({_SHARE} / 100 * 22)::BIGINT) || repeat('░', 22 - round({_SHARE} / 100 * 22)::BIGINT) AS bar
      FROM (SELECT p_type, CASE p_size % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE 'passed' END AS status FROM part) GROUP BY ROLLUP (p_type)""",
    "model_counts": f"SELECT count(*) FILTER (fit) AS offered, count(*) FILTER (NOT fit) AS rejected FROM (SELECT {_FIT} AS fit FROM {_parts_sql(_MODEL)})",
    "window_budget": "SELECT p_partkey, CASE WHEN p_size % 40 = 0 THEN 6000 ELSE greatest(80, least(6000, trunc((p_size % 40 * 100 - (p_partkey % 3000) / 2.5::DOUBLE) * 2.5)::BIGINT)) END::BIGINT AS chars FROM part",
    "latency_percentiles": f"SELECT channel, round(median(energy), 6) AS p50, round(quantile_disc(energy, 0.95), 6) AS p95, count(energy) AS n FROM {TIMED} GROUP BY channel",
    "latency_p95_naive": f"SELECT channel, round(energy, 6) AS p95 FROM (SELECT channel, energy, row_number() OVER (PARTITION BY channel ORDER BY energy) AS i, count(*) OVER (PARTITION BY channel) AS n FROM {TIMED}) WHERE i = greatest(n * 95 // 100, 1)",
    "memory_slope": f"SELECT * FROM {_SLOPE}",
    "rate_early_late": f"SELECT * FROM {_RATES}",
    "status_histogram": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (user_id % 4 = 0) AS ok, count(*) FILTER (user_id % 4 = 2) AS limited, count(*) FILTER (user_id % 4 = 3) AS server, count(*) AS total FROM events GROUP BY 1",
    "error_kinds": "SELECT split_part(p_type, ' ', 1) AS kind, count(*) AS n FROM part GROUP BY 1",
    "degradation_verdict": f"SELECT meeting_id, CASE WHEN restarted THEN 'restarted' WHEN status <> 'running' THEN 'status ' || status WHEN errors > 0 THEN 'errors' WHEN segments = 0 THEN 'nothing recognised' WHEN segments < meetings THEN (meetings - segments) || ' lost' WHEN p95 > 60 THEN 'slow' END AS verdict FROM {_STEP}",
    "soak_verdict": f"SELECT meeting_id, CASE WHEN n < 10 THEN 'too short' WHEN per_hour * 100 > 50 THEN 'leak' WHEN per_hour * 100 > 15 THEN 'growing' WHEN late < early * 0.7 AND early > 0 THEN 'slowing' ELSE 'stable' END AS verdict FROM {_SLOPE} JOIN {_RATES} USING (meeting_id)",
    "ramp_limit": f"""WITH v AS (SELECT meeting_id, restarted OR status <> 'running' OR errors > 0 OR segments = 0 OR segments < meetings AS bad FROM {_STEP}), f AS (SELECT min(meeting_id) AS first_bad FROM v WHERE bad)
      SELECT max(meeting_id) FILTER (NOT bad AND (first_bad IS NULL OR meeting_id < first_bad)) AS last_ok, max(first_bad) AS first_bad FROM v, f""",
    "progress_bars": "SELECT p_partkey, repeat('█', round(p_size * 2 / 100 * 22)::BIGINT) || repeat('░', 22 - round(p_size * 2 / 100 * 22)::BIGINT) AS bar FROM part",
    "regression_gate": f"SELECT run, concat_ws(',', CASE WHEN wer > 0.016::DOUBLE + 0.02::DOUBLE THEN 'wer' END, CASE WHEN splits > 1 THEN 'splits' END, CASE WHEN merges > 3 THEN 'merges' END) AS problems FROM {_parts_sql(_RUN)}",
    "level_rollup": "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed, round(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100, 6) AS share FROM orders GROUP BY ROLLUP (o_orderpriority)",
    "model_catalogue": f"SELECT id, coalesce(context, 0) AS context FROM {_parts_sql(_MODEL)} WHERE {_FIT}",
    "budget_table": f"SELECT id, s AS summary_tokens, s // 4 AS hint_tokens FROM (SELECT id, CASE WHEN coalesce(tpm, 6000) > 0 THEN coalesce(tpm, 6000) * 3 // 4 ELSE 0 END AS s FROM {_parts_sql(_LIMIT)})",
    "chunk_plan": "SELECT meeting_id, chars, CASE WHEN chars <= 6000 THEN 'whole' ELSE 'parts' END AS way, CASE WHEN chars <= 6000 THEN 1 ELSE CAST(ceil(chars / 6000) AS BIGINT) END AS parts FROM (SELECT conv_id AS meeting_id, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM conversations GROUP BY 1)",
}
