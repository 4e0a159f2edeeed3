"""Queries of the sources: frames, commands, events, reports and addresses made of the synthetic tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.vectors import unit
from ..plans.summary import question_context
from .audio import cut, level, read_frames
from .lens import PRINTS, SPOKEN, TIMED, table, timed_segments, transcript, voice_prints
from .messages import COMMANDS, commands, error_detail, events, memory_mb, segment_ids, usable_url

_HOST = "example.org"


def _commands(spark, d):
    """Orders as commands of a client: known and unknown kinds, and texts that are none."""
    kind = F.element_at(F.array(*[F.lit(c) for c in [*COMMANDS, "dance"]]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    body = F.when(F.col("o_orderkey") % 7 == 6, F.col("o_orderpriority")).otherwise(F.to_json(F.struct(kind.alias("type"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 2 == 0).alias("record_audio"))))
    good, bad = commands(table(spark, d, "orders").select(F.col("o_orderkey").alias("no"), body.alias("body")))
    none = F.lit(None)
    return good.select("no", "type", "title", "record_audio", none.cast("string").alias("error")).unionByName(bad.select("no", none.cast("string").alias("type"), none.cast("string").alias("title"), none.cast("boolean").alias("record_audio"), "error"))


def _ids(spark, d):
    sent = F.array(F.col("p_partkey").cast("string"), F.concat("p_partkey", F.lit(".5")), F.concat(F.lit("-"), F.col("p_size").cast("string")), F.col("p_type"), F.lit(None).cast("string"), F.lit(""))
    return table(spark, d, "part").select("p_partkey", F.array_join(segment_ids(sent), ",").alias("ids"))


def _memory(spark, d):
    texts = F.concat((F.col("p_retailprice") / 4).cast("string"), F.element_at(F.array(*[F.lit(u) for u in ("GiB", "MiB", "KiB", "B", "TiB")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit(" / 3GiB"))
    return table(spark, d, "part").select("p_partkey", F.round(memory_mb(texts), 6).alias("mb"))


def _frames(spark, d):
    """Two samples a segment behind a channel byte, the third channel unknown; little-endian, negative ones in two's complement."""
    sample = lambda v: F.concat(F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0"), F.lpad(F.hex(F.floor(F.pmod(v, F.lit(65_536)) / 256).cast("long")), 2, "0"))
    frame = F.unhex(F.concat(F.lpad(F.hex(F.col("id") % 3), 2, "0"), sample(F.col("id") % 32_768), sample(-(F.col("id") % 30_000) - 1)))
    got = read_frames(timed_segments(spark, d).select("id", frame.alias("frame")))
    at = lambda k: F.round(F.get("samples", F.lit(k)).cast("double"), 6)
    return got.select("id", "channel", at(0).alias("first"), at(1).alias("second"), F.round(level(F.col("samples")), 6).alias("level"))


def _cut(spark, d):
    """A print's vector as samples, from a time before its start or inside it to one inside it or beyond its end."""
    begin = (F.col("id") % 40 - 9.5) / F.lit(16_000.0)
    part = cut(F.col("centroid"), begin, begin + F.lit(30 / 16_000))
    return voice_prints(spark, d).select("id", F.size(part).cast("long").alias("n"), F.round(F.get(part, F.lit(0)), 6).alias("first"))


QUERIES = {
    "commands_read": _commands,
    "events_told": lambda s, d: events(table(s, d, "supplier"), "speaker", "s_suppkey", "s_name"),
    "segment_ids": _ids,
    "memory_texts": _memory,
    "frames_read": _frames,
    "samples_cut": _cut,
    "unit_vectors": lambda s, d: voice_prints(s, d).select("id", F.round(F.get(unit(F.transform("centroid", lambda x: x * 3)), F.lit(5)), 6).alias("sixth")),
    "usable_urls": lambda s, d: table(s, d, "pages").select("page_id", usable_url(F.col("url")).alias("usable"), usable_url(F.concat(F.lit("https://"), F.when(F.col("page_id") % 3 == 0, _HOST).otherwise("elsewhere.net"), F.lit("/v1")), [_HOST]).alias("allowed")),
    "error_details": lambda s, d: table(s, d, "nation").select("n_nationkey", error_detail(F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(F.struct(F.col("n_name").alias("message")).alias("error")))).otherwise(F.repeat("n_name", F.lit(40)))).alias("detail")),
    "question_context": lambda s, d: question_context(transcript(s, d), 5, [1, 3, 99], 500),
}
SQL = {
    "commands_read": f"""WITH o AS (SELECT o_orderkey AS no, o_orderpriority AS title, [{', '.join(f"'{c}'" for c in [*COMMANDS, 'dance'])}][o_orderkey % 6 + 1] AS type FROM orders)
      SELECT no, CASE WHEN ok THEN type END AS type, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN no % 2 = 0 END AS record_audio, CASE WHEN no % 7 = 6 THEN 'not a command' WHEN type = 'dance' THEN 'unknown command' END AS error FROM (SELECT *, no % 7 <> 6 AND type <> 'dance' AS ok FROM o)""",
    "events_told": """SELECT '{"type":"speaker","s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' AS value FROM supplier""",
    "segment_ids": "SELECT p_partkey, p_partkey || ',-' || p_size AS ids FROM part",
    "memory_texts": "SELECT p_partkey, round(p_retailprice / 4 * CASE p_partkey % 5 WHEN 0 THEN 1024.0 WHEN 1 THEN 1 WHEN 2 THEN 1 / 1024 WHEN 3 THEN 1 / 1048576 ELSE 0 END, 6)::DOUBLE AS mb FROM part",
    "frames_read": f"""SELECT id, CASE id % 3 WHEN 0 THEN 'mic' ELSE 'system' END AS channel, round(a / 32768, 6) AS first, round(b / 32768, 6) AS second, round(sqrt((a / 32768 * a / 32768 + b / 32768 * b / 32768) / 2), 6) AS level
      FROM (SELECT id, (id % 32768)::DOUBLE AS a, (-(id % 30000) - 1)::DOUBLE AS b FROM {TIMED}) WHERE id % 3 < 2""",
    "samples_cut": f"SELECT id, len(p)::BIGINT AS n, round(p[1], 6) AS first FROM (SELECT id, centroid[greatest(id % 40 - 10, 0) + 1 : id % 40 + 20] AS p FROM {PRINTS})",
    "unit_vectors": f"SELECT id, round(centroid[6] / sqrt(list_sum(list_transform(centroid, lambda x: x * x))), 6) AS sixth FROM {PRINTS}",
    "usable_urls": "SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS usable, page_id % 3 = 0 AS allowed FROM pages",
    "error_details": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE left(repeat(n_name, 40), 200) END AS detail FROM nation",
    "question_context": f"""WITH l AS (SELECT id, start_s, printf('[%02d:%02d] %s: %s', (start_s // 60)::BIGINT, start_s::BIGINT % 60, coalesce(speaker, 'unknown'), text) AS line FROM {SPOKEN} WHERE meeting_id = 5)
      SELECT coalesce(string_agg(line, chr(10) ORDER BY start_s, id) FILTER (id IN (1, 3, 99)), '') AS quoted, right(coalesce(string_agg(line, chr(10) ORDER BY start_s, id) FILTER (id NOT IN (1, 3, 99)), ''), 500) AS earlier FROM l""",
}
