"""Two channels of samples on one axis, exactly as the live aligner puts them there, without walking the chunks.

Let a channel have been fed A samples so far. Its samples stand at the places of the axis that their numbers say: what is
padded when it lags is dropped when it comes. After a chunk the aligner has emitted E = max(min A, max A - lag) places,
both A counted to that chunk, since neither ever falls. So a running sum of chunk lengths tells each chunk which of its
samples came too late, and the samples themselves meet only those of their own block of the axis.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lens import table

#: Samples of a block of the axis: a second.
BLOCK = 16_000
CHANNELS = ("mic", "system")


def _summed(key: tuple, pieces: pa.Table) -> pa.Table:
    stream, block, n = key[0].as_py(), key[1].as_py(), pieces.column("n")[0].as_py()
    out = np.zeros(n)
    for at, x in zip(pieces.column("at").to_pylist(), pieces.column("x")):
        values = x.values.to_numpy(zero_copy_only=False)
        out[at : at + len(values)] += values
    return pa.table({"stream": [stream], "block": pa.array([block], pa.int64()), "samples": pa.array([np.clip(out, -1.0, 1.0)], pa.list_(pa.float64()))})


def align_samples(chunks: DataFrame, most_lag: int, block: int = BLOCK) -> DataFrame:
    """(stream, block, samples) of chunks (stream, seq, channel, samples) fed in order of seq and flushed at the end.

    Both channels are added up and clipped to 1; what one lacks, or brings after it was emitted as silence, is silence.
    Only lengths are put in order; a stream's samples never meet in one task. Empty and null chunks change nothing, other
    channels are left out, and a stream without samples has no block.
    """
    told = chunks.filter(F.col("channel").isin(*CHANNELS)).select("stream", "seq", "channel", F.coalesce(F.size("samples"), F.lit(0)).cast("long").alias("n")).filter("n > 0")
    so_far = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fed = [F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("n"))).over(so_far), F.lit(0)).alias(c) for c in CHANNELS]
    mic, system = F.col("mic"), F.col("system")
    emitted = F.greatest(F.least(mic, system), F.greatest(mic, system) - most_lag)
    at = F.when(F.col("channel") == "mic", mic).otherwise(system)
    placed = told.select("stream", "seq", "n", "channel", *fed).withColumn("at", at).withColumn("late", F.least(F.greatest(emitted - F.col("at"), F.lit(0)), F.col("n")))
    totals = told.groupBy("stream").agg(*[F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("n"))), F.lit(0)).alias(c) for c in CHANNELS])
    placed = placed.drop(*CHANNELS).join(totals.select("stream", F.greatest(*CHANNELS).alias("total")), "stream").withColumn("start", F.col("at") + F.col("late")).withColumn("end", F.col("at") + F.col("n")).filter("start < end")
    every = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)))
    pieces = placed.join(chunks.select("stream", "seq", "samples"), ["stream", "seq"]).withColumn("block", every)
    first = F.greatest("start", F.col("block") * block)
    width = F.least("end", (F.col("block") + 1) * block) - first
    cut = F.slice("samples", (first - F.col("at") + 1).cast("int"), width.cast("int"))
    pieces = pieces.select("stream", "block", (first - F.col("block") * block).alias("at"), cut.cast("array<double>").alias("x"), F.least(F.lit(block), F.col("total") - F.col("block") * block).alias("n"))
    kind = chunks.schema["stream"].dataType.simpleString()
    return pieces.groupBy("stream", "block").applyInArrow(_summed, f"stream {kind}, block long, samples array<double>")


_LAG = 150


def _chunks(spark, d):
    """Vectors as chunks of three streams: the system channel is fed less, and late in runs."""
    n = (F.col("vec_id") % 7 * 9 + 1).cast("int")
    channel = F.when(F.floor(F.col("vec_id") / 11) % 3 == 0, "system").otherwise("mic")
    return table(spark, d, "embeddings").select((F.col("vec_id") % 3).alias("stream"), F.col("vec_id").alias("seq"), channel.alias("channel"), F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double") * 2).alias("samples"))


def _aligned(spark, d):
    rows = align_samples(_chunks(spark, d), _LAG, 1_000)
    return rows.select("stream", "block", F.posexplode("samples").alias("k", "x")).select("stream", (F.col("block") * 1_000 + F.col("k")).alias("place"), F.round("x", 6).alias("x"))


QUERIES = {"samples_aligned": _aligned}
SQL = {
    "samples_aligned": f"""WITH c AS (SELECT vec_id % 3 AS stream, vec_id AS seq, CASE WHEN vec_id // 11 % 3 = 0 THEN 'system' ELSE 'mic' END AS channel, CAST(embedding AS DOUBLE[])[1:vec_id % 7 * 9 + 1] AS v FROM embeddings),
      a AS (SELECT *, coalesce(sum(CASE WHEN channel = 'mic' THEN len(v) END) OVER w, 0) AS m, coalesce(sum(CASE WHEN channel = 'system' THEN len(v) END) OVER w, 0) AS s FROM c WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      p AS (SELECT stream, greatest(least(m, s), greatest(m, s) - {_LAG}) AS emitted, CASE WHEN channel = 'mic' THEN m ELSE s END + unnest(range(len(v))) AS place, unnest(v) * 2 AS x FROM a)
      SELECT stream, place::BIGINT AS place, round(greatest(least(sum(x), 1.0), -1.0), 6) AS x FROM p WHERE place >= emitted GROUP BY stream, place""",
}
