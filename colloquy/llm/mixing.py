"""Mixing sources to target weights with a low-discrepancy schedule (operator 3).

Slot k of the schedule is the golden-ratio point frac(k * 0.618...), looked up in the sources' cumulative target
weights; a slot's rank among its source's slots names the block of tokens that it takes. A source's documents are
shuffled by a hash and laid end to end on a line of tokens, which is cut into blocks of equal length; when the
slots have used the line up they start it again. The schedule stops for a source when its target is reached, its
last slot taking part of a block, and sources that the points left short get their missing slots at the end.

The sources' totals (one row per source, as the mixture's weights have) are worked out on the driver; documents,
blocks and slots stay distributed.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, free_names, materialise

#: Tokens in a block.
BLOCK_TOKENS = 256
GOLDEN = (math.sqrt(5) - 1) / 2
#: Documents per shuffle bucket of a source, and slots per chunk of the schedule: what one task orders.
BUCKET_ROWS = 10_000
#: Sources up to which the mixture's table is broadcast.
BROADCAST_SOURCES = 10_000
CHUNK_SLOTS = 20_000


def water_fill(totals: dict, weights: dict, want: float, most: float = 2.0) -> dict:
    """Targets by weight that sum to ``want``, none above ``most`` times its source's total."""
    target, free, left = {}, {s for s in totals}, want
    while free:
        weight = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / weight > most * totals[s]} if weight > 0 else set()
        if not over:
            target.update({s: left * weights[s] / weight if weight > 0 else 0.0 for s in free})
            break
        target.update({s: most * totals[s] for s in over})
        left -= sum(most * totals[s] for s in over)
        free -= over
    return target


def _rank_slots(spark, targets: list[float], quotas: list[int]) -> DataFrame:
    """(k, rank): source number and 0-based rank of every slot of the schedule, quotas met exactly.

    The sources' shares of [0, 1) are cut at the edges of a grid, so that a point finds its source by an equal join
    with its grid cell, whatever the number of sources.
    """
    n, total = sum(quotas), sum(targets) or 1.0
    edges = [0.0, *itertools.accumulate(t / total for t in targets)]
    edges[-1] = 1.0
    cells = 4 * len(targets)
    shares = [(c, k, lo, hi) for k, (lo, hi) in enumerate(itertools.pairwise(edges)) if hi > lo for c in range(int(lo * cells), min(int(hi * cells), cells - 1) + 1)]
    shares = spark.createDataFrame(shares, "cell int, k int, lo double, hi double")
    point = F.col("slot") * F.lit(GOLDEN) % 1.0
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"), F.floor(point * cells).cast("int").alias("cell"))
    small = F.broadcast if len(targets) <= BROADCAST_SOURCES else lambda table: table
    slots = slots.join(small(shares), "cell").filter("lo <= point and point < hi").select("slot", "k", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    counts = slots.groupBy("k", "chunk").agg(F.count("*").alias("c"))
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("k", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("k", "chunk").orderBy("slot")
    ranked = slots.withColumn("i", F.row_number().over(inside) - 1).join(starts, ["k", "chunk"]).select("k", (F.col("start") + F.col("i")).alias("rank"))
    asked = small(spark.createDataFrame(list(enumerate(quotas)), "k int, quota long"))
    met = ranked.join(asked, "k").filter(F.col("rank") < F.col("quota")).select("k", "rank")
    # What the points left short of a quota, a few slots per source, comes at the end.
    have = {r["k"]: r["c"] for r in counts.groupBy("k").agg(F.sum("c").alias("c")).collect()}
    short = [(k, have.get(k, 0), q) for k, q in enumerate(quotas) if have.get(k, 0) < q]
    if not short:
        return met
    tail = spark.createDataFrame(short, "k int, have long, quota long").select("k", F.explode(F.sequence("have", F.col("quota") - 1)).alias("rank"))
    return met.unionByName(tail)


def mix(df: DataFrame, size: str, weights: list[float], share: float, most: float = 2.0, row_id: str = "doc_id", source: str = "source", seed: int = 0, block: int = BLOCK_TOKENS) -> DataFrame:
    """``df`` plus source_size, target and taken, the tokens of each row that the mix takes, repeats counted.

    ``weights`` go in turn to the sources in code-point order, null last. ``share`` times all tokens is asked for;
    no source gives more than ``most`` times its tokens, and no row more than ceil(``most``) times its own. A row
    without tokens, or with a null size, gives none; a table without tokens asks for none, an empty one gives an empty
    one. Repeated rows, null ids too, each have their own tokens; which of fully equal rows gives more is left open.
    Reruns agree, and do so for any partitioning. Where ``df`` has a column of one of those three names, the new one has an underscore after it.
    """
    spark, new = df.sparkSession, free_names(df.columns, "source_size", "target", "taken")
    order, whole = F.xxhash64(F.col(f"`{row_id}`"), F.lit(seed)), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{source}`").alias("source"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("z"), order.alias("hash"), whole.alias("tie"))
    found = {r["source"]: (r["z"], r["n"]) for r in rows.groupBy("source").agg(F.sum("z").alias("z"), F.count("*").alias("n")).collect()}
    names = sorted((s for s in found if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in found)
    totals = {s: found[s][0] for s in names}
    targets = water_fill(totals, {s: weights[k % len(weights)] for k, s in enumerate(names)}, share * sum(totals.values()), most)
    if not names:
        return df.withColumns(dict(zip(new, (F.lit(0).cast("long"), F.lit(0.0), F.lit(0).cast("long")))))

    goal = {s: round(targets[s]) for s in names}

    def slots_for(s) -> int:
        if not totals[s]:
            return 0
        passes, rest = divmod(goal[s], totals[s])
        return passes * math.ceil(totals[s] / block) + math.ceil(rest / block)

    quotas = [slots_for(s) for s in names]
    info = spark.createDataFrame(
        [(s, k, totals[s], float(targets[s]), goal[s], math.ceil(totals[s] / block), max(1, math.ceil(found[s][1] / BUCKET_ROWS))) for k, s in enumerate(names)],
        "named string, k int, source_size long, target double, goal long, blocks long, buckets long",
    )
    # A stable number for each row on its source's token line: shuffled by hash, in buckets that tasks order alone.
    small = F.broadcast(info) if len(names) <= BROADCAST_SOURCES else info
    lined = rows.join(small, F.col("source").eqNullSafe(F.col("named"))).withColumn("bucket", F.pmod(F.xxhash64("tie"), F.col("buckets")))
    inner = Window.partitionBy("k", "bucket").orderBy("hash", "tie")
    sums = lined.groupBy("k", "bucket").agg(F.sum("z").alias("bucket_z"))
    earlier = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("k", "bucket", F.coalesce(F.sum("bucket_z").over(earlier), F.lit(0)).alias("start"))
    lined = lined.withColumn("inside", F.sum("z").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("z")).join(starts, ["k", "bucket"])
    lined = lined.withColumn("begins", F.col("start") + F.col("inside"))

    plan = _rank_slots(spark, [targets[s] if totals[s] else 0.0 for s in names], quotas).join(small.select("k", "source_size", "goal", "blocks"), "k")
    turn, at = F.floor(F.col("rank") / F.col("blocks")), F.pmod(F.col("rank"), F.col("blocks"))
    # How far into its block the slot reads: to the block's end, or to where the target is met.
    end = F.least((at + 1) * block, F.col("source_size"), F.col("goal") - turn * F.col("source_size"))
    slots = plan.select("k", at.alias("block"), end.alias("end")).groupBy("k", "block").agg(F.sort_array(F.collect_list("end")).alias("ends"))

    pieces = lined.filter("z > 0").select("k", "begins", "z", F.explode(F.sequence(F.floor(F.col("begins") / block), F.floor((F.col("begins") + F.col("z") - 1) / block))).alias("block"))
    begin = F.greatest(F.col("begins"), F.col("block") * block)
    stop = F.least(F.col("begins") + F.col("z"), (F.col("block") + 1) * block)
    got = F.aggregate("ends", F.lit(0).cast("long"), lambda acc, e: acc + F.greatest(F.lit(0).cast("long"), F.least(e, stop) - begin))
    taken = pieces.join(slots, ["k", "block"]).groupBy("k", "begins").agg(F.sum(got).alias("taken"))
    # Rows with tokens start at places of their own on their source's line.
    taken = taken.select(F.col("k").alias("of_k"), F.col("begins").alias("at"), "taken")
    joined = lined.join(taken, (F.col("k") == F.col("of_k")) & (F.col("begins") == F.col("at")) & (F.col("z") > 0), "left")
    out = (F.col("source_size"), F.col("target"), F.coalesce("taken", F.lit(0)).cast("long"))
    return joined.select("row.*", *[c.alias(to) for c, to in zip(out, new)])


def word_count(text: str = "text"):
    """Words of the contract: maximal runs of anything but the six white-space bytes."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def op3_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 3, 1, 2 in turn, 150 % of all words.

    Null and empty texts have size 0 and nothing of them is taken; very long ones are taken in blocks like others. A null
    source is one of its own, after all others; null ids and repeated rows are documents each. An empty table gives an
    empty result.
    """
    sized = documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size"))
    mixed = mix(materialise(sized), "size", [3.0, 1.0, 2.0], 1.5)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
