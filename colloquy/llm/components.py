"""Connected components of links between 64-bit ids, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _toward_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Links (a, b), a > b, moved so that neighbours hang on the least member of each neighbourhood.

    ``larger_only``: the larger neighbours of a node join the least of all; else its smaller ones and itself do.
    """
    if larger_only:
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        down = links.join(least, "a")
        moved = down.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    moved = moved.filter("a <> b")
    return moved if larger_only else moved.distinct()  # repeats change no minimum


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable from each id in ``links`` (a, b), by alternating star contractions.

    A round halves long chains and flattens stars; a node's neighbours are never gathered, only their minimum is,
    so a node with very many links costs a partial aggregation and a join that adaptive execution can split.
    """
    now = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        now = materialise(_toward_least(_toward_least(now, True), False))
        # Each node hangs on one other, and none that others hang on hangs itself: stars only.
        links, nodes = now.agg(F.count("*"), F.countDistinct("a")).first()
        if links == nodes and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
