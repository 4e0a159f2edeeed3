"""Places of rows in their groups without ordering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def ranked(rows: DataFrame, key: str, order: list[str], to: str = "rank") -> DataFrame:
    """``rows`` with their place in their ``key`` by ``order``, from 1; null keys are a key, and ties get places of their own.

    Range partitions hold consecutive rows. A row's place is its place among its key's rows in its partition, after as
    many as the partitions before hold: a sum over one row a key and partition. A key of a third of all rows is dealt
    over partitions like others.
    """
    spread = written(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy(key, "_part").agg(F.count("*").alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), before.alias("_before"))
    inside = spread.withColumn("_inside", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    placed = inside.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return placed.withColumn(to, F.col("_before") + F.col("_inside")).drop("_part", "_key", "_of", "_before", "_inside")
