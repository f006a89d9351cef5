"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sampled(rows: DataFrame, label: str, most: int, columns: dict[str, Column]) -> DataFrame:
    """(id, label, *columns): of every label `most` rows at most, with different ids, those that a hash of the
    id orders first; of rows that share an id and a label, the one with the smallest columns. Rows without an
    id or a label are never chosen.

    From the number of different ids of a label follows a hash below which about twice as many ids lie as are
    wanted. Only those rows are moved: first to one row an id, then they are ranked. So no task gets more than
    some 2 * `most` rows of a label, whatever the size of the table, and repeats of an id are combined on the way.
    """
    rows = rows.where(F.col("id").isNotNull() & F.col(label).isNotNull())
    hash_ = F.xxhash64("id")
    share = F.lit(2.0 * most + 50) / F.greatest(F.col("ids"), F.lit(1)) * 1.1  # the count may be off by 5 %
    ends = rows.groupBy(F.col(label).alias("_label")).agg(F.approx_count_distinct("id", 0.02).alias("ids"))
    ends = ends.select("_label", F.when(share < 1, (share * 2.0**64 - 2.0**63).cast("long")).otherwise(F.lit((1 << 63) - 1)).alias("_end"))
    near = rows.join(F.broadcast(ends), (F.col(label) == F.col("_label")) & (hash_ <= F.col("_end")))  # a row a label
    near = near.select("id", label, *[c.alias(n) for n, c in columns.items()])
    one = near.groupBy(label, "id").agg(F.min(F.struct(*columns)).alias("_one"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("id"), "id"))
    return one.withColumn("_rank", rank).where(F.col("_rank") <= most).select("id", label, *[F.col(f"_one.{c}").alias(c) for c in columns])
