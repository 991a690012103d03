"""Ranks and running sums of ordered groups of any size: ordered pieces, their totals, a scan over the totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Scratch


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in its group, ``group_rows``, and for each name of ``sums`` the running sum up to the row and, as ``all_<name>``, the group's.

    Rows are cut into pieces by ranges of group and order, so a group of any size is spread over tasks; only a piece's
    totals pass the scan over the pieces of a group. Rows of equal order stay in one piece, so ``order`` should end
    with a key. NULL is a group of its own; an empty table stays empty.
    """
    sums = sums or {}
    cut = rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_piece", F.spark_partition_id())
    cut = Scratch(rows.sparkSession).write(cut)  # the ranges are sampled, so they are fixed by writing
    totals = cut.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    known = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("group_rows")]
    for i, name in enumerate(sums):
        known += [F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}"), F.sum(f"_s{i}").over(whole).alias(f"all_{name}")]
    totals = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_piece").alias("_at"), *known)
    same = F.col("_piece") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*by, "_piece").orderBy(*order)
    out = cut.join(totals, same).withColumn("rank", F.col("_before") + F.row_number().over(inside))
    for i, (name, c) in enumerate(sums.items()):
        out = out.withColumn(name, F.col(f"_b{i}") + F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return out.select(*rows.columns, "rank", "group_rows", *sums, *[f"all_{x}" for x in sums])
