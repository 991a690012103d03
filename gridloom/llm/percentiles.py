"""Percentiles of very large columns by distributed multi-select.

Each partition proposes medians of slices of its values; their weighted quantiles near the rank that is sought become
two pivots; a count below, at, between and above them tells which ranges are ruled out; the rest goes into the next
round, until every rank is found. Summaries of separate pieces (runs, days) are kept and united: they answer at once
within a bound, and start the exact search over any union of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch

#: Medians that a partition proposes for a group at most, rows after which it does so, and the most rows of a table that is broadcast.
SLICES, FLUSH, BROADCAST_ROWS = 128, 2_000_000, 50_000


def _propose(names: list[str]):
    """For mapInArrow: keys, value, weight, err to weighted medians of slices, as many as twice the root of a group's rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            code = np.zeros(t.num_rows, np.int64)
            for c in names:
                d = t.column(c).combine_chunks().dictionary_encode()
                d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
                code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]
            v, w = t.column("value").to_numpy(), t.column("weight").to_numpy()
            order = np.lexsort((v, code))
            code, v, w = code[order], v[order], w[order]
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            count = np.diff(np.r_[start, len(code)])
            before = np.cumsum(w) - w
            within = before - np.repeat(before[start], count)
            total = np.repeat(np.add.reduceat(w, start), count)
            slices = np.repeat(np.minimum(SLICES, np.ceil(2 * np.sqrt(count))), count)
            cut = np.floor((within + w / 2) * slices / total)
            first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (cut[1:] != cut[:-1])])
            size = np.diff(np.r_[first, len(code)])
            middle = first + size // 2
            # A slice of several values is counted wrongly by less than its weight; each list's greatest such error is noted once.
            own = np.flatnonzero(np.r_[True, code[first[1:]] != code[first[:-1]]])
            err = np.zeros(len(first))
            err[own] = np.maximum.reduceat(np.where(size > 1, np.add.reduceat(w, first), 0.0), own) + np.add.reduceat(t.column("err").to_numpy()[order], start)
            out = t.select(names).take(pa.array(order[middle]))
            arrays = [out.column(c).combine_chunks() for c in names]
            arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(v[middle]), pa.array(np.add.reduceat(w, first)), pa.array(err)], names=[*names, "value", "weight", "err"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= FLUSH:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast if the table was counted and is small; otherwise Spark joins by shuffle and splits skewed keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _plain(data: DataFrame, group: list[str], value: str) -> DataFrame:
    rows = data.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value))).dropna(subset=group)
    return rows.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], (F.col(value).cast("double") + F.lit(0.0)).alias("value"))


def _proposals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each partition's weighted medians, met by key (and 16 places for each key, so no key is one task) and made fewer once more."""
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), "value double, weight double, err double"])
    local = rows.select(*keys, "value", F.lit(1.0).alias("weight"), F.lit(0.0).alias("err")).mapInArrow(_propose(keys), schema)
    return local.repartition(*keys, F.pmod(F.xxhash64("value"), F.lit(16))).mapInArrow(_propose(keys), schema)


def summarise(data: DataFrame, group: list[str], value: str) -> DataFrame:
    """What is kept of a piece (a day, a run): group, value, weight, err; medians of slices of its values.

    A group's weights add up to its number of values, its errs to the most by which a count of values up to any value
    can be wrong. Summaries of pieces are united with ``unionByName`` and then stand for the union of the pieces, in
    ``bounded`` and as the start of ``multi_select``. Group columns must not be named value, weight or err.
    """
    rows = _plain(data, group, value)
    made = _proposals(rows, rows.columns[:-1])
    return made.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(group)], "value", "weight", "err")


def bounded(summary: DataFrame, group: list[str], percents: list[int]) -> DataFrame:
    """group, pct INT, value, n, max_error: percentiles from summaries alone; the value's rank is off by a share ``max_error`` of n at most."""
    rows = summary.groupBy(*group, "value").agg(F.sum("weight").alias("weight"), F.sum("err").alias("err"))
    places, whole = Window.partitionBy(*group).orderBy("value"), Window.partitionBy(*group)
    rows = rows.withColumn("upto", F.sum("weight").over(places)).withColumn("n", F.sum("weight").over(whole)).withColumn("err", F.sum("err").over(whole))
    each = rows.select(*group, "value", "upto", "n", "err", F.explode(F.array(*[F.lit(p).cast("int") for p in percents])).alias("pct"))
    reached = each.filter(F.col("upto") >= F.greatest(F.lit(1.0), F.ceil(F.col("n") * F.col("pct") / 100)))
    return reached.groupBy(*group, "pct").agg(F.min("value").alias("value"), F.first("n").cast("long").alias("n"), (F.first("err") / F.first("n")).alias("max_error"))


def multi_select(data: DataFrame, group: list[str], value: str, percents: list[int], min_rows: int = 1, summary: DataFrame | None = None) -> DataFrame:
    """For each group of at least ``min_rows`` values and each whole percent, the smallest value that at least so many percent of the group do not exceed.

    The result is exact: group, pct INT, value DOUBLE. NULL and NaN values are no values; rows with a NULL group
    column belong to no group. An empty table gives an empty result. ``data`` may be the union of several pieces;
    ``summary`` is then the union of their summaries, from which the first pivots are taken instead of a pass.
    """
    spark, scratch, names = data.sparkSession, Scratch(data.sparkSession), group
    rows = _plain(data, group, value)
    group = rows.columns[:-1]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group)
    rows = scratch.write(rows)
    if summary is None:
        first = _proposals(rows, group)
    else:
        first = summary.select(*[F.col(c).alias(g) for c, g in zip(names, group)], "value", "weight")
    first = scratch.write(first)
    sizes = first.groupBy(*group).agg(F.sum("weight").cast("long").alias("n")).filter(F.col("n") >= min_rows)
    pct = F.explode(F.array(*[F.lit(p).cast("int") for p in percents])).alias("pct")
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("pct") / F.lit(100))).cast("long")
    targets = sizes.select(*group, "n", pct).withColumn("k", k).withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double"))
    targets = scratch.write(targets)
    left, found, keys = targets.count(), [], list(group)
    while left:
        proposals = first if keys == list(group) else _proposals(rows, keys)
        w = Window.partitionBy(*keys).orderBy("value")
        whole = Window.partitionBy(*keys)
        placed = proposals.withColumn("upto", F.sum("weight").over(w)).withColumn("all", F.sum("weight").over(whole))
        # The pivots stand about 1/64 of the range to either side of the rank; a wrong guess costs a round, never the result.
        near = placed.join(_small(targets.select(*group, "pct", "k"), left), keys)
        slack = F.greatest(F.lit(1.0), F.col("all") / 64)
        low = F.max(F.when(F.col("upto") <= F.col("k") - slack, F.col("value")))
        high = F.min(F.when(F.col("upto") >= F.col("k") + slack, F.col("value")))
        pivots = near.groupBy(*group, "pct").agg(low.alias("a"), high.alias("b"), F.min("value").alias("least"), F.max("value").alias("most"))
        pivots = pivots.select(*group, "pct", F.coalesce("a", "least").alias("a"), F.coalesce("b", "most").alias("b"))
        pivots = scratch.write(pivots)
        v, a, b = F.col("value"), F.col("a"), F.col("b")
        here = rows.join(_small(pivots, left), keys)
        one = lambda test: F.sum(F.when(test, 1).otherwise(0))
        counts = here.groupBy(*group, "pct").agg(
            one(v < a).alias("below"), one(v == a).alias("at_a"), one((v > a) & (v < b)).alias("between"), one((v == b) & (a < b)).alias("at_b"), F.first("a").alias("a"), F.first("b").alias("b")
        )
        c1 = F.col("below")
        c2, c3 = c1 + F.col("at_a"), c1 + F.col("at_a") + F.col("between")
        c4, kk = c3 + F.col("at_b"), F.col("k")
        judged = targets.join(_small(counts, left), [*group, "pct"])
        hit = F.when((kk > c1) & (kk <= c2), a).when((kk > c3) & (kk <= c4), b)
        new_k = F.when(kk <= c1, kk).when(kk <= c3, kk - c2).otherwise(kk - c4)
        lo = F.when(kk <= c1, F.col("lo")).when(kk <= c3, a).otherwise(b)
        hi = F.when(kk <= c1, a).when(kk <= c3, b).otherwise(F.col("hi"))
        judged = judged.select(*group, "n", "pct", new_k.alias("k"), lo.alias("lo"), hi.alias("hi"), hit.alias("value"))
        judged = scratch.write(judged)
        found.append(judged.filter(F.col("value").isNotNull()).select(*group, "pct", "value"))
        targets = judged.filter(F.col("value").isNull()).drop("value")
        left = targets.count()
        if left:
            open_ = targets.select(*group, "pct", "lo", "hi")
            inside = (F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v < F.col("hi")))
            old, rows = rows, scratch.write(rows.join(_small(open_, left), keys).filter(inside).select(*group, "pct", "value"))
            scratch.drop(old)
            keys = [*group, "pct"]
    out = found[0] if found else spark.createDataFrame([], f"{kinds}, pct int, value double")
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*[F.col(g).alias(c) for g, c in zip(group, names)], "pct", "value")
