"""Statistics, bins, rankings and spectra."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import layer_number
from ..session import Scratch
from .running import running


def layer_pair(a: Column, b: Column) -> Column:
    """One layer's name, or both joined by ``-`` in the order of their numbers."""
    swap = (layer_number(a) > layer_number(b)) | ((layer_number(a) == layer_number(b)) & (a > b))
    return F.when(a == b, a).when(swap, F.concat_ws("-", b, a)).otherwise(F.concat_ws("-", a, b))


def drop_summary(solution: DataFrame, by: list[str]) -> DataFrame:
    return solution.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("drop").alias("min_drop"), F.max("drop").alias("max_drop"), F.round(F.avg("drop"), 9).alias("avg_drop"))


def bins(places: DataFrame, size_x: float, size_y: float, how: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """An aggregate for each cell of a regular grid of bins."""
    cx, cy = F.floor(F.col("x") / size_x).alias("bx"), F.floor(F.col("y") / size_y).alias("by")
    return places.groupBy(*(by or []), cx, cy).agg(how.alias(name))


def nearest_shares(distances: DataFrame, k: int) -> DataFrame:
    """Each load's current split over its k nearest ports by 1/R: load, port, weight, amps. ``distances``: load, port, r, amps; only finite r > 0 count."""
    w = Window.partitionBy("load").orderBy("r", "port")
    near = distances.filter((F.col("r") > 0) & (F.col("r") < float("inf"))).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    weight = (1 / F.col("r")) / F.sum(1 / F.col("r")).over(Window.partitionBy("load"))
    return near.withColumn("weight", weight).select("load", "port", "weight", (F.col("amps") * F.col("weight")).alias("share"))


def difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Greatest and mean difference and root mean square between two solutions; nodes of only one side are counted."""
    both = a.select(key, F.col(value).alias("p")).join(b.select(key, F.col(value).alias("q")), key, "full")
    d = F.abs(F.col("p") - F.col("q"))
    return both.agg(F.count(d).alias("n"), F.sum(F.when(d.isNull(), 1).otherwise(0)).alias("missing"), F.max(d).alias("max_diff"), F.round(F.avg(d), 9).alias("mean_diff"), F.round(F.sqrt(F.avg(d * d)), 9).alias("rmse"))


def peak(rows: DataFrame, by: str, value: str, at: str) -> DataFrame:
    """The greatest value of each group and where it is first attained."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(at)).alias("k")))
    return rows.groupBy(by).agg(best.alias("b")).select(by, F.col("b.v").alias("peak"), (-F.col("b.k")).alias("first_at"))


def orientation(segments: DataFrame, by: str, share: float = 0.7) -> DataFrame:
    """``H``, ``V`` or ``mixed`` for each group by the share of flat (slope < 0.27) and steep (> 3.73) segments."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    flat, steep = (dy < 0.27 * dx), (dy > 3.73 * dx)
    per = segments.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(flat.cast("long")).alias("flat"), F.sum(steep.cast("long")).alias("steep"))
    kind = F.when(F.col("flat") >= share * F.col("n"), "H").when(F.col("steep") >= share * F.col("n"), "V").otherwise("mixed")
    return per.withColumn("orientation", kind)


def energy_ranks(spectrum: DataFrame, by: str, order: str, value: str, levels: list[float]) -> DataFrame:
    """For each group, the first rank (from 1) at which the running share of squares reaches each level. Values in order of size."""
    square = F.col(value) * F.col(value)
    rows = running(spectrum.select(by, order, value), [by], [F.desc(value), F.asc(order)], {"run": square})
    return rows.groupBy(by).agg(*[F.min(F.when(F.col("run") >= x * F.col("all_run"), F.col("rank"))).alias(f"rank_{round(x * 100)}") for x in levels])


def balanced_slabs(loads: DataFrame, key: str, axis: str, parts: int, buckets: int = 1000) -> DataFrame:
    """Slab number of each load: sorted on an axis, quotas that differ by at most one; equal coordinates go by key.

    Loads are counted by buckets of the axis first, so a task sorts one bucket, not all loads.
    """
    low, high = (loads.agg(f(axis)).scalar() for f in (F.min, F.max))
    bucket = F.least(F.floor((F.col(axis) - low) * buckets / F.nullif(high - low, F.lit(0))), F.lit(buckets - 1))
    rows = loads.withColumn("_b", F.coalesce(bucket, F.lit(0)))
    per = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("_b", (F.sum("n").over(Window.orderBy("_b")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("_b").orderBy(axis, key)) - 1
    rows = rows.join(F.broadcast(before), "_b").withColumn("at", at)
    big, quota = F.col("all") % parts, F.floor(F.col("all") / parts)
    edge = big * (quota + 1)
    slab = F.when(F.col("at") < edge, F.floor(F.col("at") / (quota + 1))).otherwise(big + F.floor((F.col("at") - edge) / F.greatest(quota, F.lit(1))))
    return rows.select(key, axis, slab.cast("int").alias("slab"))


def separated_worst(places: DataFrame, by: list[str], k: int, near: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """by, pick INT, node, x, y, drop: of each group the k worst nodes that stand apart, picked greedily.

    Each pick is the greatest drop that is near none of the picks before it, equal drops by smaller node. ``near`` says
    from |dx|, |dy| and the group's extent on both axes whether two nodes are near. Rows with a NULL place, drop, node or
    group and NaN drops are left out; a group with fewer nodes apart gives fewer picks; repeated nodes are near each other.

    A pick of all groups is one grouping, combined before its shuffle, and one join with a row a group; so it takes k
    rounds, whatever the number of groups and however large one is.
    """
    scratch = Scratch(places.sparkSession)
    rows = places.select(*by, "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("drop").cast("double").alias("drop")).dropna()
    box = rows.groupBy(*by).agg((F.max("x") - F.min("x")).alias("_ex"), (F.max("y") - F.min("y")).alias("_ey"))
    rest, picks = scratch.write(rows.join(box, by)), []
    for n in range(1, k + 1):
        best = rest.groupBy(*by).agg(F.min(F.struct((-F.col("drop")).alias("d"), "node", "x", "y")).alias("_p"))
        best = scratch.write(best.select(*by, "_p.*"))
        picks.append(best.select(*by, F.lit(n).alias("pick"), "node", "x", "y", (-F.col("d")).alias("drop")))
        if n < k:
            met = rest.join(best.select(*by, F.col("node").alias("_pn"), F.col("x").alias("_px"), F.col("y").alias("_py")), by)
            close = near(F.abs(F.col("x") - F.col("_px")), F.abs(F.col("y") - F.col("_py")), F.col("_ex"), F.col("_ey")) | (F.col("node") == F.col("_pn"))
            old, rest = rest, scratch.write(met.filter(~close).select(*rest.columns))
            scratch.drop(old)
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out
