"""Networks that are trees, solved exactly by two sweeps; and lookups along an ordered axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def solve_tree(edges: DataFrame, levels: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """node, parent, level, r, i, drop of a tree network: edges carry the loads below them, drops add up from the pads.

    ``by`` names columns that keep stimuli, times or nets apart; all of them are solved in the same joins.

    ``edges``: node, parent, level (1 next to the pads), r, amps. A sweep is one grouped sum and one join a level, so
    no matrix is made; whole numbers stay exact.
    """
    currents: dict[int, DataFrame] = {}
    for level in range(levels, 0, -1):
        own = edges.filter(F.col("level") == level).select(*by, "node", "parent", "level", "r", "amps")
        if level < levels:
            below = currents[level + 1].groupBy(*by, F.col("parent").alias("node")).agg(F.sum("i").alias("_i"))
            own = own.join(below, [*by, "node"], "left")
        i = F.col("amps") if level == levels else F.col("amps") + F.coalesce("_i", F.lit(0))
        currents[level] = own.select(*by, "node", "parent", "level", "r", i.alias("i"))
    out, above = None, None
    for level in range(1, levels + 1):
        rows = currents[level]
        drop = F.col("r") * F.col("i")
        if above is not None:
            rows = rows.join(above.select(*by, F.col("node").alias("parent"), F.col("drop").alias("_d")), [*by, "parent"])
            drop = F.col("_d") + drop
        above = rows.select(*by, "node", "parent", "level", "r", "i", drop.alias("drop"))
        out = above if out is None else out.unionByName(above)
    return out


def as_of(points: DataFrame, times: DataFrame, key: str, at: str, value: str, t: str, width: float = 86_400.0) -> DataFrame:
    """The value of each key's wave at its times: key, t, value. Before the first point its value, after the last one the last value, else the line.

    Points and times stand in one ordered list for each key and shard of ``width``; a shard knows the last point before
    it and the first one after it from a scan over the shards' ends, so a long wave is spread over many tasks.
    """
    shard = lambda c: F.floor(F.col(c) / width)
    rows = points.select(key, F.col(at).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_q"), shard(at).alias("_s"))
    rows = rows.unionByName(times.select(key, F.col(t).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_q"), shard(t).alias("_s")))
    point = F.when(F.col("_q") == 0, F.struct("_t", "_v"))
    ends = rows.groupBy(key, "_s").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    earlier = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy(key)
    ends = ends.select(key, "_s", F.last("_last", True).over(earlier(w.orderBy("_s"))).alias("_before"), F.last("_first", True).over(earlier(w.orderBy(F.desc("_s")))).alias("_after"))
    inside = Window.partitionBy(key, "_s")
    rows = rows.join(ends, [key, "_s"])
    rows = rows.withColumn("_a", F.coalesce(F.last(point, True).over(inside.orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)), F.col("_before")))
    rows = rows.withColumn("_b", F.coalesce(F.last(point, True).over(earlier(inside.orderBy(F.desc("_t"), F.desc("_q")))), F.col("_after")))
    a, b = F.col("_a"), F.col("_b")
    line = a["_v"] + (b["_v"] - a["_v"]) * (F.col("_t") - a["_t"]) / (b["_t"] - a["_t"])
    found = F.when(a.isNull(), b["_v"]).when(b.isNull(), a["_v"]).otherwise(line)
    return rows.filter("_q = 1").select(key, F.col("_t").alias(t), found.alias(value))


def nearest_value(values: DataFrame, targets: DataFrame, key: str, at: str, width: float = 10_000.0) -> DataFrame:
    """key, nearest: the value next to each target, ties to the lower one.

    Both are cut into cells of a width; a cell knows the last value before it and the first one after it, so a target
    needs its own cell only. The cells' ends, not their values, pass one ordered scan.
    """
    cell = F.floor(F.col(at) / width)
    v = values.select(cell.alias("_c"), F.col(at).alias("_v"))
    cells = v.groupBy("_c").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sort_array(F.collect_set("_v")).alias("own"))
    wanted = targets.select(cell.alias("_c")).distinct()
    earlier = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = wanted.join(cells.select("_c", "lo", "hi"), "_c", "full")
    around = ends.select("_c", F.last("hi", True).over(earlier(F.asc("_c"))).alias("before"), F.last("lo", True).over(earlier(F.desc("_c"))).alias("after"))
    met = targets.withColumn("_c", cell).join(around, "_c").join(cells.select("_c", "own"), "_c", "left")
    below = F.coalesce(F.array_max(F.filter("own", lambda x: x <= F.col(at))), F.col("before"))
    above = F.coalesce(F.array_min(F.filter("own", lambda x: x >= F.col(at))), F.col("after"))
    nearest = F.when(below.isNull(), above).when(above.isNull(), below).when(F.col(at) - below <= above - F.col(at), below).otherwise(above)
    return met.select(key, nearest.alias("nearest"))
