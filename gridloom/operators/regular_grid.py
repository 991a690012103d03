"""Irregular readings onto a regular grid: time shards, their first and last readings, carries by prefix scan, local fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Scratch
from .skew import hot_keys, with_salt

#: Steps of one shard of a source; shards of one block.
SHARD, BLOCK = 64, 256
#: Seconds of a time unit.
UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "ps": 1e-12}


def seconds(t: Column, unit: Column) -> Column:
    """Time in seconds; a NULL unit is seconds, an unknown one gives NULL."""
    u = F.lower(F.trim(unit))
    factor = F.when(unit.isNull(), F.lit(1.0))
    for name, value in UNITS.items():
        factor = factor.when(u == name, F.lit(value))
    return t * factor


def current_points(points: DataFrame, min_rows: int = 200_000) -> tuple[DataFrame, DataFrame | None]:
    """Of each (source_id, seq) the row with the latest ``arrived_at`` (NULL is the earliest; equal: greater point_id), if it is a reading.

    A point without time or value (NULL or NaN), or of an unknown unit, is no reading; a row without source_id or seq
    is no point. Columns: source_id, _salt, sec, value; partitioned by source_id and a salt that splits hot sources.
    """
    rows = points.select("source_id", "seq", "t", "t_unit", "amps_ma", "arrived_at", "point_id").dropna(subset=["source_id", "seq"])
    hot = hot_keys(rows.select("source_id"), ["source_id"], min_rows)
    place = ["source_id"] if hot is None else ["source_id", "_salt"]
    rows = with_salt(rows, ["source_id"], ["seq"], hot).repartition(*place)
    w = Window.partitionBy(*place, "seq").orderBy(F.desc_nulls_last("arrived_at"), F.desc_nulls_last("point_id"))
    latest = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    out = latest.select("source_id", "_salt", seconds(F.col("t"), F.col("t_unit")).alias("sec"), F.col("amps_ma").alias("value"))
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return out.filter(usable("sec") & usable("value")), hot


def regular_grid(readings: DataFrame, sources: DataFrame, hot: DataFrame | None = None, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Each source on its own grid: one row for every step, with the steps that have no reading marked.

    ``readings``: source_id, _salt, sec, value. ``sources``: source_id (unique), delay, t_start, dt, n_steps; step k is
    [t_start + k*dt, t_start + (k+1)*dt). A source whose grid has a NULL, or no positive dt or n_steps, has no steps.

    Result: source_id, step INT, t, n_readings, value (last reading of the step; NULL if there is none), ``mark``
    (``read``; ``carried`` from an earlier step; ``before_first`` reading; ``no_readings`` at all), ``filled`` (value,
    or the last reading before) and ``linear`` (between the readings before and after, at the start of the step;
    outside of them the nearest one).
    """
    grid = sources.filter("source_id IS NOT NULL AND t_start IS NOT NULL AND dt > 0 AND NOT isnan(dt) AND n_steps > 0")
    grid = grid.select("source_id", F.coalesce("delay", F.lit(0.0)).alias("delay"), "t_start", "dt", F.col("n_steps").cast("long").alias("n_steps"))
    salted, place = grid, ["source_id"]
    if hot is not None:
        place = ["source_id", "_salt"]
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_salt")
        salted = grid.join(F.broadcast(hot), "source_id", "left").select(*grid.columns, salts)
    step = F.floor((F.col("sec") + F.col("delay") - F.col("t_start")) / F.col("dt"))
    placed = readings.join(salted, place).withColumn("step", step).filter("step >= 0 AND step < n_steps")
    at = F.struct((F.col("sec") + F.col("delay")).alias("sec"), "value")
    # The readings of a step are combined where they stand, so a hot source sends at most one row a step and salt.
    local = placed.groupBy(*place, "step").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    local = local.withColumn("shard", F.floor(F.col("step") / shard)).repartition("source_id", "shard")
    steps = local.groupBy("source_id", "shard", "step").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    entries = F.sort_array(F.collect_list(F.struct("step", "n", "first", "last")))
    shards = Scratch(readings.sparkSession).write(steps.groupBy("source_id", "shard").agg(entries.alias("entries")))  # read by both scans and the fill
    summary = shards.select("source_id", "shard", F.element_at("entries", 1)["first"].alias("first"), F.element_at("entries", -1)["last"].alias("last"))
    # The shards of a source are listed block by block, so no row holds a list that grows with the grid.
    last = F.floor((F.col("n_steps") - 1) / shard)
    blocks = grid.select("source_id", "t_start", "dt", "n_steps", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / block))).alias("block"))
    numbers = F.explode(F.sequence(F.col("block") * block, F.least(F.col("block") * block + (block - 1), last))).alias("shard")
    frame = blocks.select("source_id", "t_start", "dt", "n_steps", "block", numbers)
    # Carries pass two scans: over the shards of a block, and over the blocks of a source that have readings. Both look
    # back, the second of each in descending order: a frame that looks ahead would be summed anew for every row.
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside, along = Window.partitionBy("source_id", "block"), Window.partitionBy("source_id")
    by_block = summary.groupBy("source_id", F.floor(F.col("shard") / block).alias("block")).agg(F.min("first").alias("b_first"), F.max("last").alias("b_last"))
    listed = blocks.select("source_id", "block").join(by_block, ["source_id", "block"], "left")
    carried = listed.select(
        "source_id", "block", F.last("b_last", True).over(earlier(along.orderBy("block"))).alias("b_before"), F.last("b_first", True).over(earlier(along.orderBy(F.desc("block")))).alias("b_after"),
    )
    carries = frame.select("source_id", "block", "shard").join(summary, ["source_id", "shard"], "left")
    carries = carries.select(
        "source_id", "block", "shard", F.last("last", True).over(earlier(inside.orderBy("shard"))).alias("before"), F.last("first", True).over(earlier(inside.orderBy(F.desc("shard")))).alias("after"),
    ).join(carried, ["source_id", "block"])
    carries = carries.select("source_id", "shard", F.coalesce("before", "b_before").alias("before"), F.coalesce("after", "b_after").alias("after"))
    whole = frame.join(shards, ["source_id", "shard"], "left").join(carries, ["source_id", "shard"])
    first = F.col("shard") * shard
    rows = whole.select("*", F.explode(F.sequence(first, F.least(first + shard, F.col("n_steps")) - 1)).alias("step"), F.map_from_entries(F.transform("entries", lambda e: F.struct(e["step"], e))).alias("by_step"))
    here = F.try_element_at(F.col("by_step"), F.col("step"))
    rows = rows.withColumn("here", here)
    inside = Window.partitionBy("source_id", "shard").orderBy("step")
    back = F.coalesce(F.last(F.col("here")["last"], True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("before"))
    ahead = F.coalesce(F.first(F.col("here")["first"], True).over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("after"))
    rows = rows.withColumn("back", back).withColumn("ahead", ahead).withColumn("t", F.col("t_start") + F.col("step") * F.col("dt"))
    b, a, x = F.col("back"), F.col("ahead"), F.col("here")
    mark = F.when(x.isNotNull(), "read").when(b.isNotNull(), "carried").when(a.isNotNull(), "before_first").otherwise("no_readings")
    share = (F.col("t") - b["sec"]) / F.nullif(a["sec"] - b["sec"], F.lit(0.0))
    linear = F.when(b.isNull(), a["value"]).when(a.isNull(), b["value"]).otherwise(F.coalesce(b["value"] + share * (a["value"] - b["value"]), b["value"]))
    return rows.select(
        "source_id", F.col("step").cast("int").alias("step"), "t", F.coalesce(x["n"], F.lit(0)).alias("n_readings"), x["last"]["value"].alias("value"),
        mark.alias("mark"), F.coalesce(x["last"]["value"], b["value"]).alias("filled"), linear.alias("linear"),
    )
