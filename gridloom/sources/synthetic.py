"""Layered grids and load patterns, made from rows that give their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.running import running

#: Length and width of a synthetic grid, in whole units of place.
EXTENT = 1_000_000


def layered_grid(specs: DataFrame, layers: int = 3) -> DataFrame:
    """Edges of layered grids: grid_id, kind (``stripe`` or ``via``), u, v, r.

    ``specs``: grid_id, n0, the stripes of layer 0. Layer l has ceil(n0 / 2^l) stripes, horizontal where l is even; each
    crosses all stripes of the next layer, where a via joins them. A stripe of layer l has 1/2^l Ohm, shared evenly by
    its segments; a via has 0.1 Ohm. Neighbours on a stripe are joined through its crossings, in order.
    """
    count = lambda l: F.ceil(F.col("n0") / F.lit(2**l)).cast("int")
    edges = None
    for level in range(layers - 1):
        rows = specs.select("grid_id", count(level).alias("a"), count(level + 1).alias("b"))
        cross = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"))
        name = lambda l, i, j: F.concat_ws("_", F.concat(F.lit("L"), F.lit(l).cast("string")), i, j)
        low, high = name(level, F.col("i"), F.col("j")), name(level + 1, F.col("j"), F.col("i"))
        via = cross.select("grid_id", F.lit("via").alias("kind"), low.alias("u"), high.alias("v"), F.lit(0.1).alias("r"))
        stripe = cross.filter(F.col("j") < F.col("b") - 1).select("grid_id", F.lit("stripe").alias("kind"), low.alias("u"), name(level, F.col("i"), F.col("j") + 1).alias("v"), (F.lit(1.0 / 2**level) / (F.col("b") - 1)).alias("r"))
        both = via.unionByName(stripe)
        edges = both if edges is None else edges.unionByName(both)
    return edges


def power_grid(specs: DataFrame, layers: int = 3, stripe_ohm: float = 1.0, via_ohm: float = 0.1, pads: int = 4, loads: int = 8, volt: float = 1.0, amps: float = 0.001) -> DataFrame:
    """Whole layered grids: grid_id, kind (``R`` stripe, ``VIA``, ``V`` pad, ``I`` load), u, v, value; nodes are named by place, ``X_Y_Ml``.

    ``specs``: grid_id, n0. Layer l has ceil(n0 / 2^l) evenly spaced stripes, horizontal where l is even; a stripe has
    ``stripe_ohm`` / 2^l from edge to edge and runs between its outermost crossings. Stripes of neighbouring layers
    cross at vias. Pads sit on stripe ends of the top layer, spread evenly; where it has fewer ends, each has one.
    Loads are spliced into stripes of layer 0, at places that follow from grid and load alone, so no shuffle is needed
    to choose them; loads at one place are elements of one node. A grid without stripes gives no rows.
    """
    if layers < 2:
        raise ValueError("a grid has two layers or more")
    grids = specs.filter("n0 > 0")
    half = EXTENT // 2
    count = lambda l: F.ceil(F.col("n0") / F.lit(2**l)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    place = lambda i, l: F.floor((2 * i + 1) * F.lit(half) / count(l)).cast("int")
    name = lambda l, across, along: F.concat_ws("_", *((along, across) if l % 2 == 0 else (across, along)), F.lit(f"M{l + 1}"))
    spread = lambda key, a, b, n: F.pmod(F.col(key) * a + F.col("grid_id") * b, n)
    first, last = place(F.lit(0), 1), place(count(1) - 1, 1)
    spliced = grids.select("*", F.explode(F.sequence(F.lit(0), F.lit(loads - 1))).alias("k")) if loads else None
    if loads:
        spliced = spliced.select("grid_id", place(spread("k", 7919, 31, count(0)), 0).alias("across"), (first + spread("k", 104729, 613, last - first + 1)).cast("int").alias("along"))
    out = None
    for level in range(layers):
        near = [m for m in (level - 1, level + 1) if 0 <= m < layers]
        stripes = grids.select("grid_id", "n0", numbers(count(level)).alias("i"))
        at = None
        for m in near:
            met = stripes.select("grid_id", "n0", place(F.col("i"), level).alias("across"), numbers(count(m)).alias("j")).select("grid_id", "across", place(F.col("j"), m).alias("along"))
            at = met if at is None else at.unionByName(met)
            if m > level:
                via = met.select("grid_id", F.lit("VIA").alias("kind"), name(level, F.col("across"), F.col("along")).alias("u"), name(m, F.col("along"), F.col("across")).alias("v"), F.lit(via_ohm).alias("value"))
                out = via if out is None else out.unionByName(via)
        if level == 0 and loads:
            at = at.unionByName(spliced)
        order = Window.partitionBy("grid_id", "across").orderBy("along")
        parts = at.distinct().withColumn("to", F.lead("along").over(order)).filter("to IS NOT NULL")
        ohm = F.lit(stripe_ohm / 2**level) * (F.col("to") - F.col("along")) / F.lit(float(EXTENT))
        out = out.unionByName(parts.select("grid_id", F.lit("R").alias("kind"), name(level, F.col("across"), F.col("along")).alias("u"), name(level, F.col("across"), F.col("to")).alias("v"), ohm.alias("value")))
    if loads:
        out = out.unionByName(spliced.select("grid_id", F.lit("I").alias("kind"), name(0, F.col("across"), F.col("along")).alias("u"), F.lit("0").alias("v"), F.lit(amps).alias("value")))
    top = layers - 1
    ends = 2 * count(top)
    chosen = grids.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(pads), ends) - 1)).alias("k")).withColumn("e", F.floor(F.col("k") * ends / F.least(F.lit(pads), ends)).cast("int"))
    side = F.when(F.col("e") % 2 == 0, place(F.lit(0), top - 1)).otherwise(place(count(top - 1) - 1, top - 1))
    pad = chosen.select("grid_id", F.lit("V").alias("kind"), name(top, place(F.floor(F.col("e") / 2).cast("int"), top), side).alias("u"), F.lit("0").alias("v"), F.lit(volt).alias("value")).distinct()
    return out.unionByName(pad)


def counted_stimulus(loads: DataFrame, total_power: float, vdd: float, count: int, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """key, amps: power / vdd split evenly over ``count`` loads, the first in the order of a hash of their key; fewer if there are fewer.

    ``loads``: key (unique), and x, y where a ``window`` (x0, x1, y0, y1, edges included) limits the choice; loads
    without a place lie in no window. The order is made in pieces, so any count is spread over tasks.
    """
    rows = loads
    if window:
        x0, x1, y0, y1 = window
        rows = rows.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    rows = rows.select("key", F.pmod(F.col("key") * 7919 + 13, F.lit(10_007)).alias("_h"))
    ranked = running(rows, [], [F.asc("_h"), F.asc("key")]).filter(F.col("rank") <= count)
    return ranked.select("key", (F.lit(total_power / vdd) / F.least("group_rows", F.lit(count))).alias("amps"))


def uniform_stimulus(loads: DataFrame, total_power: float, vdd: float, percent: int) -> DataFrame:
    """A share of the loads, picked by a hash of their key so that the pick is the same in every run; power / vdd is split evenly."""
    picked = loads.filter(F.pmod(F.col("key") * 7919 + 13, F.lit(100)) < percent)
    n = picked.agg(F.count(F.lit(1)).alias("n")).scalar()
    return picked.select("key", (F.lit(total_power / vdd) / n).alias("amps"))


def gaussian_stimulus(loads: DataFrame, total_power: float, vdd: float, mean: float = 1.0, spread: float = 1.0, seed: int = 42) -> DataFrame:
    """key, amps: power / vdd split over all loads by |N(mean, spread)| weights; the weights depend on seed and key only, not on the partitioning."""
    uniform = lambda salt: (F.pmod(F.xxhash64("key", F.lit(seed), F.lit(salt)), F.lit(1_000_003)) + 1) / F.lit(1_000_005.0)
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(2))
    rows = loads.select("key", F.abs(mean + spread * normal).alias("w"))
    return rows.select("key", (F.lit(total_power / vdd) * F.col("w") / rows.agg(F.sum("w")).scalar()).alias("amps"))


def block_patterns(nodes: DataFrame, patterns: int, total: float) -> DataFrame:
    """block, pattern, node, amps: pattern 0 is uniform, the others weigh by a hash of node and pattern; each adds up to ``total``."""
    rows = nodes.select("block", "node", F.explode(F.sequence(F.lit(0), F.lit(patterns))).alias("pattern"))
    weight = F.when(F.col("pattern") == 0, F.lit(1)).otherwise(1 + F.pmod(F.col("node") * 31 + F.col("pattern") * 17, F.lit(10)))
    rows = rows.withColumn("weight", weight)
    sums = rows.groupBy("block", "pattern").agg(F.sum("weight").alias("all"))
    return rows.join(sums, ["block", "pattern"]).select("block", "pattern", "node", (F.lit(total) * F.col("weight") / F.col("all")).alias("amps"))
