"""A whole network solved: floating islands dropped, small islands by dense kernels, large ones by conjugate gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .graph import components
from .linear import DENSE, block_solve, conjugate_gradients, stamp


def network_drop(edges: DataFrame, pads: DataFrame, loads: DataFrame, vdd: float, dense: int = DENSE, tolerance: float = 1e-9) -> DataFrame:
    """node, island, drop of every node of an island that has a pad.

    ``edges``: u, v STRING, g (conductances; ``0`` is ground, parallel edges add up). ``pads``: node, held at vdd, so
    their drop is 0. ``loads``: node, amps, drawn to ground; loads of one node add up, those elsewhere are left out.
    Nodes of islands without a pad float and are left out. NULLs in names or conductances join nothing.

    Islands of up to ``dense`` free nodes are solved apart, each in one task; all larger ones together by iteration.
    """
    scratch = Scratch(edges.sparkSession)
    live = scratch.write(edges.filter("u IS NOT NULL AND v IS NOT NULL AND g IS NOT NULL AND u <> v").select("u", "v", F.col("g").cast("double").alias("g")))
    labels = components(live.filter("u <> '0' AND v <> '0'").select("u", "v"))
    pad = pads.select("node", F.lit(True).alias("pad")).dropna().distinct()
    nodes = labels.join(pad, "node", "left").select("node", F.col("component").alias("island"), F.coalesce("pad", F.lit(False)).alias("pad"))
    fed = nodes.groupBy("island").agg(F.max("pad").alias("fed"), F.sum((~F.col("pad")).cast("long")).alias("free")).filter("fed")
    nodes = scratch.write(nodes.join(fed.select("island", "free"), "island"))
    free = nodes.filter("NOT pad").select("node", "island", "free")
    matrix = scratch.write(stamp(live).join(free.select(F.col("node").alias("i")), "i", "left_semi").join(free.select(F.col("node").alias("j")), "j", "left_semi"))
    ground = live.filter("(u = '0') <> (v = '0')").select(F.when(F.col("u") == "0", F.col("v")).otherwise(F.col("u")).alias("node"), (F.col("g") * vdd).alias("amps"))
    drawn = loads.select("node", F.col("amps").cast("double").alias("amps")).unionByName(ground).groupBy("node").agg(F.sum("amps").alias("amps"))
    rhs = scratch.write(free.join(drawn, "node", "left").select("node", "island", "free", F.coalesce("amps", F.lit(0.0)).alias("b")))
    small = rhs.filter(F.col("free") <= dense)
    g = matrix.join(small.select(F.col("node").alias("i"), F.col("island").alias("block")), "i").select("block", F.lit("g").alias("kind"), "i", "j", F.col("g").alias("value"))
    b = small.select(F.col("island").alias("block"), F.lit("b").alias("kind"), F.col("node").alias("i"), F.col("node").alias("j"), F.col("b").alias("value"))
    solved = block_solve(g.unionByName(b)).select("node", F.col("x").alias("drop"))
    large = rhs.filter(F.col("free") > dense).select("node", "b")
    if not large.isEmpty():
        own = matrix.join(large.select(F.col("node").alias("i")), "i", "left_semi")
        solved = solved.unionByName(conjugate_gradients(own, large, tolerance)[0].select("node", F.col("x").alias("drop")))
    return nodes.join(solved, "node", "left").select("node", "island", F.when(F.col("pad"), 0.0).otherwise(F.col("drop")).alias("drop"))
