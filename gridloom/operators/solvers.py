"""Solvers: layers split at ports, overlapping tiles, time stepping, and response matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .linear import block_solve, conjugate_gradients, stamp
from .tree import solve_tree


def hierarchical(edges: DataFrame, split: int, levels: int) -> DataFrame:
    """Tree solved in two parts at the ports of level ``split``: loads below go to their ports, the top is solved, then the bottom with the ports' drops fixed."""
    bottom = edges.filter(F.col("level") > split)
    below = solve_tree(bottom.withColumn("level", F.col("level") - split), levels - split).withColumn("level", F.col("level") + split)
    ports = below.filter(F.col("level") == split + 1).groupBy(F.col("parent").alias("node")).agg(F.sum("i").alias("_i"))
    top = edges.filter(F.col("level") <= split).join(ports, "node", "left")
    top = solve_tree(top.withColumn("amps", F.col("amps") + F.coalesce("_i", F.lit(0))).drop("_i"), split)
    out, above = top, top.filter(F.col("level") == split).select(F.col("node").alias("parent"), F.col("drop").alias("_d"))
    for level in range(split + 1, levels + 1):
        rows = below.filter(F.col("level") == level).join(above, "parent")
        out = out.unionByName(rows.withColumn("drop", F.col("drop") + F.col("_d")).select(top.columns))
        above = rows.select(F.col("node").alias("parent"), "_d")
    return out


def coupled(edges: DataFrame, levels: int = 3) -> DataFrame:
    """node, drop of a tree network by exact elimination: everything below level 1 is condensed to its ports, the ports' system is solved by conjugate gradients, and the rest follows from the ports."""
    below = solve_tree(edges, levels)
    top = below.filter("level = 1")
    links = top.select(F.col("node").alias("u"), F.lit("0").alias("v"), (1.0 / F.col("r")).alias("g"))
    x, _ = conjugate_gradients(stamp(links), top.select("node", F.col("i").cast("double").alias("b")), 1e-12)
    drops = x.select("node", F.col("x").alias("drop"))
    out, above = drops, drops
    for level in range(2, levels + 1):
        rows = below.filter(F.col("level") == level)
        above = rows.select("node", "parent", (F.col("r") * F.col("i")).alias("_own")).join(above.select(F.col("node").alias("parent"), F.col("drop").alias("_d")), "parent").select("node", (F.col("_d") + F.col("_own")).alias("drop"))
        out = out.unionByName(above)
    return out


def tiled(nodes: DataFrame, matrix: DataFrame, rhs: DataFrame, size: int, halo: int, sweeps: int, tolerance: float | None = None) -> DataFrame:
    """(node, x) by overlapping tiles: each tile with its halo is solved apart, with the values outside from the last sweep; the cores are kept.

    ``nodes``: node, x, y; ``matrix``: i, j, g; ``rhs``: node, b. A tile holds what lies in ``size`` squared and its
    halo, so a task's work doesn't grow with the network. Sweeps bring the result to that of the whole system. With a
    ``tolerance`` they end when the error that the changes of the last two sweeps leave is below it, and it raises if
    ``sweeps`` don't do; without one there are just so many sweeps.
    """
    scratch = Scratch(nodes.sparkSession)
    cell = lambda c, d: F.floor((F.col(c) + d) / size)
    spread = lambda c: F.explode(F.sequence(cell(c, -halo), cell(c, halo)))
    home = F.concat_ws("_", cell("x", 0), cell("y", 0))
    members = nodes.select(F.col("node").cast("string").alias("node"), home.alias("home"), "y", spread("x").alias("cx")).select("node", "home", "cx", spread("y").alias("cy"))
    members = scratch.write(members.select(F.concat_ws("_", "cx", "cy").alias("block"), "node", "home"))
    rows = matrix.select(F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), F.col("g").cast("double").alias("g"))
    rows = rows.join(members.select("block", F.col("node").alias("i")), "i").join(members.select("block", F.col("node").alias("j"), F.lit(1).alias("inside")), ["block", "j"], "left")
    rows = scratch.write(rows)
    inside = rows.filter("inside = 1").select("block", F.lit("g").alias("kind"), "i", "j", F.col("g").alias("value"))
    outside = rows.filter("inside IS NULL").select("block", "i", "j", "g")
    loads = members.join(rhs.select(F.col("node").cast("string").alias("node"), F.col("b").cast("double").alias("b")), "node").select("block", F.col("node").alias("i"), "b")
    homes = members.select(F.col("home").alias("block"), "node").distinct()
    x = last = None
    for _ in range(sweeps):
        b = loads
        if x is not None:
            flow = outside.join(x.select(F.col("node").alias("j"), "x"), "j").groupBy("block", "i").agg(F.sum(-F.col("g") * F.col("x")).alias("f"))
            b = loads.join(flow, ["block", "i"], "left").select("block", "i", (F.col("b") + F.coalesce("f", F.lit(0.0))).alias("b"))
        blocks = inside.unionByName(b.select("block", F.lit("b").alias("kind"), "i", F.col("i").alias("j"), F.col("b").alias("value")))
        solved = block_solve(blocks)
        cores = solved.join(homes, ["block", "node"]).select("node", "x")
        if tolerance is None or x is None:
            x = scratch.write(cores)
        else:
            both, (moved,) = scratch.write_and_sum(cores.join(x.withColumnRenamed("x", "_x"), "node"), F.max(F.abs(F.col("x") - F.col("_x"))))
            scratch.drop(x)
            x, moved = both.select("node", "x"), moved or 0.0
            x._scratch_path = both._scratch_path
            # Errors shrink by a nearly constant share a sweep, so what is left is the sum of the changes to come.
            share = moved / last if last else 1.0
            if moved == 0 or share < 1 and moved * share / (1 - share) <= tolerance:
                return x
            last = moved
    if tolerance is not None:
        raise RuntimeError(f"values still change after {sweeps} sweeps")
    return x


def step_rc(currents: DataFrame, key: str, scenario: list[str], steps: int, g: float, c_over_h: float, trapezoid: bool = False) -> DataFrame:
    """Backward-Euler (or trapezoidal) steps of one RC node for each key, all scenarios together: key, step, and a drop for each scenario.

    ``currents``: key, step INT, a column for each scenario; one row at most for a key and step (aggregate before), so
    a group has no more rows than there are steps. Steps without a row have no current.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load = np.zeros((steps, len(scenario)))
        load[pdf.step.to_numpy()] = pdf[scenario].to_numpy()
        v, out, old = np.zeros(len(scenario)), np.empty_like(load), np.zeros(len(scenario))
        for k in range(steps):
            v = (2 * c_over_h * v - g * v + load[k] + old) / (g + 2 * c_over_h) if trapezoid else (c_over_h * v + load[k]) / (g + c_over_h)
            out[k], old = v, load[k]
        return pd.DataFrame({key: pdf[key].iloc[0], "step": np.arange(steps, dtype=np.int32), **{s: out[:, i] for i, s in enumerate(scenario)}})

    kinds = ", ".join(f"`{s}` double" for s in scenario)
    return currents.groupBy(key).applyInPandas(run, f"`{key}` {currents.schema[key].dataType.simpleString()}, step int, {kinds}")


def schur_diagonal(stars: DataFrame) -> DataFrame:
    """Exact elimination of the centre of each star: block, port, s, its own entry of the Schur complement. ``stars``: block, port, g."""
    total = stars.groupBy("block").agg(F.sum("g").alias("all"))
    return stars.join(total, "block").select("block", "port", (F.col("g") - F.col("g") * F.col("g") / F.col("all")).alias("s"))


def schur_product(stars: DataFrame, x: DataFrame) -> DataFrame:
    """block, port, y = S x, with S the whole Schur complement of each star's ports, which is never listed: an entry (p, q) off its diagonal is -g_p g_q / sum(g).

    ``stars``: block, port, g; ``x``: block, port, x, one row at most for a port; a port without one has 0.
    """
    rows = stars.join(x.select("block", "port", "x"), ["block", "port"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    centre = rows.groupBy("block").agg((F.sum(F.col("g") * F.col("x")) / F.sum("g")).alias("c"))
    return rows.join(centre, "block").select("block", "port", (F.col("g") * (F.col("x") - F.col("c"))).alias("y"))


def singular_values(rows: DataFrame, key: str, columns: list[str]) -> list[float]:
    """Singular values of a tall matrix with a fixed, small list of columns: its Gram matrix is one aggregation, its spectrum a small local one."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = rows.agg(*[F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"g{k}") for k, (a, b) in enumerate(pairs)]).first()
    gram, at = np.zeros((len(columns), len(columns))), {c: i for i, c in enumerate(columns)}
    for (a, b), x in zip(pairs, sums):
        gram[at[a], at[b]] = gram[at[b], at[a]] = x or 0.0
    return [float(x) for x in np.sqrt(np.maximum(np.linalg.eigvalsh(gram)[::-1], 0))]
