"""Linear systems of networks: stamping, blocks, Schur complements, iterations, and dense kernels for small blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch

#: Unknowns of a block that is solved by a dense kernel; larger ones take the iteration.
DENSE = 3_000


def stamp(edges: DataFrame, ground: str = "0") -> DataFrame:
    """The conductance matrix as rows (i, j, g): parallel edges add up, an edge to ground adds to the diagonal only, loops and NULL conductances are skipped."""
    e = edges.filter(F.col("g").isNotNull() & (F.col("u") != F.col("v")))
    entry = lambda i, j, sign: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (F.col("g") * sign).alias("g"))
    rows = e.select(F.explode(F.array(entry("u", "u", 1), entry("v", "v", 1), entry("u", "v", -1), entry("v", "u", -1))).alias("x")).select("x.*")
    return rows.filter((F.col("i") != ground) & (F.col("j") != ground)).groupBy("i", "j").agg(F.sum("g").alias("g"))


def with_roles(matrix: DataFrame, roles: DataFrame, default: str) -> DataFrame:
    """(i, j, g, row_role, col_role); a node without a role has the default one."""
    r = lambda c, name: roles.select(F.col("node").alias(c), F.col("role").alias(name))
    out = matrix.join(r("i", "row_role"), "i", "left").join(r("j", "col_role"), "j", "left")
    return out.fillna(default, ["row_role", "col_role"])


def multiply(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """matrix times vector (node, x), as (node, y)."""
    return matrix.join(vector.withColumnRenamed("node", "j"), "j").groupBy("i").agg(F.sum(F.col("g") * F.col("x")).alias("y")).withColumnRenamed("i", "node")


def jacobi(matrix: DataFrame, rhs: DataFrame, sweeps: int) -> DataFrame:
    """(node, x) after a fixed number of Jacobi sweeps from zero; ``rhs``: node, b for every unknown."""
    scratch = Scratch(matrix.sparkSession)
    matrix = scratch.write(matrix)
    diagonal = matrix.filter("i = j").select(F.col("i").alias("node"), F.col("g").alias("d"))
    off = matrix.filter("i <> j")
    base = scratch.write(rhs.join(diagonal, "node"))
    x = base.select("node", (F.col("b") / F.col("d")).alias("x"))
    for _ in range(sweeps - 1):
        x = base.join(multiply(off, x), "node", "left").select("node", ((F.col("b") - F.coalesce("y", F.lit(0.0))) / F.col("d")).alias("x"))
    return x


def conjugate_gradients(matrix: DataFrame, rhs: DataFrame, tolerance: float = 1e-8, max_steps: int = 500) -> tuple[DataFrame, list[float]]:
    """Diagonally preconditioned conjugate gradients over rows: (node, x) and the relative residuals; raises if it doesn't converge.

    A step is two jobs: the product of matrix and direction, and the new vectors; each is written, with its sums taken
    on the way, so a lost executor costs one step at most.
    """
    scratch = Scratch(matrix.sparkSession)
    m = scratch.write(matrix)
    diagonal = m.filter("i = j").select(F.col("i").alias("node"), F.col("g").alias("d"))
    z = F.col("r") / F.col("d")
    size = F.sum(F.col("r") ** 2)
    start = rhs.join(diagonal, "node").select("node", "d", F.lit(0.0).alias("x"), F.col("b").cast("double").alias("r"), (F.col("b") / F.col("d")).alias("p"))
    state, (rz, norm) = scratch.write_and_sum(start, F.sum(F.col("r") * z), size)
    residuals: list[float] = []
    if not norm:
        return state.select("node", "x"), residuals
    for _ in range(max_steps):
        q, (pq,) = scratch.write_and_sum(state.join(multiply(m, state.select("node", F.col("p").alias("x"))), "node").withColumnRenamed("y", "q"), F.sum(F.col("p") * F.col("q")))
        alpha = rz / pq
        r = F.col("r") - alpha * F.col("q")
        # The next direction needs the new residual's sum; it is added when the direction is used.
        stepped, (new, left) = scratch.write_and_sum(q.select("node", "d", (F.col("x") + alpha * F.col("p")).alias("x"), r.alias("r"), "p"), F.sum(F.col("r") * z), size)
        residuals.append((left / norm) ** 0.5)
        scratch.drop(q)
        scratch.drop(state)
        state, last, rz = stepped.withColumn("p", z + (new / rz) * F.col("p")), stepped, new
        if residuals[-1] <= tolerance:
            return last.select("node", "x"), residuals
        state._scratch_path = last._scratch_path
    raise RuntimeError(f"no convergence in {max_steps} steps, residual {residuals[-1]:.3g}")


def _system(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, dense matrix and load of the unknowns in a block of rows (kind, i, j, value)."""
    b, g = pdf[pdf.kind == "b"], pdf[pdf.kind == "g"]
    names = np.sort(b.i.to_numpy().astype(str))
    m = np.zeros((len(names), len(names)))
    np.add.at(m, (np.searchsorted(names, g.i.to_numpy().astype(str)), np.searchsorted(names, g.j.to_numpy().astype(str))), g.value.to_numpy())
    rhs = np.zeros(len(names))
    rhs[np.searchsorted(names, b.i.to_numpy().astype(str))] = b.value.to_numpy()
    return names, m, rhs


def block_solve(blocks: DataFrame) -> DataFrame:
    """Solves independent small blocks, each in one task: block, node, x. ``blocks``: block, kind ('g' matrix, 'b' right side), i, j, value.

    A block of more than DENSE unknowns is refused; it belongs to ``conjugate_gradients``. A singular block gives NaN.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m, rhs = _system(pdf)
        if len(names) > DENSE:
            raise ValueError(f"{len(names)} unknowns in one block")
        try:
            x = np.linalg.solve(m, rhs)
        except np.linalg.LinAlgError:
            x = np.full(len(rhs), np.nan)
        return pd.DataFrame({"block": pdf.block.iloc[0], "node": names, "x": x})

    kind = blocks.schema["block"].dataType.simpleString()
    return blocks.groupBy("block").applyInPandas(run, f"block {kind}, node string, x double")
