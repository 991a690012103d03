"""Selections, joins and sets of networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.elements import end_name


def typed_values(elements: DataFrame) -> DataFrame:
    """One column for each kind of value: kOhm, fF, nH, mA and V become Ohm, F, H, A and V; an unknown type is a resistor."""
    t = F.upper(F.trim("elem_type"))
    kind = F.when(t.isin("R", "C", "L", "V", "I"), t).otherwise("R")
    one = lambda k, factor: F.when(kind == k, F.col("elem_value") * factor)
    return elements.select("elem_id", kind.alias("kind"), one("R", 1e3).alias("ohm"), one("C", 1e-15).alias("farad"), one("L", 1e-9).alias("henry"), one("I", 1e-3).alias("ampere"), one("V", 1.0).alias("volt"))


def of_type(elements: DataFrame, kind: str) -> DataFrame:
    return elements.filter(F.upper(F.trim("elem_type")) == kind)


def elements_once(elements: DataFrame) -> DataFrame:
    """One row for each elem_id: the latest, by loaded_at and then by its columns; so copies and late corrections count once."""
    w = Window.partitionBy("elem_id").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_last("elem_value"), "u", "v")
    return elements.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_ends(elements: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """Elements with the ids of both ends, ``a`` and ``b``; with ``left`` an end that is no node has a NULL id.

    Names are compared without boundary mark and without regard to the layer's case. Ground never is a node.
    """
    at = nodes.select("design_id", end_name(F.col("node")).alias("_name"), "node_id")
    e = elements.withColumn("_u", F.nullif(end_name(F.col("u")), F.lit("0"))).withColumn("_v", F.nullif(end_name(F.col("v")), F.lit("0")))
    e = e.join(at.select("design_id", F.col("_name").alias("_u"), F.col("node_id").alias("a")), ["design_id", "_u"], how)
    return e.join(at.select("design_id", F.col("_name").alias("_v"), F.col("node_id").alias("b")), ["design_id", "_v"], how).drop("_u", "_v")


def induced(edges: DataFrame, nodes: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Edges whose two ends are both in ``nodes`` (one column, node)."""
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", u), u, "left_semi").join(keep.withColumnRenamed("node", v), v, "left_semi")


def boundary_edges(edges: DataFrame, nodes: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Edges with exactly one end in ``nodes``."""
    keep = nodes.select("node").distinct()
    marked = edges.join(keep.select(F.col("node").alias(u), F.lit(True).alias("_a")), u, "left").join(keep.select(F.col("node").alias(v), F.lit(True).alias("_b")), v, "left")
    return marked.filter(F.coalesce("_a", F.lit(False)) != F.coalesce("_b", F.lit(False))).drop("_a", "_b")


def in_window(x: Column, y: Column, x0, x1, y0, y1) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def tile_of(x: Column, y: Column, nx: int, ny: int, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Number of the tile (row * nx + column) of nx by ny over a bounding box; the last row and column hold the maximum; an axis without extent counts as 1 wide."""
    wide = lambda lo, hi: F.when(hi > lo, hi - lo).otherwise(1)
    cell = lambda p, lo, hi, n: F.least(F.floor((p - lo) * n / wide(lo, hi)), F.lit(n - 1))
    return (cell(y, y0, y1, ny) * nx + cell(x, x0, x1, nx)).cast("int")


def bounding_box(places: DataFrame, by: list[str] | None = None) -> DataFrame:
    return places.groupBy(*(by or [])).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def halo_members(places: DataFrame, box: DataFrame, nx: int, ny: int, share: float) -> DataFrame:
    """tile_id, node for every tile whose rectangle, grown on each side by a share of its extent and clipped, holds the node.

    A node reaches only tiles whose column and row lie within the halo, so they are listed, not searched.
    """
    rows = places.withColumns({c: box.select(c).scalar() for c in ("x0", "x1", "y0", "y1")})
    tile_w, tile_h = (F.col("x1") - F.col("x0")) / nx, (F.col("y1") - F.col("y0")) / ny
    span = lambda p, lo, size, n: (
        F.greatest(F.lit(0), F.ceil((p - lo - size * share) / size) - 1).cast("int"), F.least(F.lit(n - 1), F.floor((p - lo + size * share) / size)).cast("int"))
    c0, c1 = span(F.col("x"), F.col("x0"), tile_w, nx)
    r0, r1 = span(F.col("y"), F.col("y0"), tile_h, ny)
    return rows.select("node", F.explode(F.sequence(c0, c1)).alias("c"), r0.alias("r0"), r1.alias("r1")).select("node", "c", F.explode(F.sequence("r0", "r1")).alias("r")).select((F.col("r") * nx + F.col("c")).alias("tile_id"), "node")


def nearest_in_cells(points: DataFrame, targets: DataFrame, k: int, cell: int) -> DataFrame:
    """The k nearest targets of each point among those within ``cell`` of it on both axes: node, target, d2, rank.

    Both sides meet in grid cells of that size, a target in its own and the eight around; ties go to the smaller target.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    t = targets.select(F.col("node").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"), around.alias("dx")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dy"))
    t = t.select("target", "tx", "ty", (at("tx") + F.col("dx")).alias("cx"), (at("ty") + F.col("dy")).alias("cy"))
    met = points.select("node", "x", "y", at("x").alias("cx"), at("y").alias("cy")).join(t, ["cx", "cy"])
    d2 = (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2
    near = met.filter((F.abs(F.col("x") - F.col("tx")) <= cell) & (F.abs(F.col("y") - F.col("ty")) <= cell)).select("node", "target", d2.cast("bigint").alias("d2"))
    w = Window.partitionBy("node").orderBy("d2", "target")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ring(x: Column, y: Column, x0: float, x1: float, y0: float, y1: float, width: float, rings: int) -> Column:
    """Number of the ring around a rectangle by Euclidean distance: 0 inside, then one for each width, the last one open."""
    dx, dy = F.greatest(x0 - x, x - x1, F.lit(0.0)), F.greatest(y0 - y, y - y1, F.lit(0.0))
    d = F.sqrt(dx * dx + dy * dy)
    return F.when(d == 0, 0).otherwise(F.least(F.floor(d / width) + 1, F.lit(rings))).cast("int")
