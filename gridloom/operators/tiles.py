"""Tiles that grow until they have enough ports, take in neighbours without loads, and share out the nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch
from .relational import bounding_box, in_window

_BOUNDS = ["x0", "x1", "y0", "y1"]


def uniform_tiles(places: DataFrame, key: str, nx: int, ny: int) -> DataFrame:
    """key, tile_id (row times nx plus column), x0, x1, y0, y1 of equal tiles over the extent of each key's places."""
    box = bounding_box(places, [key])
    each = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("tile_id"))
    col, row = F.col("tile_id") % nx, F.floor(F.col("tile_id") / nx)
    w, h = (F.col("x1") - F.col("x0")) / nx, (F.col("y1") - F.col("y0")) / ny
    end = lambda k, n, a, b, step: F.when(k == n - 1, F.col(b)).otherwise(F.col(a) + (k + 1) * step)
    return each.select(key, "tile_id", (F.col("x0") + col * w).alias("a"), end(col, nx, "x0", "x1", w).alias("b"), (F.col("y0") + row * h).alias("c"), end(row, ny, "y0", "y1", h).alias("d")).toDF(key, "tile_id", *_BOUNDS)


def _held(tiles: DataFrame, places: DataFrame, key: str, name: str) -> DataFrame:
    """Tiles with the number of places in them, bounds included; a place meets the tiles of its key only, a fixed number."""
    inside = in_window(F.col("x"), F.col("y"), *map(F.col, _BOUNDS))
    n = places.select(key, "x", "y").join(tiles.select(key, "tile_id", *_BOUNDS), key).filter(inside).groupBy(key, "tile_id").agg(F.count(F.lit(1)).alias(name))
    return tiles.join(n, [key, "tile_id"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def grow(tiles: DataFrame, ports: DataFrame, key: str, nx: int, ny: int, step: float = 0.1) -> DataFrame:
    """key, tile_id, bounds, ports: tiles with fewer ports than their share grow toward a neighbour with more than that.

    The share is the key's ports over its tiles, rounded up, one at least. In each of at most 2 nx ny rounds all tiles
    below it grow at once, by ``step`` of the extent of the neighbour with the greatest surplus (equal ones: left,
    right, the row before, the row after), never beyond its far side.
    """
    scratch = Scratch(tiles.sparkSession)
    ports = scratch.write(ports.select(key, "x", "y").dropna())
    share = ports.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (nx * ny))).alias("share"))
    state = scratch.write(_held(tiles, ports, key, "ports").join(share, key, "left").withColumn("share", F.coalesce("share", F.lit(1))))
    col, row = F.col("tile_id") % nx, F.floor(F.col("tile_id") / nx)
    sides = [(col > 0, -1), (col < nx - 1, 1), (row > 0, -nx), (row < ny - 1, nx)]
    ways = F.filter(F.array(*[F.when(ok, F.struct(F.lit(i).alias("way"), (F.col("tile_id") + d).alias("to"))) for i, (ok, d) in enumerate(sides)]), lambda x: x.isNotNull())
    for _ in range(2 * nx * ny):
        near = state.select(key, F.col("tile_id").alias("to"), *[F.col(c).alias(f"n_{c}") for c in _BOUNDS], (F.col("ports") - F.col("share")).alias("surplus"))
        asked = state.filter("ports < share").select("*", F.explode(ways).alias("w")).select("*", "w.way", "w.to").drop("w").join(near, [key, "to"]).filter("surplus > 0")
        best = asked.withColumn("_at", F.row_number().over(Window.partitionBy(key, "tile_id").orderBy(F.desc("surplus"), "way"))).filter("_at = 1")
        dx, dy = (F.col("n_x1") - F.col("n_x0")) * step, (F.col("n_y1") - F.col("n_y0")) * step
        moved = [
            F.when(F.col("way") == 0, F.greatest("n_x0", F.col("x0") - dx)).otherwise(F.col("x0")), F.when(F.col("way") == 1, F.least("n_x1", F.col("x1") + dx)).otherwise(F.col("x1")),
            F.when(F.col("way") == 2, F.greatest("n_y0", F.col("y0") - dy)).otherwise(F.col("y0")), F.when(F.col("way") == 3, F.least("n_y1", F.col("y1") + dy)).otherwise(F.col("y1")),
        ]
        grown = best.select(key, "tile_id", *[m.alias(f"m_{c}") for m, c in zip(moved, _BOUNDS)], "share", *_BOUNDS)
        grown = grown.filter(" OR ".join(f"m_{c} <> {c}" for c in _BOUNDS)).select(key, "tile_id", *[F.col(f"m_{c}").alias(c) for c in _BOUNDS], "share")
        new, (n,) = scratch.write_and_sum(_held(grown, ports, key, "ports").select(*state.columns), F.count(F.lit(1)))
        if not n:
            break
        old, state = state, scratch.write(state.join(new, [key, "tile_id"], "left_anti").unionByName(new))
        scratch.drop(old)
    return state.select(key, "tile_id", *_BOUNDS, "ports")


def merge_loadless(tiles: DataFrame, loads: DataFrame, key: str, nx: int, ny: int) -> DataFrame:
    """Tiles without a load, in order of their ids, become part of the first neighbour that is left (left, right, the row before, the row after), which takes their extent; a tile that has no neighbour left stays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {r.tile_id: dict(r._asdict()) for r in pdf.sort_values("tile_id").itertuples(index=False)}
        for t in list(own):
            if own[t]["loads"]:
                continue
            for ok, to in ((t % nx > 0, t - 1), (t % nx < nx - 1, t + 1), (t >= nx, t - nx), (t < nx * (ny - 1), t + nx)):
                if ok and to in own:
                    a, b = own[to], own.pop(t)
                    a.update(x0=min(a["x0"], b["x0"]), x1=max(a["x1"], b["x1"]), y0=min(a["y0"], b["y0"]), y1=max(a["y1"], b["y1"]))
                    break
        return pd.DataFrame(list(own.values()), columns=pdf.columns).drop(columns=["loads"])

    held = _held(tiles.select(key, "tile_id", *_BOUNDS), loads.dropna(subset=["x", "y"]), key, "loads").select(key, "tile_id", *_BOUNDS, "loads")
    kind = tiles.schema[key].dataType.simpleString()
    return held.groupBy(key).applyInPandas(run, f"`{key}` {kind}, tile_id int, x0 double, x1 double, y0 double, y1 double")


def shared_out(tiles: DataFrame, places: DataFrame, key: str, node: str) -> DataFrame:
    """node, tile_id: each place in the tile of the least id that holds it; places in no tile are left out."""
    inside = in_window(F.col("x"), F.col("y"), *map(F.col, _BOUNDS))
    return places.select(key, node, "x", "y").join(tiles.select(key, "tile_id", *_BOUNDS), key).filter(inside).groupBy(node).agg(F.min("tile_id").alias("tile_id"))
