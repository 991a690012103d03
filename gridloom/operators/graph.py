"""Graph operators: components, reachability, shortest paths, nearest ports, contraction. Every round is a join and a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch


def both_ways(edges: DataFrame, *payload: str) -> DataFrame:
    return edges.select("u", "v", *payload).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *payload))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, component: the least node that is linked to it.

    Each round a node hears its neighbours' labels and passes the least one to the node that its own label names
    (hooking); then each label takes its own label (pointer jumping). So long chains need few rounds; it ends when no
    label changes.
    """
    scratch = Scratch(edges.sparkSession)
    links = scratch.write(both_ways(edges.filter("u <> v")).distinct())
    labels = scratch.write(links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    for _ in range(max_rounds):
        heard = links.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("m")).withColumnRenamed("u", "node")
        told = labels.join(heard, "node").select(F.explode(F.array(F.struct("node", "m"), F.struct(F.col("component").alias("node"), "m"))).alias("x")).select("x.*").groupBy("node").agg(F.min("m").alias("m"))
        lower = labels.join(told, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = lower.join(jump, "component", "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "was")
        new, (changed,) = scratch.write_and_sum(moved, F.count(F.when(F.col("component") != F.col("was"), 1)))
        scratch.drop(labels)
        labels = new.drop("was")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def reach(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """node, hops: the nodes that at most so many edges lead to from ``start`` (column node), with the least number."""
    scratch = Scratch(edges.sparkSession)
    links = both_ways(edges).distinct()
    seen = start.select("node").distinct().withColumn("hops", F.lit(0))
    for k in range(1, hops + 1):
        new = links.join(seen.filter(F.col("hops") == k - 1).select(F.col("node").alias("u")), "u").select(F.col("v").alias("node")).distinct()
        seen = scratch.write(seen.unionByName(new.join(seen, "node", "left_anti").withColumn("hops", F.lit(k))))
    return seen


def parallel_minimum(edges: DataFrame) -> DataFrame:
    """One edge for each pair of nodes, the one of least r; loops and r <= 0 are left out. u < v."""
    rows = edges.filter("u <> v AND r > 0").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "r")
    return rows.groupBy("u", "v").agg(F.min("r").alias("r"))


def nearest_ports(edges: DataFrame, ports: DataFrame, k: int, r_max: float, max_rounds: int = 10_000) -> DataFrame:
    """node, port, r: the k ports of least path resistance of each node, up to r_max, over paths of any number of edges.

    A label that is not among a node's k best can't be among a neighbour's k best through it, so only the k best are
    kept, and each round passes on only those that are new or lower. It ends when there are none.
    """
    scratch = Scratch(edges.sparkSession)
    links = scratch.write(both_ways(parallel_minimum(edges), "r"))
    labels = ports.select("node", F.col("node").alias("port"), F.lit(0).cast(edges.schema["r"].dataType).alias("r"), F.lit(1).alias("new")).distinct()
    w = Window.partitionBy("node").orderBy("r", "port")
    for _ in range(max_rounds):
        sent = labels.filter("new = 1").select(F.col("node").alias("u"), "port", F.col("r").alias("d")).join(links, "u").select(F.col("v").alias("node"), "port", (F.col("d") + F.col("r")).alias("r"), F.lit(1).alias("new")).filter(F.col("r") <= r_max)
        # Of equal resistances the label that is there already counts, so it isn't passed on again.
        best = labels.withColumn("new", F.lit(0)).unionByName(sent).groupBy("node", "port").agg(F.min(F.struct("r", "new")).alias("x")).select("node", "port", "x.*")
        last = labels
        labels, (lower,) = scratch.write_and_sum(best.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn"), F.sum("new"))
        scratch.drop(last)
        if not lower:
            return labels.drop("new")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _linked(links: DataFrame, members: DataFrame) -> DataFrame:
    """tile, node: the members of each tile that links among its own members join to one of its ports."""
    at = lambda end: members.select("tile", F.col("node").alias(end)).distinct()
    inside = links.filter("u < v").join(at("u"), "u").join(at("v"), ["tile", "v"])
    labels = components(inside.select(F.struct("tile", F.col("u").alias("node")).alias("u"), F.struct("tile", F.col("v").alias("node")).alias("v"))).select("node.*", "component")
    ports = members.filter("role = 'port'").select("tile", "node")
    fed = labels.join(ports, ["tile", "node"], "left_semi").select("component").distinct()
    return labels.join(fed, "component", "left_semi").select("tile", "node").unionByName(ports).distinct()


def tile_connectivity(edges: DataFrame, members: DataFrame, ports: DataFrame, inner: DataFrame) -> DataFrame:
    """tile, node, role, added, state: every tile's members after each of its core nodes has been linked to a port, as far as the network does.

    ``members``: tile, node, role (core, halo or port); ``ports`` and ``inner`` (column node): all ports, and the nodes
    that a path to a port may pass. A core node that is linked to a port only outside its tile brings in the path of
    fewest links to its nearest port (of equal ones that over the least nodes): its inner nodes as halo, its end as a
    port, all ``added``. The state is ``linked``, ``floating`` (a core node that no path joins to a port) or
    ``dropped`` (a halo node that the tile doesn't join to its ports).
    """
    scratch = Scratch(edges.sparkSession)
    links = scratch.write(both_ways(edges.filter("u <> v")).distinct())
    members = scratch.write(members.select("tile", "node", "role").distinct())
    ports = scratch.write(ports.select("node").distinct())
    first = scratch.write(_linked(links, members))
    usable = ports.unionByName(inner.select("node")).distinct()
    grid = scratch.write(links.join(usable.withColumnRenamed("node", "u"), "u", "left_semi").join(usable.withColumnRenamed("node", "v"), "v", "left_semi"))
    near = nearest_ports(grid.filter("u < v").withColumn("r", F.lit(1)), ports, 1, float("inf"))
    hops = lambda end: near.select(F.col("node").alias(end), F.col("r").alias(f"_{end}"))
    steps = scratch.write(grid.join(hops("u"), "u").join(hops("v"), "v").filter("_v = _u - 1").groupBy("u").agg(F.min("v").alias("next")))
    cut = members.filter("role = 'core'").join(first, ["tile", "node"], "left_anti")
    apart = scratch.write(cut.join(steps.select(F.col("u").alias("node")), "node", "left_semi").select("tile", "node"))
    path = front = apart
    while not front.isEmpty():  # each step is nearer to a port
        reached = front.join(steps.withColumnRenamed("u", "node"), "node").select("tile", F.col("next").alias("node")).distinct()
        front = scratch.write(reached.join(path, ["tile", "node"], "left_anti"))
        path = scratch.write(path.unionByName(front))
    added = path.join(members, ["tile", "node"], "left_anti").join(ports.withColumn("_p", F.lit("port")), "node", "left").select("tile", "node", F.coalesce("_p", F.lit("halo")).alias("role"), F.lit(True).alias("added"))
    whole = scratch.write(members.withColumn("added", F.lit(False)).unionByName(added))
    changed = apart.select("tile").distinct()
    linked = first.join(changed, "tile", "left_anti").unionByName(_linked(links, whole.join(changed, "tile", "left_semi"))).withColumn("_l", F.lit("linked"))
    return whole.join(linked, ["tile", "node"], "left").select("tile", "node", "role", "added", F.coalesce("_l", F.when(F.col("role") == "core", "floating").otherwise("dropped")).alias("state"))


def contract(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after each node ``node`` of ``merges`` has become ``into``; edges that are loops then are dropped, parallel ones stay."""
    to = lambda c: merges.select(F.col("node").alias(c), F.col("into").alias(f"_{c}"))
    moved = edges.join(to("u"), "u", "left").join(to("v"), "v", "left")
    moved = moved.withColumn("u", F.coalesce("_u", "u")).withColumn("v", F.coalesce("_v", "v")).drop("_u", "_v")
    return moved.filter("u <> v")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree (edges), neighbours (distinct)."""
    return both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("v").alias("neighbours")).withColumnRenamed("u", "node")
