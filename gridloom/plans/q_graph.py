"""Graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.values import layer_number, node_place
from ..operators import graph as g, relational as rel, tiles as tl
from .q_relational import _ENDS, _PLACE, _once, layer_split_ports
from .registry import Tables, query
from .views import MESH, THIN, mesh, thin

_LABELS = """two AS (SELECT u, v FROM thin UNION SELECT v, u FROM thin), vertex AS (SELECT DISTINCT u AS node FROM two),
  reach(node, component) USING KEY (node) AS (
    SELECT node, node FROM vertex
    UNION
    SELECT t.v, min(r.component) FROM reach r JOIN two t ON t.u = r.node JOIN recurring.reach o ON o.node = t.v WHERE r.component < o.component GROUP BY t.v)"""


@query(f"WITH RECURSIVE {THIN}, {_LABELS} SELECT node, component FROM reach")
def connected_components(t: Tables) -> DataFrame:
    return g.components(thin(t))


@query(f"""WITH RECURSIVE {THIN}, {_LABELS}, s AS (SELECT component FROM reach WHERE node IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 100 = 7))
SELECT node FROM reach WHERE component IN (SELECT component FROM s)""")
def component_of_node(t: Tables) -> DataFrame:
    """All nodes of the components that hold one of the given nodes."""
    labels = g.components(thin(t))
    start = t.customer.filter("c_custkey % 100 = 7").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return labels.join(labels.join(start, "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node")


@query(f"""WITH RECURSIVE {THIN}, {_LABELS}, p AS (SELECT component, count(*) AS nodes, count(*) FILTER (node IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 5 = 0)) AS pads FROM reach GROUP BY 1)
SELECT component, nodes FROM p WHERE pads = 0""")
def floating_islands(t: Tables) -> DataFrame:
    """Components without a pad, with their sizes."""
    pads = t.customer.filter("c_custkey % 5 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.lit(1).alias("pad"))
    labels = g.components(thin(t)).join(pads, "node", "left")
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.count("pad").alias("pads")).filter("pads = 0").select("component", "nodes")


@query(f"""WITH RECURSIVE {THIN}, {_LABELS}, n AS (SELECT component, min(c_nationkey) AS net FROM reach JOIN customer ON node = 'c' || c_custkey WHERE c_custkey % 3 = 0 GROUP BY 1)
SELECT node, net FROM reach JOIN n USING (component)""")
def propagate_nets(t: Tables) -> DataFrame:
    """Each component takes the least net that one of its named nodes has; components without a name are left out."""
    labels = g.components(thin(t))
    named = t.customer.filter("c_custkey % 3 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"), "c_nationkey")
    nets = labels.join(named, "node").groupBy("component").agg(F.min("c_nationkey").alias("net"))
    return labels.join(nets, "component").select("node", "net")


@query(f"""WITH {THIN}, two AS (SELECT u, v FROM thin WHERE r <= 6 UNION SELECT v, u FROM thin WHERE r <= 6), h0 AS (SELECT 'c' || c_custkey AS node, 0 AS hops FROM customer WHERE c_custkey % 200 = 3),
  h1 AS (SELECT DISTINCT v AS node, 1 AS hops FROM two JOIN h0 ON node = u), h2 AS (SELECT DISTINCT v, 2 FROM two JOIN h1 ON node = u), h3 AS (SELECT DISTINCT v, 3 FROM two JOIN (SELECT v AS node FROM h2) ON node = u),
  a AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM a GROUP BY node""")
def bounded_zero_ohm_reach(t: Tables) -> DataFrame:
    """Nodes within three links of low resistance from the terminals."""
    start = t.customer.filter("c_custkey % 200 = 3").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return g.reach(thin(t).filter("r <= 6").select("u", "v"), start, 3)


_PATHS = f"""{THIN}, e0 AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(r) AS r FROM thin GROUP BY 1, 2), e AS (SELECT u, v, r FROM e0 UNION ALL SELECT v, u, r FROM e0)"""


@query(f"""WITH RECURSIVE {_PATHS}, reach(node, r) USING KEY (node) AS (
    SELECT 'c' || c_custkey, CAST(0 AS BIGINT) FROM customer WHERE c_custkey % 300 = 11
    UNION
    SELECT e.v, CAST(min(d.r + e.r) AS BIGINT) FROM reach d JOIN e ON e.u = d.node LEFT JOIN recurring.reach o ON o.node = e.v WHERE o.node IS NULL OR d.r + e.r < o.r GROUP BY e.v)
SELECT node, r FROM reach""")
def shortest_resistance(t: Tables) -> DataFrame:
    """Least path resistance to the nearest of a few nodes, over any number of links."""
    ports = t.customer.filter("c_custkey % 300 = 11").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return g.nearest_ports(thin(t), ports, 1, float("inf")).select("node", "r")


@query(f"""WITH RECURSIVE {_PATHS}, reach(node, port, r) USING KEY (node, port) AS (
    SELECT 'c' || c_custkey, 'c' || c_custkey, CAST(0 AS BIGINT) FROM customer WHERE c_custkey % 20 = 4
    UNION
    SELECT e.v, d.port, CAST(min(d.r + e.r) AS BIGINT) FROM reach d JOIN e ON e.u = d.node LEFT JOIN recurring.reach o ON o.node = e.v AND o.port = d.port
    WHERE d.r + e.r <= 40 AND (o.node IS NULL OR d.r + e.r < o.r) GROUP BY e.v, d.port),
  k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY r, port) AS n FROM reach)
SELECT node, port, r FROM k WHERE n <= 2""")
def k_nearest_ports(t: Tables) -> DataFrame:
    ports = t.customer.filter("c_custkey % 20 = 4").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return g.nearest_ports(thin(t), ports, 2, 40.0)


@query(f"""WITH {_ENDS} SELECT least(a, b) AS u, greatest(a, b) AS v, min(elem_value) AS r FROM ends WHERE upper(trim(elem_type)) = 'R' AND elem_value > 0 AND a <> b GROUP BY 1, 2""")
def min_parallel_resistance(t: Tables) -> DataFrame:
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes)
    return g.parallel_minimum(e.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("elem_value").alias("r")))


@query(f"""WITH {MESH}, m AS (SELECT u, 'p' || (CAST(substr(v, 2) AS BIGINT) // 10) AS v, g FROM mesh) SELECT u, v, count(*) AS parallel, CAST(sum(g) AS BIGINT) AS g FROM m GROUP BY 1, 2""")
def contract_nodes(t: Tables) -> DataFrame:
    """Parts merged by tens; parallel edges then add up."""
    merges = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.concat(F.lit("p"), F.expr("p_partkey div 10")).alias("into"))
    return g.contract(mesh(t), merges).groupBy("u", "v").agg(F.count(F.lit(1)).alias("parallel"), F.sum("g").alias("g"))


@query(f"""WITH RECURSIVE {THIN}, inside AS (SELECT * FROM thin WHERE CAST(substr(u, 2) AS BIGINT) % 10 <> 0), thin2 AS (SELECT * FROM inside), two AS (SELECT u, v FROM thin2 UNION SELECT v, u FROM thin2), vertex AS (SELECT DISTINCT u AS node FROM two),
  reach(node, component) USING KEY (node) AS (SELECT node, node FROM vertex UNION
    SELECT t.v, min(r.component) FROM reach r JOIN two t ON t.u = r.node JOIN recurring.reach o ON o.node = t.v WHERE r.component < o.component GROUP BY t.v)
SELECT component, count(*) AS nodes FROM reach GROUP BY 1""")
def partition_components(t: Tables) -> DataFrame:
    """Components of what is left without the separators."""
    inside = thin(t).filter(F.substring("u", 2, 20).cast("bigint") % 10 != 0)
    return g.components(inside).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


_SIDES = f"""{_ENDS}, n AS (SELECT node_id, TRY_CAST(nullif(regexp_extract(coalesce(layer, nullif(regexp_extract(node, {_PLACE}, 3), '')), '([0-9]+)', 1), '') AS INTEGER) AS num FROM grid_nodes),
  res AS (SELECT a AS u, b AS v, p.num AS pn, q.num AS qn FROM ends JOIN n p ON p.node_id = a JOIN n q ON q.node_id = b WHERE upper(trim(elem_type)) = 'R' AND a <> b)"""


def _layers(t: Tables) -> DataFrame:
    """node_id, num: the number of each node's layer, given or from its name."""
    return t.grid_nodes.select("node_id", layer_number(F.coalesce("layer", node_place(F.col("node"))["layer"])).alias("num"))


def _resistors(t: Tables) -> DataFrame:
    """u, v, pn, qn: resistors between nodes on file, with the numbers of both layers."""
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes).filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    at = lambda end, num: _layers(t).select(F.col("node_id").alias(end), F.col("num").alias(num))
    return e.join(at("u", "pn"), "u").join(at("v", "qn"), "v")


@query(f"""WITH RECURSIVE {_SIDES}, e AS (SELECT u, v FROM res WHERE (pn IS NULL OR qn IS NULL) AND coalesce(pn, 3) >= 3 AND coalesce(qn, 3) >= 3), two AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
  reach(id) AS (SELECT node_id FROM n WHERE num >= 3 UNION SELECT v FROM reach JOIN two ON u = id)
SELECT node_id, CASE WHEN num >= 3 THEN 'top' WHEN num < 3 THEN 'bottom' WHEN node_id IN (SELECT id FROM reach) THEN 'top' ELSE 'none' END AS side FROM n""")
def layer_split_sides(t: Tables) -> DataFrame:
    """The side of the split at layer 3 that each node is on; a node without a layer joins the top if resistors over such nodes lead there."""
    top = lambda c: F.coalesce(c, F.lit(3)) >= 3
    e = _resistors(t).filter("pn IS NULL OR qn IS NULL").filter(top("pn") & top("qn"))
    labels = g.components(e.select("u", "v")).join(_layers(t).withColumnRenamed("node_id", "node"), "node")
    led = labels.filter("num IS NOT NULL").select("component").distinct()
    joined = labels.filter("num IS NULL").join(led, "component", "left_semi").select(F.col("node").alias("node_id"), F.lit("top").alias("led"))
    side = F.when(F.col("num") >= 3, "top").when(F.col("num") < 3, "bottom").otherwise(F.coalesce("led", F.lit("none")))
    return _layers(t).join(joined, "node_id", "left").select("node_id", side.alias("side"))


@query(f"""WITH RECURSIVE {_SIDES}, port AS (SELECT DISTINCT CASE WHEN pn >= 3 THEN u ELSE v END AS id FROM res WHERE (pn >= 3) <> (qn >= 3)),
  e AS (SELECT u, v FROM res WHERE u NOT IN (SELECT id FROM port) AND v NOT IN (SELECT id FROM port)), two AS (SELECT u, v FROM e UNION SELECT v, u FROM e), vertex AS (SELECT DISTINCT u AS node FROM two),
  reach(node, component) USING KEY (node) AS (SELECT node, node FROM vertex UNION
    SELECT t.v, min(r.component) FROM reach r JOIN two t ON t.u = r.node JOIN recurring.reach o ON o.node = t.v WHERE r.component < o.component GROUP BY t.v)
SELECT component, count(*) AS nodes FROM reach GROUP BY 1""")
def split_network_components(t: Tables) -> DataFrame:
    """What the resistors still join once the ports of the split at layer 3 are taken out: each component's least node and size."""
    e = _resistors(t)
    port = e.filter((F.col("pn") >= 3) != (F.col("qn") >= 3)).select(F.when(F.col("pn") >= 3, F.col("u")).otherwise(F.col("v")).alias("id")).distinct()
    rest = e.join(port.withColumnRenamed("id", "u"), "u", "left_anti").join(port.withColumnRenamed("id", "v"), "v", "left_anti")
    return g.components(rest.select("u", "v")).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""WITH {_ENDS} SELECT design_id, count(*) FILTER (upper(trim(elem_type)) = 'R' AND elem_value < 1e-6::DOUBLE) AS shorts, count(*) FILTER (u = v) AS loops,
  count(*) FILTER (a IS NULL AND ltrim(u, '*') <> '0') AS unknown_u, count(*) FILTER (ltrim(v, '*') = '0' OR ltrim(u, '*') = '0') AS at_ground, count(*) FILTER (elem_value IS NULL) AS without_value FROM ends GROUP BY 1""")
def netlist_lint(t: Tables) -> DataFrame:
    e = rel.with_ends(_once(t), t.grid_nodes, "left")
    bare = lambda c: F.ltrim(F.col(c), F.lit("*"))
    n = lambda c: F.count(F.when(c, 1))
    return e.groupBy("design_id").agg(
        n((F.upper(F.trim("elem_type")) == "R") & (F.col("elem_value") < 1e-6)).alias("shorts"), n(F.col("u") == F.col("v")).alias("loops"),
        n(F.col("a").isNull() & (bare("u") != "0")).alias("unknown_u"), n((bare("v") == "0") | (bare("u") == "0")).alias("at_ground"), n(F.col("elem_value").isNull()).alias("without_value"),
    )


@query(f"""WITH {_ENDS}, e AS (SELECT a AS u, b AS v FROM ends WHERE upper(trim(elem_type)) = 'R' AND a IS NOT NULL AND b IS NOT NULL), d AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)
SELECT u AS node, count(*) AS degree, count(DISTINCT v) AS neighbours FROM d GROUP BY 1""")
def node_degrees(t: Tables) -> DataFrame:
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes)
    return g.degrees(e.select(F.col("a").alias("u"), F.col("b").alias("v")))


@query(f"""WITH {_ENDS} SELECT least(a, b) AS u, greatest(a, b) AS v, min(elem_id) AS elem_id FROM ends WHERE upper(trim(elem_type)) = 'R' AND a <> b GROUP BY 1, 2""")
def undirected_first_edge(t: Tables) -> DataFrame:
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes).filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("elem_id").alias("elem_id"))


@query(f"""WITH {_ENDS}, tile AS (SELECT node_id, tile_x, tile_y, is_pad FROM grid_nodes), e AS (SELECT p.tile_x, p.tile_y, a, b FROM ends JOIN tile p ON p.node_id = a JOIN tile q ON q.node_id = b
  WHERE upper(trim(elem_type)) = 'R' AND p.tile_x = q.tile_x AND p.tile_y = q.tile_y), s AS (SELECT a AS id FROM e UNION SELECT b FROM e)
SELECT design_id, tile_x, tile_y, count(*) AS nodes, count(s.id) AS linked_inside FROM grid_nodes n LEFT JOIN s ON s.id = n.node_id WHERE tile_x IS NOT NULL GROUP BY ALL""")
def tile_port_reachability(t: Tables) -> DataFrame:
    """For each tile of a design, how many of its nodes a resistor inside the tile touches."""
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes).select("a", "b")
    at = lambda end, k: t.grid_nodes.select(F.col("node_id").alias(end), F.col("tile_x").alias(f"x{k}"), F.col("tile_y").alias(f"y{k}"))
    inside = e.join(at("a", 1), "a").join(at("b", 2), "b").filter("x1 = x2 AND y1 = y2")
    used = inside.select(F.col("a").alias("node_id")).union(inside.select("b")).distinct().withColumn("one", F.lit(1))
    n = t.grid_nodes.filter("tile_x IS NOT NULL").join(used, "node_id", "left")
    return n.groupBy("design_id", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("nodes"), F.count("one").alias("linked_inside"))


def tile_members(t: Tables, ports: DataFrame, halo: float) -> DataFrame:
    """tile, node, role: each tile's nodes below layer 3, and the others and the ports in its extent and a halo of that share of it on each side.

    Tiles are cells of a regular grid and the halo is narrower than a cell, so only the tiles around a node are asked.
    """
    places = t.grid_nodes.filter("tile_x IS NOT NULL AND tile_y IS NOT NULL")
    box = places.groupBy("design_id", "tile_x", "tile_y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    at = places.join(ports.select(F.col("port").alias("node_id"), F.lit(True).alias("port")), "node_id", "left").filter("port OR layer IS NOT NULL")
    at = at.filter(F.coalesce("port", F.lit(False)) | _below()).select("design_id", "node_id", "port", "x", "y", F.col("tile_x").alias("hx"), F.col("tile_y").alias("hy"))
    at = at.select("*", F.explode(near).alias("dx")).select("*", F.explode(near).alias("dy")).withColumn("tile_x", F.col("hx") + F.col("dx")).withColumn("tile_y", F.col("hy") + F.col("dy"))
    wide, high = (F.col("x1") - F.col("x0")) * halo, (F.col("y1") - F.col("y0")) * halo
    inside = rel.in_window(F.col("x"), F.col("y"), F.col("x0") - wide, F.col("x1") + wide, F.col("y0") - high, F.col("y1") + high)
    own = (F.col("dx") == 0) & (F.col("dy") == 0)
    role = F.when(F.col("port"), "port").when(own, "core").otherwise("halo")
    return at.join(box, ["design_id", "tile_x", "tile_y"]).filter(own | inside).select(F.struct("design_id", "tile_x", "tile_y").alias("tile"), F.col("node_id").alias("node"), role.alias("role"))


def _below():
    return F.col("layer").isNotNull() & ~F.coalesce(layer_number(F.col("layer")) >= 3, F.lit(False))


@query()
def tile_port_connectivity(t: Tables) -> DataFrame:
    """Each tile of the grid below layer 3: its core nodes and those that float, and its halo and ports after unreachable nodes are dropped and paths to the nearest port brought in."""
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes).select(F.col("a").alias("u"), F.col("b").alias("v"))
    ports = layer_split_ports(t)
    found = g.tile_connectivity(e, tile_members(t, ports, 0.3), ports.select(F.col("port").alias("node")), t.grid_nodes.filter(_below()).select(F.col("node_id").alias("node")))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return found.groupBy("tile").agg(
        n("role = 'core'").alias("core"), n("state = 'floating'").alias("floating"), n("role = 'halo' AND state = 'linked'").alias("halo"), n("state = 'dropped'").alias("halo_dropped"),
        n("role = 'halo' AND added").alias("halo_added"), n("role = 'port'").alias("ports"), n("role = 'port' AND added").alias("ports_added"),
    ).select("tile.*", "core", "floating", "halo", "halo_dropped", "halo_added", "ports", "ports_added")


@query()
def grown_tile_assignment(t: Tables) -> DataFrame:
    """Every placed node below layer 3 in one of 4 by 3 tiles of its design, after tiles with few ports have grown and tiles without a source have been taken in."""
    places = t.grid_nodes.select("design_id", "node_id", "node", "x", "y", "layer").dropna(subset=["x", "y"])
    ports = places.join(layer_split_ports(t).withColumnRenamed("port", "node_id"), "node_id", "left_semi")
    runs = t.solve_runs.select("run_id", "design_id")
    loads = places.join(t.pwl_sources.select("run_id", "node").join(runs, "run_id"), ["design_id", "node"], "left_semi")
    grown = tl.grow(tl.uniform_tiles(places, "design_id", 4, 3), ports, "design_id", 4, 3)
    return tl.shared_out(tl.merge_loadless(grown, loads, "design_id", 4, 3), places.filter(_below()), "design_id", "node_id")
