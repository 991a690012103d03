"""Projections, joins, aggregations, rankings and sets over networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.values import layer_number, net_kind, node_place, node_place_anywhere
from ..functions.waveforms import pulse_at, pulse_average, pwl_at, pwl_average
from ..operators import aggregates as ag, relational as rel, tree as tr
from ..operators.running import running
from .registry import Tables, query
from .views import LATTICE, MESH, SOLVED, THIN, TREE, lattice, mesh, thin, tree

_ONCE = """once AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY loaded_at DESC NULLS LAST, elem_value DESC NULLS LAST, u, v) AS rn FROM grid_elements) WHERE rn = 1)"""


def _end(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^\*', ''), '^([0-9]+_[0-9]+_)m([0-9]+)$', '\1M\2')"


_ENDS = rf"""{_ONCE}, nn AS (SELECT design_id, node_id, {_end('node')} AS name FROM grid_nodes),
  ends AS (SELECT e.*, a.node_id AS a, b.node_id AS b FROM once e LEFT JOIN nn a ON a.design_id = e.design_id AND a.name = nullif({_end('e.u')}, '0')
           LEFT JOIN nn b ON b.design_id = e.design_id AND b.name = nullif({_end('e.v')}, '0'))"""


def _once(t: Tables) -> DataFrame:
    return rel.elements_once(t.grid_elements)


# Projections and filters


@query(f"WITH {_ONCE} SELECT elem_id, design_id, elem_value FROM once WHERE upper(trim(elem_type)) = 'R'")
def resistive_elements(t: Tables) -> DataFrame:
    return rel.of_type(_once(t), "R").select("elem_id", "design_id", "elem_value")


@query(f"WITH {_ONCE} SELECT elem_id, design_id, elem_value AS femtofarad FROM once WHERE upper(trim(elem_type)) = 'C'")
def capacitive_elements(t: Tables) -> DataFrame:
    return rel.of_type(_once(t), "C").select("elem_id", "design_id", F.col("elem_value").alias("femtofarad"))


@query(f"""WITH {_ENDS} SELECT coalesce(a, b) AS node_id, round(sum(abs(elem_value)), 6) AS milliamps FROM ends
WHERE upper(trim(elem_type)) = 'I' AND elem_value <> 0 AND coalesce(a, b) IS NOT NULL GROUP BY 1""")
def current_per_node(t: Tables) -> DataFrame:
    """Sink current of each node; a source counts at its first end on file, else at the second."""
    ends = rel.with_ends(rel.of_type(_once(t), "I").filter("elem_value <> 0"), t.grid_nodes, "left")
    return ends.select(F.coalesce("a", "b").alias("node_id"), "elem_value").dropna(subset=["node_id"]).groupBy("node_id").agg(F.round(F.sum(F.abs("elem_value")), 6).alias("milliamps"))


@query(f"""WITH {_ONCE}, k AS (SELECT *, CASE WHEN upper(trim(elem_type)) IN ('R','C','L','V','I') THEN upper(trim(elem_type)) ELSE 'R' END AS kind FROM once)
SELECT elem_id, kind, CASE WHEN kind = 'R' THEN elem_value * 1e3::DOUBLE END AS ohm, CASE WHEN kind = 'C' THEN elem_value * 1e-15::DOUBLE END AS farad,
  CASE WHEN kind = 'L' THEN elem_value * 1e-9::DOUBLE END AS henry, CASE WHEN kind = 'I' THEN elem_value * 1e-3::DOUBLE END AS ampere, CASE WHEN kind = 'V' THEN elem_value END AS volt FROM k""")
def typed_element_values(t: Tables) -> DataFrame:
    return rel.typed_values(_once(t))


_PLACE = r"'^(-?[0-9]+(?:\.[0-9]+)?)_(-?[0-9]+(?:\.[0-9]+)?)(?:_([A-Za-z]*[0-9]+))?$'"


@query(rf"""WITH p AS (SELECT node_id, node, x, y, layer, nullif(regexp_extract(node, {_PLACE}, 1), '')::DOUBLE AS px, nullif(regexp_extract(node, {_PLACE}, 2), '')::DOUBLE AS py,
  nullif(regexp_extract(node, {_PLACE}, 3), '') AS pl FROM grid_nodes)
SELECT node_id, coalesce(x, px) AS x, coalesce(y, py) AS y, coalesce(layer, pl) AS layer, TRY_CAST(nullif(regexp_extract(coalesce(layer, pl), '([0-9]+)', 1), '') AS INTEGER) AS layer_num FROM p""")
def node_coordinates(t: Tables) -> DataFrame:
    """Given attributes count first, else the name."""
    p = node_place(F.col("node"))
    layer = F.coalesce("layer", p["layer"])
    return t.grid_nodes.select("node_id", F.coalesce("x", p["x"]).alias("x"), F.coalesce("y", p["y"]).alias("y"), layer.alias("layer"), layer_number(layer).alias("layer_num"))


@query("""SELECT drop_id, TRY_CAST(nullif(regexp_extract(node, '([0-9]+)_([0-9]+)', 1), '') AS BIGINT) AS x, TRY_CAST(nullif(regexp_extract(node, '([0-9]+)_([0-9]+)', 2), '') AS BIGINT) AS y FROM solve_drops""")
def node_coordinates_unanchored(t: Tables) -> DataFrame:
    p = node_place_anywhere(F.col("node"))
    return t.solve_drops.select("drop_id", p["x"].alias("x"), p["y"].alias("y"))


@query("""WITH v AS (SELECT drop_id, run_id, CASE WHEN NOT isnan(voltage) THEN voltage END AS voltage FROM solve_drops)
SELECT drop_id, nominal_voltage - voltage AS ir_drop, abs(nominal_voltage - voltage) AS abs_drop FROM v JOIN solve_runs USING (run_id)""")
def ir_drop_projection(t: Tables) -> DataFrame:
    """The drop of each delivery; a voltage that is NaN is no reading, so its drop is NULL."""
    runs = t.solve_runs.select("run_id", "nominal_voltage")
    d = F.col("nominal_voltage") - F.when(~F.isnan("voltage"), F.col("voltage"))
    return t.solve_drops.select("drop_id", "run_id", "voltage").join(runs, "run_id").select("drop_id", d.alias("ir_drop"), F.abs(d).alias("abs_drop"))


@query(f"""WITH {_ONCE} SELECT design_id, count(*) AS elements, count(*) FILTER (upper(trim(elem_type)) = 'V' OR file_type = 'package') AS exempt FROM once
WHERE lower(trim(net_name)) = 'vdd_core' OR upper(trim(elem_type)) = 'V' OR file_type = 'package' GROUP BY 1""")
def net_filtered_elements(t: Tables) -> DataFrame:
    """Elements of one net in any case; sources and package elements pass any filter."""
    exempt = (F.upper(F.trim("elem_type")) == "V") | (F.col("file_type") == "package")
    kept = _once(t).filter((F.lower(F.trim("net_name")) == "vdd_core") | exempt)
    return kept.groupBy("design_id").agg(F.count(F.lit(1)).alias("elements"), F.count(F.when(exempt, 1)).alias("exempt"))


@query(f"""WITH {_ENDS}, u AS (SELECT a AS node_id FROM ends WHERE upper(trim(elem_type)) = 'R' UNION SELECT b FROM ends WHERE upper(trim(elem_type)) = 'R')
SELECT node_id, design_id FROM grid_nodes WHERE node_id NOT IN (SELECT node_id FROM u WHERE node_id IS NOT NULL)""")
def orphan_nodes(t: Tables) -> DataFrame:
    """Nodes on file that no resistor touches."""
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes, "left")
    used = e.select(F.col("a").alias("node_id")).unionByName(e.select(F.col("b").alias("node_id"))).dropna().distinct()
    return t.grid_nodes.select("node_id", "design_id").join(used, "node_id", "left_anti")


@query(f"WITH {LATTICE} SELECT node, x, y, row_number() OVER (PARTITION BY layer ORDER BY x, y) AS place, layer FROM lattice WHERE x BETWEEN 10000 AND 30000 AND y BETWEEN 5000 AND 25000")
def ports_in_window(t: Tables) -> DataFrame:
    rows = lattice(t).filter(rel.in_window(F.col("x"), F.col("y"), 10000, 30000, 5000, 25000))
    return rows.select("node", "x", "y", F.row_number().over(Window.partitionBy("layer").orderBy("x", "y")).alias("place"), "layer")


@query(f"WITH {LATTICE} SELECT layer, x BETWEEN 15000 AND 35000 AND y BETWEEN 5000 AND 30000 AS near, count(*) AS n, CAST(sum(amps) AS BIGINT) AS amps FROM lattice GROUP BY ALL")
def near_far_sources(t: Tables) -> DataFrame:
    near = rel.in_window(F.col("x"), F.col("y"), 15000, 35000, 5000, 30000)
    return lattice(t).groupBy("layer", near.alias("near")).agg(F.count(F.lit(1)).alias("n"), F.sum("amps").alias("amps"))


@query("SELECT node_id FROM grid_nodes WHERE upper(layer) = 'M3' OR TRY_CAST(nullif(regexp_extract(layer, '([0-9]+)', 1), '') AS INTEGER) = 3")
def nodes_at_layer(t: Tables) -> DataFrame:
    return t.grid_nodes.filter((F.upper("layer") == "M3") | (layer_number(F.col("layer")) == 3)).select("node_id")


@query("""SELECT DISTINCT upper(trim(net_name)) AS net, CASE WHEN regexp_matches(lower(trim(net_name)), 'vss|gnd|ground') THEN 'ground'
  WHEN regexp_matches(lower(trim(net_name)), 'vdd|vcc|vpwr|power') THEN 'power' ELSE 'unknown' END AS kind FROM solve_drops WHERE net_name IS NOT NULL""")
def net_kinds(t: Tables) -> DataFrame:
    nets = t.solve_drops.select(F.upper(F.trim("net_name")).alias("net")).dropna().distinct()
    return nets.withColumn("kind", net_kind(F.col("net")))


# Joins


@query(f"WITH {_ENDS} SELECT elem_id, a, b FROM ends WHERE upper(trim(elem_type)) = 'R' AND a IS NOT NULL AND b IS NOT NULL")
def edge_endpoint_join(t: Tables) -> DataFrame:
    return rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes).select("elem_id", "a", "b")


@query(f"WITH {MESH} SELECT * FROM mesh WHERE CAST(substr(u, 2) AS BIGINT) % 3 = 0 AND CAST(substr(v, 2) AS BIGINT) % 2 = 0")
def induced_subgraph(t: Tables) -> DataFrame:
    s = t.supplier.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    p = t.part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return rel.induced(mesh(t), s.unionByName(p))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def disconnected_loads(t: Tables) -> DataFrame:
    linked = t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_nationkey").join(linked, "c_custkey", "left_anti")


@query("""WITH v AS (SELECT node, max(voltage) AS voltage, run_id FROM solve_drops WHERE NOT isnan(voltage) GROUP BY ALL)
SELECT source_id, coalesce(voltage, nominal_voltage) AS voltage FROM pwl_sources s JOIN solve_runs r USING (run_id) LEFT JOIN v ON v.run_id = s.run_id AND v.node = s.node""")
def voltage_with_default(t: Tables) -> DataFrame:
    """The solved voltage at each source's node, the nominal one where the run has none."""
    v = t.solve_drops.filter("NOT isnan(voltage)").groupBy("run_id", "node").agg(F.max("voltage").alias("voltage"))
    runs = t.solve_runs.select("run_id", "nominal_voltage")
    return t.pwl_sources.select("source_id", "run_id", "node").join(runs, "run_id").join(v, ["run_id", "node"], "left").select("source_id", F.coalesce("voltage", "nominal_voltage").alias("voltage"))


@query("""WITH b AS (SELECT design_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid_nodes GROUP BY 1)
SELECT node_id, CAST(least(floor((y - y0) * 3 / CASE WHEN y1 > y0 THEN y1 - y0 ELSE 1 END), 2) * 4 + least(floor((x - x0) * 4 / CASE WHEN x1 > x0 THEN x1 - x0 ELSE 1 END), 3) AS INTEGER) AS tile_id
FROM grid_nodes JOIN b USING (design_id) WHERE x IS NOT NULL""")
def tile_assignment(t: Tables) -> DataFrame:
    """Every placed node in one of 4 by 3 tiles over its design."""
    places = t.grid_nodes.select("node_id", "design_id", "x", "y").dropna()
    boxed = places.join(rel.bounding_box(places, ["design_id"]), "design_id")
    return boxed.select("node_id", rel.tile_of(F.col("x"), F.col("y"), 4, 3, F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")).alias("tile_id"))


@query(f"""WITH {LATTICE}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lattice),
  tiles AS (SELECT r * 4 + c AS tile_id, x0 + c * (x1 - x0) / 4 AS a, x0 + (c + 1) * (x1 - x0) / 4 AS b, y0 + r * (y1 - y0) / 4 AS c, y0 + (r + 1) * (y1 - y0) / 4 AS d, (x1 - x0) / 4 * 0.3 AS hx, (y1 - y0) / 4 * 0.3 AS hy
            FROM b, (SELECT unnest(range(4)) AS r), (SELECT unnest(range(4)) AS c))
SELECT CAST(tile_id AS INTEGER) AS tile_id, node FROM lattice JOIN tiles ON x BETWEEN a - hx AND b + hx AND y BETWEEN c - hy AND d + hy""")
def tile_halo_members(t: Tables) -> DataFrame:
    places = lattice(t)
    return rel.halo_members(places, rel.bounding_box(places), 4, 4, 0.3)


@query(f"""WITH {LATTICE}, p AS (SELECT node AS target, x AS tx, y AS ty FROM lattice WHERE node % 7 = 0),
  d AS (SELECT node, target, CAST((x - tx) * (x - tx) + (y - ty) * (y - ty) AS BIGINT) AS d2 FROM lattice JOIN p ON abs(x - tx) <= 5000 AND abs(y - ty) <= 5000),
  r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d2, target) AS rank FROM d) SELECT * FROM r WHERE rank <= 3""")
def knn_ports(t: Tables) -> DataFrame:
    places = lattice(t)
    return rel.nearest_in_cells(places, places.filter("node % 7 = 0"), 3, 5000)


@query(f"""WITH {LATTICE}, w AS (SELECT node, x - 1500 AS x0, x + 1500 AS x1, y - 1500 AS y0, y + 1500 AS y1 FROM lattice)
SELECT a.node AS a, b.node AS b FROM w a JOIN w b ON a.node < b.node AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def overlapping_windows(t: Tables) -> DataFrame:
    """Pairs of windows that overlap or touch; windows meet in cells of their own size.

    A window is copied to its own cell and to four of the eight around it, so two cells meet once. The copies are
    joined by a merge: Spark takes their size for that of the rows before them, and would broadcast any number of them.
    """
    w = lattice(t).select("node", "x", "y")
    cell = lambda c, d: F.floor(F.col(c) / 3000) + d
    left = w.select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x", 0).alias("cx"), cell("y", 0).alias("cy"))
    copies = w.select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i")).select("*", F.explode(F.sequence(-F.col("i"), F.lit(1))).alias("j"))
    right = copies.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x", F.col("i")).alias("cx"), cell("y", F.col("j")).alias("cy"), F.expr("i = 0 AND j = 0").alias("own"))
    met = left.join(right.hint("merge"), ["cx", "cy"]).filter("(a < b OR NOT own) AND abs(ax - bx) <= 3000 AND abs(ay - by) <= 3000")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


_WAVE = "w AS (SELECT DISTINCT ON (user_id, (epoch_us(ts) // 1000000)) user_id, (epoch_us(ts) // 1000000) AS s, value FROM events ORDER BY user_id, (epoch_us(ts) // 1000000), event_id)"


def waves(t: Tables) -> DataFrame:
    """user_id, s (whole seconds), value: one value a second, the one of the least event_id."""
    s = F.unix_timestamp("ts")
    first = Window.partitionBy("user_id", "s").orderBy("event_id")
    return t.events.select("user_id", s.alias("s"), "value", "event_id").withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").select("user_id", "s", "value")


@query(f"""WITH {_WAVE}, e AS (SELECT user_id, min(s) AS a, max(s) AS b FROM w GROUP BY 1),
  q AS (SELECT user_id, a - 3600 + unnest(range(12)) * ((b - a + 7200) // 11) AS t FROM e),
  n AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS s2, lead(value) OVER (PARTITION BY user_id ORDER BY s) AS v2 FROM w),
  f AS (SELECT user_id, arg_min(value, s) AS first FROM w GROUP BY 1)
SELECT q.user_id, q.t, round(CASE WHEN n.s IS NULL THEN first WHEN n.s2 IS NULL THEN n.value ELSE n.value + (n.v2 - n.value) * (q.t - n.s) / (n.s2 - n.s) END, 6) AS value
FROM q JOIN f USING (user_id) ASOF LEFT JOIN n ON n.user_id = q.user_id AND q.t >= n.s""")
def pwl_at_times(t: Tables) -> DataFrame:
    """Each user's values as a wave, read at twelve times: an as-of join by a union and a window, not by a search in all pairs."""
    w = waves(t)
    e = w.groupBy("user_id").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.min_by("value", "s").alias("first"))
    steps = e.select("user_id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    q = steps.select("user_id", (F.col("a") - 3600 + F.col("k") * F.expr("(b - a + 7200) div 11")).alias("t"))
    return tr.as_of(w, q, "user_id", "s", "value", "t").withColumn("value", F.round("value", 6))


@query("""WITH c AS (SELECT DISTINCT x FROM grid_nodes WHERE x IS NOT NULL AND layer = 'M5'),
  t AS (SELECT p_partkey, p_partkey * 61 % 120000 AS x FROM part), lo AS (SELECT t.p_partkey, t.x, c.x AS below FROM t ASOF LEFT JOIN c ON t.x >= c.x), hi AS (SELECT t.p_partkey, c.x AS above FROM t ASOF LEFT JOIN c ON t.x <= c.x)
SELECT p_partkey, CASE WHEN below IS NULL THEN above WHEN above IS NULL THEN below WHEN x - below <= above - x THEN below ELSE above END AS nearest FROM lo JOIN hi USING (p_partkey)""")
def nearest_column(t: Tables) -> DataFrame:
    """For each target the nearest coordinate in use on a layer, ties to the lower one."""
    c = t.grid_nodes.filter("x IS NOT NULL AND layer = 'M5'").select("x").distinct()
    return tr.nearest_value(c, t.part.select("p_partkey", (F.col("p_partkey") * 61 % 120000).cast("double").alias("x")), "p_partkey", "x")


@query("SELECT source_id, s.node, n.node_id, r.design_id FROM pwl_sources s JOIN solve_runs r USING (run_id) LEFT JOIN grid_nodes n ON n.design_id = r.design_id AND n.node = s.node")
def resolve_instances(t: Tables) -> DataFrame:
    runs = t.solve_runs.select("run_id", "design_id")
    nodes = t.grid_nodes.select("design_id", "node", "node_id")
    return t.pwl_sources.select("source_id", "node", "run_id").join(runs, "run_id").join(nodes, ["design_id", "node"], "left").select("source_id", "node", "node_id", "design_id")


@query(f"WITH {SOLVED} SELECT node, parent, i AS current, r * i AS voltage FROM solved")
def edge_currents(t: Tables) -> DataFrame:
    return tr.solve_tree(tree(t)).select("node", "parent", F.col("i").alias("current"), (F.col("r") * F.col("i")).alias("voltage"))


@query(f"""WITH {_ENDS}, e AS (SELECT elem_id, coalesce(p.is_pad, false) AS pa, coalesce(q.is_pad, false) AS pb FROM ends JOIN grid_nodes p ON p.node_id = a JOIN grid_nodes q ON q.node_id = b WHERE upper(trim(elem_type)) = 'R')
SELECT elem_id FROM e WHERE pa <> pb""")
def pad_edges(t: Tables) -> DataFrame:
    """Resistors with exactly one end at a pad."""
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes).select("elem_id", "a", "b")
    pads = t.grid_nodes.filter("is_pad").select(F.col("node_id").alias("node"))
    return rel.boundary_edges(e, pads, "a", "b").select("elem_id")


@query("""WITH n AS (SELECT node_id, design_id, node, CAST(row_number() OVER (PARTITION BY design_id ORDER BY node) - 1 AS INTEGER) AS k FROM grid_nodes)
SELECT source_id, coalesce(k, -1) AS unknown FROM pwl_sources s JOIN solve_runs r USING (run_id) LEFT JOIN n ON n.design_id = r.design_id AND n.node = s.node""")
def source_index_map(t: Tables) -> DataFrame:
    """The place of each source's node among the unknowns of its design, -1 if it is none."""
    n = running(t.grid_nodes.select("design_id", "node"), ["design_id"], [F.asc("node")]).select("design_id", "node", (F.col("rank") - 1).cast("int").alias("k"))
    runs = t.solve_runs.select("run_id", "design_id")
    return t.pwl_sources.select("source_id", "node", "run_id").join(runs, "run_id").join(n, ["design_id", "node"], "left").select("source_id", F.coalesce("k", F.lit(-1)).alias("unknown"))


# Aggregations


@query(f"""WITH {_ENDS} SELECT e.design_id, coalesce(upper(n.layer), 'none') AS layer, upper(trim(elem_type)) AS kind, count(*) AS n, round(sum(elem_value), 6) AS total
FROM ends e JOIN grid_nodes n ON n.node_id = coalesce(a, b) GROUP BY ALL""")
def layer_statistics(t: Tables) -> DataFrame:
    """Counts and sums by kind and layer of the first end on file, for all kinds of elements."""
    e = rel.with_ends(_once(t), t.grid_nodes, "left").select("design_id", F.upper(F.trim("elem_type")).alias("kind"), "elem_value", F.coalesce("a", "b").alias("node_id")).dropna(subset=["node_id"])
    layers = t.grid_nodes.select("node_id", F.coalesce(F.upper("layer"), F.lit("none")).alias("layer"))
    return e.join(layers, "node_id").groupBy("design_id", "layer", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("elem_value"), 6).alias("total"))


@query(f"""WITH {_ONCE} SELECT coalesce(upper(trim(net_name)), 'none') AS net, count(*) AS elements, count(elem_value) AS with_value FROM once WHERE file_type = 'package' GROUP BY 1""")
def package_statistics(t: Tables) -> DataFrame:
    rows = _once(t).filter("file_type = 'package'")
    return rows.groupBy(F.coalesce(F.upper(F.trim("net_name")), F.lit("none")).alias("net")).agg(F.count(F.lit(1)).alias("elements"), F.count("elem_value").alias("with_value"))


@query(f"""WITH {_ONCE}, x AS (SELECT coalesce(upper(trim(net_name)), 'none') AS net, upper(trim(elem_type)) AS kind, CASE WHEN upper(trim(elem_type)) = 'I' THEN abs(elem_value) ELSE elem_value END AS amount FROM once WHERE file_type = 'package')
SELECT net, kind, count(*) AS n, round(sum(amount), 6) AS total FROM x GROUP BY ALL""")
def package_totals(t: Tables) -> DataFrame:
    """Package elements of each net by type: how many, and their summed values (current sources by amount)."""
    kind = F.upper(F.trim("elem_type"))
    rows = _once(t).filter("file_type = 'package'").select(F.coalesce(F.upper(F.trim("net_name")), F.lit("none")).alias("net"), kind.alias("kind"), F.when(kind == "I", F.abs("elem_value")).otherwise(F.col("elem_value")).alias("amount"))
    return rows.groupBy("net", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 6).alias("total"))


@query(f"""WITH {_ENDS}, x AS (SELECT e.design_id, upper(p.layer) AS p, upper(q.layer) AS q FROM ends e JOIN grid_nodes p ON p.node_id = a JOIN grid_nodes q ON q.node_id = b WHERE upper(trim(elem_type)) = 'R' AND p.layer IS NOT NULL AND q.layer IS NOT NULL)
SELECT design_id, CASE WHEN p = q THEN p WHEN CAST(substr(p, 2) AS INTEGER) > CAST(substr(q, 2) AS INTEGER) THEN q || '-' || p ELSE p || '-' || q END AS layers, count(*) AS n FROM x GROUP BY ALL""")
def net_layer_counts(t: Tables) -> DataFrame:
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes).select("design_id", "a", "b")
    layer = lambda end, name: t.grid_nodes.filter("layer IS NOT NULL").select(F.col("node_id").alias(end), F.upper("layer").alias(name))
    both = e.join(layer("a", "p"), "a").join(layer("b", "q"), "b")
    return both.groupBy("design_id", ag.layer_pair(F.col("p"), F.col("q")).alias("layers")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ONCE}, x AS (SELECT upper(trim(elem_type)) AS kind, file_type, elem_value FROM once)
SELECT kind, file_type, grouping(kind) * 2 + grouping(file_type) AS level, count(*) AS n FROM x GROUP BY CUBE (kind, file_type)""")
def net_totals_cube(t: Tables) -> DataFrame:
    rows = _once(t).select(F.upper(F.trim("elem_type")).alias("kind"), "file_type")
    return rows.cube("kind", "file_type").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n")).select("kind", "file_type", F.col("level").cast("bigint").alias("level"), "n")


@query(f"WITH {SOLVED} SELECT level, count(*) AS n, CAST(min(drop) AS BIGINT) AS min_drop, CAST(max(drop) AS BIGINT) AS max_drop, round(avg(drop), 9) AS avg_drop FROM solved GROUP BY 1")
def solution_summary(t: Tables) -> DataFrame:
    return ag.drop_summary(tr.solve_tree(tree(t)), ["level"])


_PULSE = "p AS (SELECT p_partkey AS k, 1.0::DOUBLE AS v1, 1.0::DOUBLE + p_size AS v2, (p_partkey % 5)::DOUBLE AS delay, (1 + p_partkey % 3)::DOUBLE AS rise, (1 + p_partkey % 4)::DOUBLE AS fall, (2 + p_size % 6)::DOUBLE AS width, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 20 + p_size % 10 END::DOUBLE AS period FROM part)"
_PULSE_AT = """(CASE WHEN s < 0 THEN v1 WHEN s < rise THEN v1 + (v2 - v1) * s / rise WHEN s < rise + width THEN v2 WHEN s < rise + width + fall THEN v2 + (v1 - v2) * (s - rise - width) / fall ELSE v1 END)"""
_PHASE = "phase AS (SELECT *, CASE WHEN s0 < 0 AND period > 0 THEN s0 + period ELSE s0 END AS s FROM (SELECT *, CASE WHEN period > 0 THEN t - floor(t / period) * period ELSE t END - delay AS s0 FROM times))"


def pulses(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.alias("k"), F.lit(1.0).alias("v1"), (1.0 + size).alias("v2"), (k % 5).cast("double").alias("delay"), (1 + k % 3).cast("double").alias("rise"), (1 + k % 4).cast("double").alias("fall"),
        (2 + size % 6).cast("double").alias("width"), F.when(k % 4 == 0, 0).otherwise(20 + size % 10).cast("double").alias("period"),
    )


def _pulse_now(t) -> F.Column:
    return pulse_at(t, *[F.col(c) for c in ("v1", "v2", "delay", "rise", "fall", "width", "period")])


@query(f"WITH {_PULSE}, times AS (SELECT *, (unnest(range(8)) * 6.5)::DOUBLE AS t FROM p), {_PHASE} SELECT k, t, round({_PULSE_AT}, 9) AS value FROM phase")
def pulse_at_times(t: Tables) -> DataFrame:
    rows = pulses(t).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("n")).withColumn("t", F.col("n") * 6.5)
    return rows.select("k", "t", F.round(_pulse_now(F.col("t")), 9).alias("value"))


@query(f"WITH {_PULSE}, times AS (SELECT *, (unnest(range(10)) * 5)::DOUBLE AS t FROM p), {_PHASE} SELECT k % 100 AS node, t, round(sum({_PULSE_AT}), 6) AS amps FROM phase GROUP BY ALL")
def current_at_time(t: Tables) -> DataFrame:
    """Current of each node at ten times: the sum of its sources' pulses."""
    rows = pulses(t).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n")).withColumn("t", (F.col("n") * 5).cast("double"))
    return rows.groupBy((F.col("k") % 100).alias("node"), "t").agg(F.round(F.sum(_pulse_now(F.col("t"))), 6).alias("amps"))


@query(f"""WITH {_PULSE}, times AS (SELECT *, (unnest(range(5)) * 7)::DOUBLE AS t FROM p), {_PHASE}, m AS (SELECT t, k, {_PULSE_AT} AS i FROM phase)
SELECT t, round(sum(i), 6) AS total, round(sum(CASE WHEN k % 50 BETWEEN 10 AND 30 THEN i ELSE 0 END), 6) AS near, round(sum(CASE WHEN k % 50 BETWEEN 10 AND 30 THEN 0 ELSE i END), 6) AS far FROM m GROUP BY t""")
def masked_current(t: Tables) -> DataFrame:
    """All, near and far current over time in one pass."""
    near = (F.col("k") % 50).between(10, 30)
    rows = pulses(t).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n")).withColumn("t", (F.col("n") * 7).cast("double")).withColumn("i", _pulse_now(F.col("t")))
    part = lambda c: F.round(F.sum(F.when(c, F.col("i")).otherwise(0)), 6)
    return rows.groupBy("t").agg(F.round(F.sum("i"), 6).alias("total"), part(near).alias("near"), part(~near).alias("far"))


@query(f"""WITH {MESH}, d AS (SELECT u AS load, v AS port, (1000 - g)::DOUBLE AS r, 12.0::DOUBLE AS amps FROM mesh), n AS (SELECT *, row_number() OVER (PARTITION BY load ORDER BY r, port) AS k FROM d WHERE r > 0),
  f AS (SELECT *, 1 / r / sum(1 / r) OVER (PARTITION BY load) AS w FROM n WHERE k <= 5) SELECT port, count(*) AS loads, round(sum(amps * w), 9) AS amps FROM f GROUP BY port""")
def port_current_shares(t: Tables) -> DataFrame:
    """Loads split over their five nearest ports; the ports' totals keep the sum."""
    d = mesh(t).select(F.col("u").alias("load"), F.col("v").alias("port"), (1000 - F.col("g")).cast("double").alias("r"), F.lit(12.0).alias("amps"))
    return ag.nearest_shares(d, 5).groupBy("port").agg(F.count(F.lit(1)).alias("loads"), F.round(F.sum("share"), 9).alias("amps"))


@query(f"WITH {SOLVED} SELECT parent AS pad, CAST(sum(i) AS BIGINT) AS current FROM solved WHERE level = 1 GROUP BY 1")
def pad_current(t: Tables) -> DataFrame:
    return tr.solve_tree(tree(t)).filter("level = 1").groupBy(F.col("parent").alias("pad")).agg(F.sum("i").alias("current"))


@query(f"WITH {LATTICE} SELECT layer, CAST(floor(x / 7000) AS BIGINT) AS bx, CAST(floor(y / 9000) AS BIGINT) AS by, CAST(max(drop) AS BIGINT) AS worst FROM lattice GROUP BY ALL")
def worst_drop_bins(t: Tables) -> DataFrame:
    return ag.bins(lattice(t), 7000, 9000, F.max("drop"), "worst", ["layer"])


@query(f"WITH {LATTICE} SELECT CAST(floor(x / 5000) AS BIGINT) AS bx, CAST(floor(y / 5000) AS BIGINT) AS by, CAST(nullif(sum(CASE WHEN node % 3 = 0 THEN amps ELSE 0 END), 0) AS BIGINT) AS amps FROM lattice GROUP BY ALL")
def current_bins(t: Tables) -> DataFrame:
    own = F.nullif(F.sum(F.when(F.col("node") % 3 == 0, F.col("amps")).otherwise(0)), F.lit(0))
    return ag.bins(lattice(t), 5000, 5000, own, "amps")


@query("""SELECT design_id, upper(layer) AS layer, y AS stripe, CAST(floor(x / 9000) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (is_pad) AS pads FROM grid_nodes WHERE x IS NOT NULL AND layer IS NOT NULL GROUP BY ALL""")
def stripe_bins(t: Tables) -> DataFrame:
    rows = t.grid_nodes.filter("x IS NOT NULL AND layer IS NOT NULL")
    return rows.groupBy("design_id", F.upper("layer").alias("layer"), F.col("y").alias("stripe"), F.floor(F.col("x") / 9000).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_pad"), 1)).alias("pads"))


@query(f"""WITH {SOLVED}, d AS (SELECT abs(drop - (drop + CAST(substr(node, 2) AS BIGINT) % 3)) AS d, CASE WHEN CAST(substr(node, 2) AS BIGINT) % 11 = 0 THEN 1 ELSE 0 END AS gone FROM solved)
SELECT count(*) FILTER (gone = 0) AS n, CAST(sum(gone) AS BIGINT) AS missing, CAST(max(d) FILTER (gone = 0) AS BIGINT) AS max_diff, round(avg(d) FILTER (gone = 0), 9) AS mean_diff, round(sqrt(avg(d * d) FILTER (gone = 0)), 9) AS rmse FROM d""")
def solution_diff_stats(t: Tables) -> DataFrame:
    a = tr.solve_tree(tree(t)).select("node", "drop")
    key = F.substring("node", 2, 20).cast("bigint")
    b = a.filter(key % 11 != 0).select("node", (F.col("drop") + key % 3).alias("drop"))
    return ag.difference(a, b, "node", "drop")


@query(f"WITH {_PULSE} SELECT k, round(CASE WHEN period > 0 THEN ((rise + fall) * (v1 + v2) / 2 + width * v2 + greatest(0, period - rise - fall - width) * v1) / period ELSE 0 END, 9) AS average FROM p")
def waveform_average(t: Tables) -> DataFrame:
    return pulses(t).select("k", F.round(pulse_average(*[F.col(c) for c in ("v1", "v2", "rise", "fall", "width", "period")]), 9).alias("average"))


@query(f"""WITH {_ENDS}, s AS (SELECT upper(p.layer) AS layer, abs(q.x - p.x) AS dx, abs(q.y - p.y) AS dy FROM ends JOIN grid_nodes p ON p.node_id = a JOIN grid_nodes q ON q.node_id = b
  WHERE upper(trim(elem_type)) = 'R' AND upper(p.layer) = upper(q.layer) AND p.x IS NOT NULL AND q.x IS NOT NULL),
  c AS (SELECT layer, count(*) AS n, CAST(sum(CASE WHEN dy < 0.27::DOUBLE * dx THEN 1 ELSE 0 END) AS BIGINT) AS flat, CAST(sum(CASE WHEN dy > 3.73::DOUBLE * dx THEN 1 ELSE 0 END) AS BIGINT) AS steep FROM s GROUP BY 1)
SELECT *, CASE WHEN flat >= 0.7::DOUBLE * n THEN 'H' WHEN steep >= 0.7::DOUBLE * n THEN 'V' ELSE 'mixed' END AS orientation FROM c""")
def layer_orientation(t: Tables) -> DataFrame:
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes).select("a", "b")
    place = lambda end, k: t.grid_nodes.filter("x IS NOT NULL AND layer IS NOT NULL").select(F.col("node_id").alias(end), F.upper("layer").alias(f"l{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    segments = e.join(place("a", 1), "a").join(place("b", 2), "b").filter("l1 = l2").withColumnRenamed("l1", "layer")
    return ag.orientation(segments, "layer")


@query("""WITH x AS (SELECT user_id, (epoch_us(ts) // 1000000) AS s, value, event_type = 'click' AS near FROM events), t AS (SELECT user_id, s, sum(value) AS total, sum(CASE WHEN near THEN value ELSE 0 END) AS near FROM x GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(total, 6) DESC, s) AS k FROM t)
SELECT user_id, round(max(total), 6) AS peak, round(avg(total), 6) AS mean, max(CASE WHEN k = 1 THEN s END) AS peak_at,
  round(max(CASE WHEN k = 1 AND total > 0 THEN near / total WHEN k = 1 THEN 0 END), 6) AS near_at_peak FROM r GROUP BY user_id""")
def decomposition_stats(t: Tables) -> DataFrame:
    """Peak, mean, time of the peak and the near share there, for each user."""
    x = t.events.groupBy("user_id", F.unix_timestamp("ts").alias("s")).agg(F.sum("value").alias("total"), F.sum(F.when(F.col("event_type") == "click", F.col("value")).otherwise(0)).alias("near"))
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round("total", 6)), "s")
    r = x.withColumn("k", F.row_number().over(w))
    top = F.col("k") == 1
    share = F.when(top & (F.col("total") > 0), F.col("near") / F.col("total")).when(top, F.lit(0.0))
    return r.groupBy("user_id").agg(F.round(F.max("total"), 6).alias("peak"), F.round(F.avg("total"), 6).alias("mean"), F.max(F.when(top, F.col("s"))).alias("peak_at"), F.round(F.max(share), 6).alias("near_at_peak"))


# Rankings


@query("""WITH x AS (SELECT user_id, (epoch_us(ts) // 1000000) AS s, value FROM events) SELECT user_id, max(value) AS peak, arg_max(-s, (value, -s)) * -1 AS first_at FROM x GROUP BY 1""")
def peak_per_node(t: Tables) -> DataFrame:
    return ag.peak(t.events.select("user_id", F.unix_timestamp("ts").alias("s"), "value"), "user_id", "value", "s")


@query("""WITH s AS (SELECT DISTINCT design_id, y FROM grid_nodes WHERE y IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY y) - 1 AS k, count(*) OVER (PARTITION BY design_id) AS n FROM s)
SELECT design_id, CAST(k // ((n + 7) // 8) AS BIGINT) AS stripe_group, count(*) AS stripes, min(y) AS y0, max(y) AS y1 FROM r GROUP BY ALL""")
def consolidated_stripes(t: Tables) -> DataFrame:
    """Consecutive stripes of a design merged into eight groups at most."""
    s = t.grid_nodes.filter("y IS NOT NULL").select("design_id", "y").distinct()
    r = running(s, ["design_id"], [F.asc("y")]).withColumn("k", F.col("rank") - 1).withColumnRenamed("group_rows", "n")
    return r.groupBy("design_id", F.expr("k div ((n + 7) div 8)").cast("bigint").alias("stripe_group")).agg(F.count(F.lit(1)).alias("stripes"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query(f"""WITH {LATTICE}, b AS (SELECT layer, max(x) - min(x) AS w, max(y) - min(y) AS h, count(*) AS n FROM lattice GROUP BY 1)
SELECT layer, CAST(least(100, ceil(sqrt(n))) AS BIGINT) AS bins, w / least(100, ceil(sqrt(n))) AS size_x, h / least(100, ceil(sqrt(n))) AS size_y FROM b""")
def bin_sizes(t: Tables) -> DataFrame:
    b = lattice(t).groupBy("layer").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.count(F.lit(1)).alias("n"))
    bins = F.least(F.lit(100), F.ceil(F.sqrt("n")))
    return b.select("layer", bins.cast("bigint").alias("bins"), (F.col("w") / bins).alias("size_x"), (F.col("h") / bins).alias("size_y"))


@query("""WITH l AS (SELECT DISTINCT design_id, upper(layer) AS layer FROM grid_nodes WHERE layer IS NOT NULL)
SELECT design_id, layer, row_number() OVER (PARTITION BY design_id ORDER BY TRY_CAST(regexp_extract(layer, '([0-9]+)', 1) AS INTEGER) NULLS LAST, layer) AS place FROM l""")
def layers_sorted(t: Tables) -> DataFrame:
    l = t.grid_nodes.filter("layer IS NOT NULL").select("design_id", F.upper("layer").alias("layer")).distinct()
    return l.withColumn("place", F.row_number().over(Window.partitionBy("design_id").orderBy(F.asc_nulls_last(layer_number(F.col("layer"))), "layer")))


@query(f"""WITH {LATTICE}, o AS (SELECT node, x, row_number() OVER (ORDER BY x, node) - 1 AS k, count(*) OVER () AS n FROM lattice)
SELECT node, x, CAST(CASE WHEN k < (n % 6) * (n // 6 + 1) THEN k // (n // 6 + 1) ELSE n % 6 + (k - (n % 6) * (n // 6 + 1)) // (n // 6) END AS INTEGER) AS slab FROM o""")
def balanced_slabs(t: Tables) -> DataFrame:
    return ag.balanced_slabs(lattice(t).select("node", "x"), "node", "x", 6)


@query("""WITH l AS (SELECT design_id, upper(layer) AS layer, count(*) FILTER (is_pad) AS pads, count(*) AS nodes FROM grid_nodes WHERE layer IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY CAST(substr(layer, 2) AS INTEGER) DESC) AS k FROM l WHERE nodes >= 10) SELECT design_id, layer, pads, nodes FROM r WHERE k BETWEEN 2 AND 4""")
def layer_suggestions(t: Tables) -> DataFrame:
    """The three layers below the top one that hold enough nodes for ports."""
    l = t.grid_nodes.filter("layer IS NOT NULL").groupBy("design_id", F.upper("layer").alias("layer")).agg(F.count(F.when(F.col("is_pad"), 1)).alias("pads"), F.count(F.lit(1)).alias("nodes")).filter("nodes >= 10")
    w = Window.partitionBy("design_id").orderBy(F.desc(layer_number(F.col("layer"))))
    return l.withColumn("k", F.row_number().over(w)).filter("k BETWEEN 2 AND 4").drop("k")


@query("""WITH s AS (SELECT p_brand, p_partkey, CAST(round(p_retailprice) AS BIGINT) AS v FROM part), r AS (SELECT *, row_number() OVER w AS k, sum(v * v) OVER (PARTITION BY p_brand ORDER BY v DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS run, sum(v * v) OVER (PARTITION BY p_brand) AS al FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY v DESC, p_partkey))
SELECT p_brand, min(k) FILTER (run >= 0.9 * al) AS rank_90, min(k) FILTER (run >= 0.95 * al) AS rank_95, min(k) FILTER (run >= 0.99 * al) AS rank_99 FROM r GROUP BY 1""")
def cumulative_energy_rank(t: Tables) -> DataFrame:
    s = t.part.select("p_brand", "p_partkey", F.round("p_retailprice").cast("bigint").alias("v"))
    return ag.energy_ranks(s, "p_brand", "p_partkey", "v", [0.9, 0.95, 0.99])


# Sets


@query(f"""WITH {_ENDS}, u AS (SELECT a AS id FROM ends WHERE upper(trim(elem_type)) = 'R' AND b IS NOT NULL UNION SELECT b FROM ends WHERE upper(trim(elem_type)) = 'R' AND a IS NOT NULL)
SELECT design_id, count(*) AS nodes, count(u.id) AS linked, count(*) - count(u.id) AS removed FROM grid_nodes n LEFT JOIN u ON u.id = n.node_id GROUP BY 1""")
def valid_and_floating_nodes(t: Tables) -> DataFrame:
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes).select("a", "b")
    used = e.select(F.col("a").alias("node_id")).union(e.select("b")).distinct().withColumn("one", F.lit(1))
    n = t.grid_nodes.select("node_id", "design_id").join(used, "node_id", "left")
    return n.groupBy("design_id").agg(F.count(F.lit(1)).alias("nodes"), F.count("one").alias("linked"), (F.count(F.lit(1)) - F.count("one")).alias("removed"))


@query(f"""WITH {_ENDS}, x AS (SELECT a, b, CAST(nullif(regexp_extract(p.layer, '([0-9]+)', 1), '') AS INTEGER) AS p, CAST(nullif(regexp_extract(q.layer, '([0-9]+)', 1), '') AS INTEGER) AS q
  FROM ends JOIN grid_nodes p ON p.node_id = a JOIN grid_nodes q ON q.node_id = b WHERE upper(trim(elem_type)) = 'R')
SELECT DISTINCT CASE WHEN p >= 3 THEN a ELSE b END AS port FROM x WHERE (p >= 3) <> (q >= 3)""")
def layer_split_ports(t: Tables) -> DataFrame:
    """Ports of the split at layer 3: the upper ends of the resistors that cross it, over any number of layers."""
    e = rel.with_ends(rel.of_type(_once(t), "R"), t.grid_nodes).select("a", "b")
    layer = lambda end, name: t.grid_nodes.select(F.col("node_id").alias(end), layer_number(F.col("layer")).alias(name))
    x = e.join(layer("a", "p"), "a").join(layer("b", "q"), "b").filter("(p >= 3) <> (q >= 3)")
    return x.select(F.when(F.col("p") >= 3, F.col("a")).otherwise(F.col("b")).alias("port")).distinct()


@query("""WITH s AS (SELECT design_id, CASE WHEN TRY_CAST(regexp_extract(layer, '([0-9]+)', 1) AS INTEGER) >= 3 THEN 'top' ELSE 'bottom' END AS side FROM grid_nodes WHERE layer IS NOT NULL),
  c AS (SELECT design_id, count(*) FILTER (side = 'top') AS top, count(*) FILTER (side = 'bottom') AS bottom FROM s GROUP BY 1)
SELECT *, round(greatest(top, bottom)::DOUBLE / least(top, bottom), 9) AS ratio FROM c WHERE least(top, bottom) > 0""")
def layer_partition_balance(t: Tables) -> DataFrame:
    top = layer_number(F.col("layer")) >= 3
    c = t.grid_nodes.filter("layer IS NOT NULL").groupBy("design_id").agg(F.count(F.when(top, 1)).alias("top"), F.count(F.when(~F.coalesce(top, F.lit(False)), 1)).alias("bottom"))
    return c.filter("least(top, bottom) > 0").withColumn("ratio", F.round(F.greatest("top", "bottom").cast("double") / F.least("top", "bottom"), 9))


@query(f"""WITH {LATTICE}, b AS (SELECT max(x) AS mx, max(y) AS my FROM lattice), m AS (SELECT node, CAST(least(floor(y * 3 / my), 2) * 4 + least(floor(x * 4 / mx), 3) AS INTEGER) AS tile, drop FROM lattice, b)
SELECT l.node, coalesce(m.tile, -1) AS tile, CASE WHEN m.node IS NULL THEN 0 ELSE m.drop END AS drop FROM lattice l LEFT JOIN (SELECT * FROM m WHERE node % 5 <> 0) m ON m.node = l.node""")
def merged_tile_solution(t: Tables) -> DataFrame:
    """The tiles' core results put together; a node in none of them has no drop; a node in two raises."""
    places = lattice(t)
    box = rel.bounding_box(places)
    b = {c: box.select(c).scalar() for c in ("x0", "x1", "y0", "y1")}
    tile = rel.tile_of(F.col("x"), F.col("y"), 4, 3, b["x0"], b["x1"], b["y0"], b["y1"])
    cores = places.filter("node % 5 <> 0").groupBy("node").agg(F.max(tile).alias("tile"), F.max("drop").alias("drop"), F.count(F.lit(1)).alias("_n"))
    cores = cores.withColumn("tile", F.when(F.col("_n") > 1, F.raise_error("a node in two tiles")).otherwise(F.col("tile")))
    return places.select("node").join(cores, "node", "left").select("node", F.coalesce("tile", F.lit(-1)).alias("tile"), F.coalesce("drop", F.lit(0)).alias("drop"))


@query(f"""WITH {LATTICE}, d AS (SELECT node, sqrt(power(greatest(15000.0 - x, x - 25000.0, 0), 2) + power(greatest(10000.0 - y, y - 20000.0, 0), 2)) AS d FROM lattice)
SELECT node, CAST(CASE WHEN d = 0 THEN 0 ELSE least(floor(d / 4000) + 1, 4) END AS INTEGER) AS ring FROM d""")
def distance_rings(t: Tables) -> DataFrame:
    return lattice(t).select("node", rel.ring(F.col("x"), F.col("y"), 15000.0, 25000.0, 10000.0, 20000.0, 4000.0, 4).alias("ring"))


# Functions over tables


@query(f"WITH {LATTICE} SELECT node, greatest(0, x - 2000) AS x0, least(49000, x + 2000) AS x1, greatest(0, y - 2000) AS y0, y + 2000 AS y1 FROM lattice")
def instance_windows(t: Tables) -> DataFrame:
    half = 2000
    return lattice(t).select("node", F.greatest(F.lit(0), F.col("x") - half).alias("x0"), F.least(F.lit(49000), F.col("x") + half).alias("x1"), F.greatest(F.lit(0), F.col("y") - half).alias("y0"), (F.col("y") + half).alias("y1"))


@query(f"""WITH {_ONCE}, v AS (SELECT design_id, max(elem_value) AS v FROM once WHERE upper(trim(elem_type)) = 'V' AND elem_value IS NOT NULL GROUP BY 1),
  r AS (SELECT design_id, max(nominal_voltage) AS p FROM solve_runs GROUP BY 1) SELECT design_id, coalesce(v, p, 1.0::DOUBLE) AS nominal FROM (SELECT DISTINCT design_id FROM grid_nodes) LEFT JOIN v USING (design_id) LEFT JOIN r USING (design_id)""")
def nominal_voltage(t: Tables) -> DataFrame:
    """The greatest source of a design, else the runs' parameter, else 1."""
    v = rel.of_type(_once(t), "V").groupBy("design_id").agg(F.max("elem_value").alias("v"))
    p = t.solve_runs.groupBy("design_id").agg(F.max("nominal_voltage").alias("p"))
    return t.grid_nodes.select("design_id").distinct().join(v, "design_id", "left").join(p, "design_id", "left").select("design_id", F.coalesce("v", "p", F.lit(1.0)).alias("nominal"))


@query("""WITH x AS (SELECT design_id, unnest(string_split((1 + design_id % 4) || 'x' || (2 + design_id % 3) || ',2x2', ',')) AS s FROM (SELECT DISTINCT design_id FROM grid_nodes))
SELECT design_id, CAST(string_split(s, 'x')[1] AS INTEGER) AS nx, CAST(string_split(s, 'x')[2] AS INTEGER) AS ny FROM x""")
def parse_tilings(t: Tables) -> DataFrame:
    """Lists like ``4x3,2x2`` as rows."""
    d = F.col("design_id")
    text = F.concat(1 + d % 4, F.lit("x"), 2 + d % 3, F.lit(",2x2"))
    rows = t.grid_nodes.select("design_id").distinct().select("design_id", F.explode(F.split(text, ",")).alias("s"))
    return rows.select("design_id", F.split("s", "x")[0].cast("int").alias("nx"), F.split("s", "x")[1].cast("int").alias("ny"))


#: Points of a packed array.
PACKED = 1024


@query(f"WITH {_WAVE} SELECT user_id, count(*) AS points, min(s) AS first_s, max(s) AS last_s, round(sum(value), 6) AS total FROM w GROUP BY 1")
def flatten_waveforms(t: Tables) -> DataFrame:
    """Waves packed as arrays of at most PACKED points, numbered within their wave, and their counts read back; so a wave of any length is no single row."""
    piece = F.floor((F.col("rank") - 1) / PACKED).alias("piece")
    ordered = running(waves(t), ["user_id"], [F.asc("s"), F.asc("value")])
    packed = ordered.groupBy("user_id", piece).agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("t"), F.col("value").alias("v")))).alias("w"))
    flat = packed.select("user_id", F.posexplode("w").alias("k", "p"))
    return flat.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.min("p.t").alias("first_s"), F.max("p.t").alias("last_s"), F.round(F.sum("p.v"), 6).alias("total"))


@query(f"""WITH {_PULSE}, times AS (SELECT *, (unnest(range(6)) * 4)::DOUBLE AS t FROM p), {_PHASE}
SELECT k, t, round(0.5::DOUBLE + {_PULSE_AT} + CASE WHEN t <= 2 THEN 1.0 WHEN t >= 12 THEN 3.0 ELSE 1.0 + (t - 2) / 5 END, 9) AS amps FROM phase""")
def source_current_at_times(t: Tables) -> DataFrame:
    """dc, a pulse and a wave added up at six times."""
    rows = pulses(t).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")).withColumn("t", (F.col("n") * 4).cast("double"))
    point = lambda a, b: F.struct(F.lit(a).alias("t"), F.lit(b).alias("v"))
    wave = pwl_at(F.col("t"), F.array(point(2.0, 1.0), point(7.0, 2.0), point(12.0, 3.0)))
    return rows.select("k", "t", F.round(F.lit(0.5) + _pulse_now(F.col("t")) + wave, 9).alias("amps"))


@query("""WITH x AS (SELECT source_id, CAST(floor(seq / 64) AS BIGINT) AS piece, count(*) AS n FROM pwl_sources JOIN pwl_points USING (source_id) WHERE seq IS NOT NULL GROUP BY ALL) SELECT source_id, piece, n, round(CASE WHEN n = 1 THEN 1.0 ELSE (0.5 * (n - 1) * (n - 1) + (n + 1 - n) * (n - 1) / 2) / n END, 9) AS average FROM x""")
def pwl_averages(t: Tables) -> DataFrame:
    """A ramp with a point for each delivery of a piece of 64 points of a source, averaged over a period of as many seconds as deliveries.

    Pieces bound the arrays, however many points a source has.
    """
    piece = F.floor(F.col("seq") / 64).alias("piece")
    n = t.pwl_points.filter("seq IS NOT NULL").groupBy("source_id", piece).agg(F.count(F.lit(1)).alias("n")).join(t.pwl_sources.select("source_id"), "source_id")
    ramp = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n")), lambda i: F.struct((i - 1).cast("double").alias("t"), F.when(F.col("n") == 1, 1.0).otherwise((i - 1).cast("double")).alias("v")))
    return n.select("source_id", "piece", "n", F.round(pwl_average(ramp, F.col("n").cast("double")), 9).alias("average"))
