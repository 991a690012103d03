"""Linear systems, solvers, time stepping, partitions, analyses and plot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import aggregates as ag, linear as la, relational as rel, solvers as so, tree as tr
from ..functions.elements import conductance
from ..operators.model import network_drop
from ..operators.running import running
from ..sources.sinks import as_json, as_nested_json, worst_report
from ..streaming import monitor
from .q_relational import PACKED
from .registry import Tables, query
from .views import LATTICE, MESH, SOLVED, TREE, lattice, mesh, thin, tree


def solved_by(stim: str, amps: str) -> str:
    """SQL of the tree solved for several stimuli: ``stim`` lists them, ``amps`` is an order's load for stimulus s."""
    return f"""st AS (SELECT unnest([{stim}]) AS s), {TREE},
  k3 AS (SELECT s, node, parent, r, {amps} AS i FROM tree, st WHERE level = 3),
  k2 AS (SELECT st.s, t.node, t.parent, t.r, coalesce(sum(k.i), 0)::BIGINT AS i FROM tree t CROSS JOIN st LEFT JOIN k3 k ON k.parent = t.node AND k.s = st.s WHERE t.level = 2 GROUP BY ALL),
  k1 AS (SELECT st.s, t.node, t.parent, t.r, coalesce(sum(k.i), 0)::BIGINT AS i FROM tree t CROSS JOIN st LEFT JOIN k2 k ON k.parent = t.node AND k.s = st.s WHERE t.level = 1 GROUP BY ALL),
  d1 AS (SELECT s, node, parent, 1 AS level, r * i AS drop FROM k1), d2 AS (SELECT k.s, k.node, k.parent, 2 AS level, d.drop + k.r * k.i AS drop FROM k2 k JOIN d1 d ON d.node = k.parent AND d.s = k.s),
  d3 AS (SELECT k.s, k.node, k.parent, 3 AS level, d.drop + k.r * k.i AS drop FROM k3 k JOIN d2 d ON d.node = k.parent AND d.s = k.s),
  solved AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"""


def with_stimuli(edges: DataFrame, n: int, amps) -> DataFrame:
    return edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("s")).withColumn("amps", F.when(F.col("level") == 3, amps).otherwise(0).cast("bigint"))


_KEY = "CAST(substr(node, 2) AS BIGINT)"


def key():
    return F.substring("node", 2, 20).cast("bigint")


@query(f"WITH {SOLVED} SELECT node, parent, level, CAST(drop AS BIGINT) AS drop FROM solved")
def flat_ir_drop(t: Tables) -> DataFrame:
    return tr.solve_tree(tree(t)).select("node", "parent", "level", "drop")


@query(f"""WITH {SOLVED}, w AS (SELECT node, drop, row_number() OVER (ORDER BY drop DESC, node) AS k FROM solved)
SELECT CAST(k AS INTEGER) AS place, node, printf('%4d  %-24s %12d', k, node, drop) AS line FROM w WHERE k <= 25""")
def topk_worst_nodes(t: Tables) -> DataFrame:
    return worst_report(tr.solve_tree(tree(t)), 25)


@query(f"WITH {solved_by('0, 1, 2, 3', f'1 + ({_KEY} + s) % 5')} SELECT s, node, CAST(drop AS BIGINT) AS drop FROM solved")
def batch_ir_drop(t: Tables) -> DataFrame:
    """Four stimuli in the same joins."""
    return tr.solve_tree(with_stimuli(tree(t), 4, 1 + (key() + F.col("s")) % 5), by=("s",)).select("s", "node", "drop")


@query(f"""WITH {SOLVED}, p AS (SELECT node, parent AS net FROM solved WHERE level = 1), q AS (SELECT s.node, net FROM solved s JOIN p ON p.node = s.parent WHERE level = 2),
  n AS (SELECT node, net FROM p UNION ALL SELECT * FROM q UNION ALL SELECT s.node, net FROM solved s JOIN q ON q.node = s.parent WHERE level = 3)
SELECT net, count(*) AS nodes, CAST(max(drop) AS BIGINT) AS worst FROM solved JOIN n USING (node) GROUP BY 1""")
def per_net_ir_drop(t: Tables) -> DataFrame:
    """Each region is a net of its own; its worst drop and size."""
    edges = tree(t)
    solved = tr.solve_tree(edges)
    top = solved.filter("level = 1").select("node", F.col("parent").alias("net"), "drop")
    rows = top
    above = top
    for level in (2, 3):
        above = solved.filter(F.col("level") == level).select("node", "parent", "drop").join(above.select(F.col("node").alias("parent"), "net"), "parent").select("node", "net", "drop")
        rows = rows.unionByName(above)
    return rows.groupBy("net").agg(F.count(F.lit(1)).alias("nodes"), F.max("drop").alias("worst"))


@query(f"WITH {SOLVED} SELECT node, CAST(drop AS BIGINT) AS drop FROM solved")
def hierarchical_ir_drop(t: Tables) -> DataFrame:
    return so.hierarchical(tree(t), 2, 3).select("node", "drop")


@query(f"WITH {SOLVED} SELECT node, round(drop::DOUBLE, 4) AS drop FROM solved")
def coupled_ir_drop(t: Tables) -> DataFrame:
    return so.coupled(tree(t)).select("node", F.round("drop", 4).alias("drop"))


_STAMP = f"""{MESH}, x AS (SELECT u AS i, u AS j, g FROM mesh UNION ALL SELECT v, v, g FROM mesh UNION ALL SELECT u, v, -g FROM mesh UNION ALL SELECT v, u, -g FROM mesh),
  m AS (SELECT i, j, CAST(sum(g) AS BIGINT) AS g FROM x GROUP BY 1, 2)"""


@query(f"WITH {_STAMP} SELECT * FROM m")
def conductance_stamp(t: Tables) -> DataFrame:
    return la.stamp(mesh(t))


@query(f"WITH {_STAMP} SELECT i, j, g FROM m WHERE NOT (i[1] = 's' AND CAST(substr(i, 2) AS BIGINT) % 10 = 0) AND (j[1] = 's' AND CAST(substr(j, 2) AS BIGINT) % 10 = 0)")
def reduced_system_blocks(t: Tables) -> DataFrame:
    """The block that joins the unknowns with the fixed nodes (every tenth supplier)."""
    fixed = t.supplier.filter("s_suppkey % 10 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit("fixed").alias("role"))
    return la.with_roles(la.stamp(mesh(t)), fixed, "unknown").filter("row_role = 'unknown' AND col_role = 'fixed'").select("i", "j", "g")


@query(f"""WITH {_STAMP}, r AS (SELECT CASE WHEN i[1] = 's' THEN 'port' ELSE 'interior' END AS row_role, CASE WHEN j[1] = 's' THEN 'port' ELSE 'interior' END AS col_role, g FROM m)
SELECT row_role, col_role, count(*) AS entries, CAST(sum(g) AS BIGINT) AS total FROM r GROUP BY 1, 2""")
def port_interior_blocks(t: Tables) -> DataFrame:
    ports = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit("port").alias("role"))
    m = la.with_roles(la.stamp(mesh(t)), ports, "interior")
    return m.groupBy("row_role", "col_role").agg(F.count(F.lit(1)).alias("entries"), F.sum("g").alias("total"))


_STAR = "star AS (SELECT o_custkey AS block, o_orderkey AS port, (1 + o_orderkey % 7)::DOUBLE AS g FROM orders), a AS (SELECT block, sum(g) AS al FROM star GROUP BY 1)"


def stars(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("block"), F.col("o_orderkey").alias("port"), (1 + F.col("o_orderkey") % 7).cast("double").alias("g"))


@query(f"WITH {_STAR} SELECT block, port, round(g - g * g / al, 9) AS s FROM star JOIN a USING (block)")
def schur_complement(t: Tables) -> DataFrame:
    return so.schur_diagonal(stars(t)).select("block", "port", F.round("s", 9).alias("s"))


@query(f"""WITH {_STAR}, p AS (SELECT block, port, g, (port % 10)::DOUBLE AS x FROM star), c AS (SELECT block, sum(g * x) AS gx FROM p GROUP BY 1)
SELECT block, port, round(g * x - g * gx / al, 6) AS y FROM p JOIN a USING (block) JOIN c USING (block)""")
def schur_product(t: Tables) -> DataFrame:
    """The Schur complement of every star, all its entries, times a vector."""
    s = stars(t)
    x = s.select("block", "port", (F.col("port") % 10).cast("double").alias("x"))
    return so.schur_product(s, x).select("block", "port", F.round("y", 6).alias("y"))


@query(f"WITH {_STAR} SELECT port, round(g / al * (1 + block % 9), 9) AS b FROM star JOIN a USING (block)")
def reduced_rhs(t: Tables) -> DataFrame:
    """The current of each star's centre condensed to its ports."""
    s = stars(t)
    total = s.groupBy("block").agg(F.sum("g").alias("all"))
    return s.join(total, "block").select("port", F.round(F.col("g") / F.col("all") * (1 + F.col("block") % 9), 9).alias("b"))


_SYSTEM = f"""{_STAMP}, d AS MATERIALIZED (SELECT i, g + CASE WHEN i[1] = 's' THEN 5000 ELSE 50 END AS d FROM m WHERE i = j), o AS MATERIALIZED (SELECT i, j, g FROM m WHERE i <> j), b AS MATERIALIZED (SELECT i, d, 1.0::DOUBLE + CAST(substr(i, 2) AS BIGINT) % 7 AS b FROM d),
  x1 AS MATERIALIZED (SELECT i, b / d AS x FROM b)"""


def _system(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The mesh with a leak to ground at every node, and a load at each."""
    edges = mesh(t)
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    leaks = nodes.select(F.col("node").alias("u"), F.lit("0").alias("v"), F.when(F.col("node").startswith("s"), 5000).otherwise(50).cast("bigint").alias("g"))
    return la.stamp(edges.unionByName(leaks)), nodes.select("node", (F.lit(1.0) + key() % 7).alias("b"))


def _sweep(k: int) -> str:
    return f"x{k} AS MATERIALIZED (SELECT b.i, (b.b - coalesce(y, 0)) / b.d AS x FROM b LEFT JOIN (SELECT o.i, sum(o.g * x.x) AS y FROM o JOIN x{k - 1} x ON x.i = o.j GROUP BY 1) q ON q.i = b.i)"


@query(f"WITH {_SYSTEM}, {_sweep(2)}, {_sweep(3)}, {_sweep(4)} SELECT i AS node, round(x, 9) AS x FROM x4")
def jacobi_sweeps(t: Tables) -> DataFrame:
    return la.jacobi(*_system(t), 4).select("node", F.round("x", 9).alias("x"))


@query()
def pcg_solve(t: Tables) -> DataFrame:
    """The mesh solved to a small residual; the residual is tested, SQL has no loop that ends by it."""
    return la.conjugate_gradients(*_system(t), 1e-8)[0].select("node", F.round("x", 7).alias("x"))


@query()
def dense_block_solve(t: Tables) -> DataFrame:
    """Every island with a pad solved for loads of one at its free nodes: small islands by a dense kernel each, those too large for one by iteration."""
    edges = thin(t).select("u", "v", (1.0 / F.col("r")).alias("g"))
    ends = edges.select("u").unionByName(edges.select(F.col("v").alias("u"))).distinct().select(F.col("u").alias("node"))
    pad = F.col("node").startswith("c") & (F.substring("node", 2, 20).cast("bigint") % 5 == 0)
    solved = network_drop(edges, ends.filter(pad), ends.filter(~pad).withColumn("amps", F.lit(1.0)), 0.0)
    return solved.filter(~pad).select("node", F.round("drop", 6).alias("drop"))


def lattice_system(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as a lattice: unit conductances between neighbours, a leak at every node, the part's size as load."""
    n = lattice(t).select("node", "x", "y", "amps")
    right = n.filter("x < 49000").select(F.col("node").alias("u"), (F.col("node") + 1).alias("v"))
    up = n.select(F.col("node").alias("u"), (F.col("node") + 50).alias("v"))
    links = rel.induced(right.unionByName(up), n.select("node")).select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.lit(1.0).alias("g"))
    leaks = n.select(F.col("node").cast("string").alias("u"), F.lit("ground").alias("v"), F.lit(0.2).alias("g"))
    return n.select("node", "x", "y"), la.stamp(links.unionByName(leaks), "ground"), n.select("node", F.col("amps").cast("double").alias("b"))


@query()
def tile_solve(t: Tables) -> DataFrame:
    """Each tile with its halo alone, nothing known outside."""
    return so.tiled(*lattice_system(t), 10_000, 3_000, 1).select("node", F.round("x", 6).alias("drop"))


@query()
def tiled_ir_drop(t: Tables) -> DataFrame:
    """Tiles and halos, swept until they agree with the whole network (tested against conjugate gradients)."""
    return so.tiled(*lattice_system(t), 10_000, 3_000, 500, 1e-7).select("node", F.round("x", 6).alias("drop"))


# Time


@query(f"WITH {solved_by('0, 1, 2, 3, 4, 5', f'1 + ({_KEY} * 3 + s * 2) % 11')} SELECT s AS step, CAST(max(drop) AS BIGINT) AS worst, CAST(sum(drop) AS BIGINT) AS total, count(*) AS nodes FROM solved GROUP BY 1")
def quasi_static_drop(t: Tables) -> DataFrame:
    """A static solve for each of six times, in the same joins."""
    solved = tr.solve_tree(with_stimuli(tree(t), 6, 1 + (key() * 3 + F.col("s") * 2) % 11), by=("s",))
    return solved.groupBy(F.col("s").alias("step")).agg(F.max("drop").alias("worst"), F.sum("drop").alias("total"), F.count(F.lit(1)).alias("nodes"))


_DAILY = """e AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, value, event_type FROM events WHERE ts IS NOT NULL), span AS (SELECT min(day) AS day0, max(day) - min(day) + 1 AS steps FROM e),
  d AS (SELECT user_id, CAST(day - day0 AS INTEGER) AS step, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS al,
  CAST(sum(CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS near FROM e, span GROUP BY ALL),
  g AS (SELECT u.user_id, k.step, coalesce(al, 0)::DOUBLE AS al, coalesce(near, 0)::DOUBLE AS near FROM (SELECT DISTINCT user_id FROM d) u CROSS JOIN (SELECT CAST(unnest(range(steps)) AS INTEGER) AS step FROM span) k LEFT JOIN d ON d.user_id = u.user_id AND d.step = k.step),
  v AS (SELECT user_id, step, (al / 1.5)::DOUBLE AS v, (near / 1.5)::DOUBLE AS w FROM g WHERE step = 0
    UNION ALL SELECT g.user_id, g.step, (0.5::DOUBLE * v.v + g.al) / 1.5::DOUBLE, (0.5::DOUBLE * v.w + g.near) / 1.5::DOUBLE FROM v JOIN g ON g.user_id = v.user_id AND g.step = v.step + 1)"""


def daily(t: Tables) -> tuple[DataFrame, int]:
    """user_id, step (days from the first day of all events), al and near: an event's hundredths as current, summed for a day before any group is gathered; and the number of days."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    day = F.floor(F.unix_timestamp("ts") / 86400)
    rows = t.events.filter("ts IS NOT NULL").select("user_id", day.alias("day"), cents.alias("c"), "event_type")
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    steps = last - first + 1 if first is not None else 0
    sums = rows.groupBy("user_id", (F.col("day") - F.lit(first or 0)).cast("int").alias("step"))
    return sums.agg(F.sum("c").cast("double").alias("al"), F.sum(F.when(F.col("event_type") == "click", F.col("c")).otherwise(0)).cast("double").alias("near")), steps


@query(f"WITH RECURSIVE {_DAILY} SELECT user_id, step, round(v, 4) AS drop FROM v")
def transient_rc(t: Tables) -> DataFrame:
    """Backward Euler for one RC node a user, a day a step."""
    loads, steps = daily(t)
    return so.step_rc(loads, "user_id", ["al"], steps, 1.0, 0.5).select("user_id", "step", F.round("al", 4).alias("drop"))


@query(f"WITH RECURSIVE {_DAILY} SELECT user_id, round(max(v), 4) AS worst, round(max(w), 4) AS worst_near, round(max(v - w), 4) AS worst_far FROM v GROUP BY 1")
def transient_masks(t: Tables) -> DataFrame:
    """All and near loads stepped together; far is their difference, as drops superpose."""
    loads, steps = daily(t)
    v = so.step_rc(loads, "user_id", ["al", "near"], steps, 1.0, 0.5)
    return v.groupBy("user_id").agg(F.round(F.max("al"), 4).alias("worst"), F.round(F.max("near"), 4).alias("worst_near"), F.round(F.max(F.col("al") - F.col("near")), 4).alias("worst_far"))


# Partitions


@query("""WITH b AS (SELECT design_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid_nodes GROUP BY 1)
SELECT design_id, CAST(r * 3 + c AS INTEGER) AS tile_id, x0 + c * (x1 - x0) / 3 AS a0, x0 + (c + 1) * (x1 - x0) / 3 AS a1, y0 + r * (y1 - y0) / 2 AS b0, y0 + (r + 1) * (y1 - y0) / 2 AS b1
FROM b, (SELECT unnest(range(3)) AS c), (SELECT unnest(range(2)) AS r)""")
def uniform_tiles(t: Tables) -> DataFrame:
    """The rectangles of 3 by 2 tiles over each design."""
    b = rel.bounding_box(t.grid_nodes, ["design_id"])
    each = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c")).select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("r"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return each.select("design_id", (F.col("r") * 3 + F.col("c")).alias("tile_id"), (F.col("x0") + F.col("c") * w / 3).alias("a0"), (F.col("x0") + (F.col("c") + 1) * w / 3).alias("a1"), (F.col("y0") + F.col("r") * h / 2).alias("b0"), (F.col("y0") + (F.col("r") + 1) * h / 2).alias("b1"))


@query(f"""WITH {LATTICE}, o AS (SELECT node, x, row_number() OVER (ORDER BY x, node) - 1 AS k, count(*) OVER () AS n FROM lattice),
  s AS (SELECT node, x, CASE WHEN k < (n % 4) * (n // 4 + 1) THEN k // (n // 4 + 1) ELSE n % 4 + (k - (n % 4) * (n // 4 + 1)) // (n // 4) END AS slab FROM o),
  c AS (SELECT slab, max(x) AS cut FROM s WHERE slab < 3 GROUP BY 1)
SELECT l.node, CAST((SELECT count(*) FROM c WHERE c.cut < l.x) AS INTEGER) AS part, EXISTS (SELECT 1 FROM c WHERE c.cut = l.x) AS separator FROM lattice l""")
def structured_partition(t: Tables) -> DataFrame:
    """Four slabs of nearly equal loads; the columns at the cuts separate them."""
    n = lattice(t).select("node", "x")
    slabs = ag.balanced_slabs(n, "node", "x", 4)
    cuts = [r.cut for r in slabs.filter("slab < 3").groupBy("slab").agg(F.max("x").alias("cut")).collect()]
    x = F.col("x")
    part = sum([F.when(x > c, 1).otherwise(0) for c in cuts], F.lit(0))
    return n.select("node", part.cast("int").alias("part"), x.isin(cuts).alias("separator"))


# Analyses


@query(f"""WITH {TREE}, a AS (SELECT node, r, parent FROM tree WHERE level = 1), b AS (SELECT t.node, t.r + a.r AS r FROM tree t JOIN a ON a.node = t.parent WHERE level = 2), c AS (SELECT t.node, t.r + b.r AS r FROM tree t JOIN b ON b.node = t.parent WHERE level = 3)
SELECT node, CAST(r AS BIGINT) AS r_ground FROM (SELECT node, r FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def effective_resistance_ground(t: Tables) -> DataFrame:
    return _to_ground(tree(t)).select("node", F.col("rg").alias("r_ground"))


def _to_ground(edges: DataFrame) -> DataFrame:
    """Resistance of each node to its pad, and that of its ancestors."""
    a = edges.filter("level = 1").select("node", "parent", F.col("r").alias("rg"), F.col("r").alias("r1"), F.lit(None).cast("bigint").alias("r2"), F.col("node").alias("n1"), F.lit(None).cast("string").alias("n2"))
    b = edges.filter("level = 2").select("node", "parent", "r").join(a.select(F.col("node").alias("parent"), F.col("rg").alias("_r")), "parent").select("node", "parent", (F.col("r") + F.col("_r")).alias("rg"), F.col("_r").alias("r1"), (F.col("r") + F.col("_r")).alias("r2"), F.col("parent").alias("n1"), F.col("node").alias("n2"))
    c = edges.filter("level = 3").select("node", "parent", "r").join(b.select(F.col("node").alias("parent"), F.col("rg").alias("_r"), F.col("r1"), F.col("n1")), "parent").select("node", "parent", (F.col("r") + F.col("_r")).alias("rg"), "r1", F.col("_r").alias("r2"), "n1", F.col("parent").alias("n2"))
    return a.unionByName(b).unionByName(c)


@query(f"""WITH {TREE}, a AS (SELECT node, r FROM tree WHERE level = 1), b AS (SELECT t.node, t.r + a.r AS r, a.node AS n1, a.r AS r1 FROM tree t JOIN a ON a.node = t.parent WHERE level = 2),
  c AS (SELECT CAST(substr(t.node, 2) AS BIGINT) AS k, t.r + b.r AS r, b.node AS n2, b.r AS r2, n1, r1 FROM tree t JOIN b ON b.node = t.parent WHERE level = 3)
SELECT p.k AS u, q.k AS v, CAST(p.r + q.r - 2 * CASE WHEN p.n2 = q.n2 THEN p.r2 WHEN p.n1 = q.n1 THEN p.r1 ELSE 0 END AS BIGINT) AS r FROM c p JOIN c q ON q.k = p.k + 1""")
def effective_resistance_pairs(t: Tables) -> DataFrame:
    """Resistance between consecutive orders, through their last common ancestor; pads are one node."""
    c = _to_ground(tree(t)).filter(F.col("node").startswith("o")).select(key().alias("k"), "rg", "r1", "r2", "n1", "n2")
    p, q = c.select(*[F.col(x).alias(f"p_{x}") for x in c.columns]), c.select(*[F.col(x).alias(f"q_{x}") for x in c.columns])
    both = p.join(q, F.col("q_k") == F.col("p_k") + 1)
    common = F.when(F.col("p_n2") == F.col("q_n2"), F.col("p_r2")).when(F.col("p_n1") == F.col("q_n1"), F.col("p_r1")).otherwise(0)
    return both.select(F.col("p_k").alias("u"), F.col("q_k").alias("v"), (F.col("p_rg") + F.col("q_rg") - 2 * common).alias("r"))


@query(f"WITH {_STAR} SELECT port, round(1 / g + 1 / (al - g), 9) AS r FROM star JOIN a USING (block) WHERE al > g")
def port_effective_resistance(t: Tables) -> DataFrame:
    """A star's load to its other ports, all of them fixed."""
    s = stars(t)
    total = s.groupBy("block").agg(F.sum("g").alias("all"))
    return s.join(total, "block").filter(F.col("all") > F.col("g")).select("port", F.round(1 / F.col("g") + 1 / (F.col("all") - F.col("g")), 9).alias("r"))


_NEAR = f"CASE WHEN s = 0 THEN amps WHEN s = 1 AND {_KEY} % 10 < 4 THEN amps WHEN s = 2 AND {_KEY} % 10 >= 4 THEN amps ELSE 0 END"


def _masks(t: Tables) -> DataFrame:
    near = key() % 10 < 4
    amps = F.when(F.col("s") == 0, F.col("amps")).when((F.col("s") == 1) & near, F.col("amps")).when((F.col("s") == 2) & ~near, F.col("amps")).otherwise(0)
    return tr.solve_tree(with_stimuli(tree(t), 3, amps), by=("s",))


@query(f"WITH {solved_by('0, 1, 2', _NEAR)} SELECT node, CAST(max(CASE WHEN s = 1 THEN drop END) AS BIGINT) AS near, CAST(max(CASE WHEN s = 2 THEN drop END) AS BIGINT) AS far FROM solved WHERE level = 2 GROUP BY 1")
def regional_drop(t: Tables) -> DataFrame:
    """Drops at the ports from near loads and from far ones."""
    part = lambda s: F.max(F.when(F.col("s") == s, F.col("drop")))
    return _masks(t).filter("level = 2").groupBy("node").agg(part(1).alias("near"), part(2).alias("far"))


@query(f"""WITH {solved_by('0, 1, 2', _NEAR)}, p AS (SELECT node, max(CASE WHEN s = 0 THEN drop END) AS al, max(CASE WHEN s = 1 THEN drop END) AS near FROM solved WHERE level = 3 GROUP BY 1),
  w AS (SELECT *, row_number() OVER (ORDER BY al DESC, node) AS k FROM p) SELECT node, CAST(al AS BIGINT) AS drop, round(near::DOUBLE / al, 9) AS near_share FROM w WHERE k <= 40""")
def near_far_decomposition(t: Tables) -> DataFrame:
    """The forty worst loads and how much of their drop near loads cause."""
    part = lambda s: F.max(F.when(F.col("s") == s, F.col("drop")))
    p = _masks(t).filter("level = 3").groupBy("node").agg(part(0).alias("drop"), part(1).alias("near"))
    return p.orderBy(F.desc("drop"), "node").limit(40).select("node", "drop", F.round(F.col("near").cast("double") / F.col("drop"), 9).alias("near_share"))


#: Columns of a matrix whose products are gathered in one place; more are refused, none is dropped.
MAX_COLUMNS = 200


@query()
def response_rank(t: Tables) -> DataFrame:
    """Singular values of the suppliers' response to each brand, with their share of the energy."""
    brands = sorted(r.p_brand for r in t.part.select("p_brand").distinct().dropna().limit(MAX_COLUMNS + 1).collect())
    if len(brands) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} brands: the matrix of products of columns would not fit one place")
    joined = t.lineitem.select("l_suppkey", "l_partkey", "l_quantity").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    h = joined.groupBy("l_suppkey").pivot("p_brand", brands).agg(F.sum("l_quantity")).na.fill(0.0)
    s = so.singular_values(h, "l_suppkey", brands)
    total = sum(x * x for x in s) or 1.0
    run, rows = 0.0, []
    for k, x in enumerate(s):
        run += x * x
        rows.append((k + 1, round(x, 4), round(run / total, 9)))
    return t.spark.createDataFrame(rows, "rank int, value double, share double")


_PLACES = """d AS (SELECT design_id, node, max(ir_drop) AS drop FROM solve_drops JOIN solve_runs USING (run_id) WHERE ir_drop IS NOT NULL AND NOT isnan(ir_drop) GROUP BY ALL),
  places AS (SELECT design_id, layer_num, node, x, y, drop FROM d JOIN grid_nodes USING (design_id, node) WHERE x IS NOT NULL AND y IS NOT NULL)"""


def picks_sql(by: str, near: str, n: int) -> str:
    """SQL of n greedy picks, one table a pick."""
    names = by.split(", ")
    filled = " AND ".join(f"{c} IS NOT NULL" for c in names)
    out = f"WITH {_PLACES}, r0 AS MATERIALIZED (SELECT {by}, node, x, y, drop, max(x) OVER g - min(x) OVER g AS ex, max(y) OVER g - min(y) OVER g AS ey FROM places WHERE {filled} WINDOW g AS (PARTITION BY {by}))"
    for k in range(1, n + 1):
        out += f",\n  p{k} AS MATERIALIZED (SELECT {by}, node, x, y, drop FROM r{k - 1} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY drop DESC, node) = 1)"
        out += f", r{k} AS MATERIALIZED (SELECT r.* FROM r{k - 1} r JOIN p{k} p USING ({by}) WHERE NOT ({near} OR r.node = p.node))"
    return out + "\n" + " UNION ALL ".join(f"SELECT {by}, {k} AS pick, node, x, y, drop FROM p{k}" for k in range(1, n + 1))


def worst_places(t: Tables) -> DataFrame:
    """design_id, layer_num, node, x, y, drop: the worst drop of each node over all runs of its design; combined before it meets the places."""
    d = t.solve_drops.filter("ir_drop IS NOT NULL AND NOT isnan(ir_drop)").groupBy("run_id", "node").agg(F.max("ir_drop").alias("drop"))
    d = d.join(t.solve_runs.select("run_id", "design_id"), "run_id").groupBy("design_id", "node").agg(F.max("drop").alias("drop"))
    return d.join(t.grid_nodes.select("design_id", "layer_num", "node", "x", "y"), ["design_id", "node"])


@query(picks_sql("design_id", "(abs(r.x - p.x) <= r.ex * 0.1::DOUBLE AND abs(r.y - p.y) <= r.ey * 0.1::DOUBLE)", 4))
def separated_worst_instances(t: Tables) -> DataFrame:
    """The four worst nodes of each design whose windows, a tenth of its extent, neither overlap nor touch."""
    return ag.separated_worst(worst_places(t), ["design_id"], 4, lambda dx, dy, ex, ey: (dx <= ex * 0.1) & (dy <= ey * 0.1))


@query(picks_sql("design_id, layer_num", "(sqrt((r.x - p.x) * (r.x - p.x) + (r.y - p.y) * (r.y - p.y)) < (r.ex + r.ey) * 0.05::DOUBLE)", 3))
def separated_worst_nodes(t: Tables) -> DataFrame:
    """The three worst nodes of each layer of a design that are a tenth of its mean extent or more apart."""
    return ag.separated_worst(worst_places(t), ["design_id", "layer_num"], 3, lambda dx, dy, ex, ey: F.sqrt(dx * dx + dy * dy) < (ex + ey) * 0.05)


# Plot tables and streams


@query("""SELECT r.design_id, d.node, n.x, n.y, max(d.ir_drop) AS worst FROM solve_drops d JOIN solve_runs r USING (run_id) JOIN grid_nodes n ON n.design_id = r.design_id AND n.node = d.node
WHERE d.ir_drop IS NOT NULL AND NOT isnan(d.ir_drop) AND n.x IS NOT NULL GROUP BY ALL""")
def node_value_map(t: Tables) -> DataFrame:
    """Where each node is and its worst drop over all runs; the drops are combined before they meet the places."""
    d = t.solve_drops.filter("ir_drop IS NOT NULL AND NOT isnan(ir_drop)").groupBy("run_id", "node").agg(F.max("ir_drop").alias("w"))
    d = d.join(t.solve_runs.select("run_id", "design_id"), "run_id").groupBy("design_id", "node").agg(F.max("w").alias("worst"))
    return d.join(t.grid_nodes.filter("x IS NOT NULL").select("design_id", "node", "x", "y"), ["design_id", "node"])


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL""")
def metric_series(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths, max(value) AS most FROM events GROUP BY ALL""")
def streamed_metrics(t: Tables) -> DataFrame:
    """The daily series made by a stream over the event files."""
    stream = monitor.read_stream(t.spark, f"{t.dir}/events.parque*", t.events)
    return monitor.run_once(monitor.windowed_metrics(stream), ["start", "event_type"])


@query("""SELECT run_id, '{"run_id":' || run_id || ',"run_kind":"' || run_kind || '","n_steps":' || n_steps || '}' AS json FROM solve_runs""")
def run_json(t: Tables) -> DataFrame:
    return as_json(t.solve_runs.select("run_id", "run_kind", "n_steps"), "run_id")


_LATEST = """w AS (SELECT source_id, seq, CASE WHEN isfinite(amps_ma) THEN CAST(round(amps_ma * 1000) AS BIGINT) END AS ua, row_number() OVER (PARTITION BY source_id, seq ORDER BY arrived_at DESC NULLS LAST, point_id DESC) AS n FROM pwl_points WHERE seq IS NOT NULL)"""


@query(f"""WITH {_LATEST}, r AS (SELECT source_id, seq, ua, (row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1) // 1024 AS piece FROM w WHERE n = 1),
  p AS (SELECT source_id, piece, list({{'seq': seq, 'microamps': ua}} ORDER BY seq) AS waveform FROM r GROUP BY 1, 2)
SELECT source_id, coalesce(piece, 0) AS piece, CAST(to_json({{'source_id': source_id, 'node': node, 'run': {{'run_id': run_id, 'n_steps': n_steps}}, 'waveform': coalesce(waveform, [])}}) AS VARCHAR) AS json
FROM pwl_sources s JOIN solve_runs USING (run_id) LEFT JOIN p USING (source_id)""")
def waveform_json(t: Tables) -> DataFrame:
    """Every source as a nested JSON object with its run and its wave; a wave of more than PACKED points is several objects, numbered by piece."""
    amps = F.when(F.abs("amps_ma") < float("inf"), F.round(F.col("amps_ma") * 1000).cast("bigint"))
    points = t.pwl_points.filter("seq IS NOT NULL").select("source_id", "seq", "arrived_at", "point_id", amps.alias("microamps"))
    last = points.groupBy("source_id", "seq").agg(F.max_by("microamps", F.struct("arrived_at", "point_id")).alias("microamps"))
    piece = F.floor((F.col("rank") - 1) / PACKED).alias("piece")
    waves = running(last, ["source_id"], [F.asc("seq")]).groupBy("source_id", piece).agg(F.sort_array(F.collect_list(F.struct("seq", "microamps"))).alias("waveform"))
    runs = t.solve_runs.select("run_id", "n_steps")
    rows = t.pwl_sources.select("source_id", "node", "run_id").join(runs, "run_id").join(waves, "source_id", "left")
    empty = F.array().cast(waves.schema["waveform"].dataType)
    rows = rows.select("source_id", F.coalesce("piece", F.lit(0)).alias("piece"), "node", F.struct("run_id", "n_steps").alias("run"), F.coalesce("waveform", empty).alias("waveform"))
    return as_nested_json(rows, ["source_id", "piece"], ["source_id", "node", "run", "waveform"])


@query()
def network_ir_drop(t: Tables) -> DataFrame:
    """Every design's network solved: resistors in kOhm, loads in mA, so drops are in V; nodes of floating islands are left out."""
    once = rel.elements_once(t.grid_elements)
    ends = rel.with_ends(once, t.grid_nodes, "left").withColumn("kind", F.upper(F.trim("elem_type")))
    name = lambda c, raw: F.when(F.ltrim(F.col(raw), F.lit("*")) == "0", F.lit("0")).otherwise(F.col(c).cast("string"))
    edges = ends.filter("kind = 'R'").select(name("a", "u").alias("u"), name("b", "v").alias("v"), conductance(F.col("elem_value")).alias("g"))
    loads = ends.filter("kind = 'I'").select(F.coalesce("a", "b").cast("string").alias("node"), F.abs("elem_value").alias("amps")).dropna()
    pads = t.grid_nodes.filter("is_pad").select(F.col("node_id").cast("string").alias("node"))
    solved = network_drop(edges, pads, loads, 0.0)
    return solved.select(F.col("node").cast("bigint").alias("node_id"), F.col("island").cast("bigint").alias("island"), F.round("drop", 9).alias("drop"))
