"""Sources: netlist text, synthetic grids, stimuli."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.values import instance_parts, spice_value, time_value, value_with_params
from ..sources import netlist, synthetic
from .registry import Tables, query

PLAIN = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def sql_value(x: str) -> str:
    """SQL of spice_value."""
    digits, suffix = f"regexp_extract({x}, '^({PLAIN})', 1)", f"lower(regexp_extract({x}, '^{PLAIN}([A-Za-z]*)', 1))"
    factor = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in (("f", 1e-15), ("p", 1e-12), ("n", 1e-9), ("u", 1e-6), ("m", 1e-3), ("k", 1e3), ("meg", 1e6), ("g", 1e9), ("t", 1e12)))
    return f"(CAST(nullif({digits}, '') AS DOUBLE) * CASE {suffix} {factor} ELSE 1.0::DOUBLE END)"


def _lines(t: Tables) -> DataFrame:
    return t.netlist_lines.select("line_id", "design_id", "file_name", "line_no", "raw_line").distinct()


_DISTINCT = "l AS (SELECT DISTINCT line_id, design_id, file_name, line_no, raw_line FROM netlist_lines)"
_FIELDS = r"string_split(trim(regexp_replace(raw_line, '[ \t\r]+', ' ', 'g')), ' ')"


@query(rf"""WITH {_DISTINCT},
  a AS (SELECT file_name, line_no, trim(regexp_replace(CASE WHEN line_no % 4 = 0 THEN '+ ' || raw_line ELSE raw_line END, '[ \t\r]+', ' ', 'g')) AS t FROM l),
  b AS (SELECT *, sum(CASE WHEN starts_with(t, '+') THEN 0 ELSE 1 END) OVER (PARTITION BY file_name ORDER BY line_no) AS part FROM a WHERE t <> '' AND NOT starts_with(t, '*')),
  c AS (SELECT file_name, min(line_no) AS line_no, string_agg(trim(regexp_replace(t, '^\+', '')), ' ' ORDER BY line_no) AS t FROM b GROUP BY file_name, part)
SELECT file_name, line_no, trim(regexp_replace(t, ' \*( .*)?$', '')) AS text FROM c""")
def assemble_logical_lines(t: Tables) -> DataFrame:
    raw = F.when(F.col("line_no") % 4 == 0, F.concat(F.lit("+ "), "raw_line")).otherwise(F.col("raw_line"))
    return netlist.logical_lines(_lines(t).withColumn("raw_line", raw))


@query(rf"""WITH {_DISTINCT}, a AS (SELECT line_id, trim(raw_line, ' \t' || chr(9) || chr(13)) AS t FROM l WHERE raw_line IS NOT NULL),
  b AS (SELECT line_id, lower(regexp_extract(t, '^\.([A-Za-z_]+)', 1)) AS command, trim(regexp_extract(t, '^\.[A-Za-z_]*(.*)', 1)) AS rest FROM a WHERE starts_with(t, '.'))
SELECT line_id, command, rest, nullif(regexp_extract(rest, '([A-Za-z_][A-Za-z0-9_]*)[ \t]*=[ \t]*([^ \t=]+)', 1), '') AS name,
  {sql_value("nullif(regexp_extract(rest, '([A-Za-z_][A-Za-z0-9_]*)[ " + chr(92) + "t]*=[ " + chr(92) + "t]*([^ " + chr(92) + "t=]+)', 2), '')")} AS value FROM b""")
def parse_parameters(t: Tables) -> DataFrame:
    return netlist.commands(_lines(t))


@query(rf"""WITH {_DISTINCT}, a AS (SELECT line_id, {_FIELDS} AS f FROM l WHERE ends_with(file_name, '.nd') AND NOT regexp_matches(raw_line, '^[ \t]*[*.]'))
SELECT line_id, f[1] AS node, f[6] AS net FROM a WHERE len(f) >= 6""")
def node_net_map(t: Tables) -> DataFrame:
    return netlist.node_nets(_lines(t))


def _element_sql(letter: str, factor: str) -> str:
    return rf"""WITH {_DISTINCT}, a AS (SELECT line_id, file_name, line_no, {_FIELDS} AS f FROM l WHERE ends_with(file_name, '.ckt')),
  b AS (SELECT line_id, CASE WHEN length(f[1]) > 1 THEN f[1] ELSE file_name || ':' || line_no END AS name, regexp_replace(f[2], '^\*', '') AS u,
        regexp_replace(f[3], '^\*', '') AS v, {sql_value("f[4]")} * {factor}::DOUBLE AS value FROM a WHERE lower(substr(f[1], 1, 1)) = '{letter}' AND len(f) >= 4)
SELECT * FROM b WHERE value IS NOT NULL"""


@query(_element_sql("r", "0.001"))
def parse_resistors(t: Tables) -> DataFrame:
    return netlist.two_terminal(_lines(t), "r")


@query(_element_sql("c", "1e15"))
def parse_capacitors(t: Tables) -> DataFrame:
    return netlist.two_terminal(_lines(t), "c")


@query(_element_sql("l", "1e9"))
def parse_inductors(t: Tables) -> DataFrame:
    return netlist.two_terminal(_lines(t), "l")


def _part_text(t: Tables, *pieces) -> DataFrame:
    return t.part.select("p_partkey", F.concat_ws(" ", *pieces).alias("text"))


@query("""SELECT p_partkey, 'K' || p_partkey AS name, 'L' || p_partkey AS l1, 'L' || (p_partkey + 1) AS l2, (p_size / 100.0::DOUBLE) AS k FROM part""")
def parse_couplings(t: Tables) -> DataFrame:
    """K lines, written from parts and read back."""
    key = F.col("p_partkey")
    rows = _part_text(t, F.concat(F.lit("K"), key), F.concat(F.lit("L"), key), F.concat(F.lit("L"), key + 1), (F.col("p_size") / 100).cast("string"))
    f = netlist.fields(F.col("text"))
    return rows.filter(F.col("text").rlike("^[kK]")).select("p_partkey", F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).alias("l1"), F.get(f, F.lit(2)).alias("l2"), spice_value(F.get(f, F.lit(3))).alias("k"))


@query("""SELECT s_suppkey, 'Vpad' || s_suppkey AS name, 'n' || s_nationkey AS plus, '0' AS minus, (s_suppkey % 9) * 0.001::DOUBLE AS dc, CAST(s_suppkey % 4 AS VARCHAR) AS portid FROM supplier""")
def parse_voltage_sources(t: Tables) -> DataFrame:
    """V lines with options, written from suppliers and read back."""
    s = F.col("s_suppkey")
    text = F.concat_ws(" ", F.concat(F.lit("Vpad"), s), F.concat(F.lit("n"), "s_nationkey"), F.lit("0"), F.concat((s % 9).cast("string"), F.lit("m")), F.concat(F.lit("PORTID="), s % 4))
    f = netlist.fields(text)
    return t.supplier.select("s_suppkey", F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).alias("plus"), F.get(f, F.lit(2)).alias("minus"), spice_value(F.get(f, F.lit(3))).alias("dc"), F.regexp_extract(text, r"(?i)PORTID=([^ ]+)", 1).alias("portid"))


@query("""SELECT p_partkey, upper(substr('EFGH', CAST(p_partkey % 4 AS INTEGER) + 1, 1)) AS kind, 'a' || p_partkey AS u, 'b' || p_partkey AS v, p_size * 1000.0::DOUBLE AS gain FROM part""")
def parse_controlled_sources(t: Tables) -> DataFrame:
    """Controlled sources keep kind, ends and gain; no solve uses them."""
    key = F.col("p_partkey")
    letter = F.substring(F.lit("EFGH"), (key % 4 + 1).cast("int"), F.lit(1))
    rows = _part_text(t, F.concat(letter, key), F.concat(F.lit("a"), key), F.concat(F.lit("b"), key), F.lit("c"), F.lit("d"), F.concat("p_size", F.lit("k")))
    f = netlist.fields(F.col("text"))
    return rows.select("p_partkey", F.upper(F.substring("text", 1, 1)).alias("kind"), F.get(f, F.lit(1)).alias("u"), F.get(f, F.lit(2)).alias("v"), spice_value(F.get(f, F.lit(5))).alias("gain"))


_SP = r"trim(regexp_replace(raw_line, '[ \t\r]+', ' ', 'g'))"
_HEAD = "'^([iI][^ ]*) ([^ ]+) ([^ ]+) ([^ ]+)'"


@query(rf"""WITH {_DISTINCT}, a AS (SELECT line_id, {_SP} AS t FROM l WHERE ends_with(file_name, '.sp')),
  b AS (SELECT *, regexp_extract(t, {_HEAD}, 4) AS dc, nullif(regexp_extract(t, '(?i) static_value=([^ ]+)', 1), '') AS st FROM a WHERE regexp_matches(t, {_HEAD}))
SELECT line_id, regexp_extract(t, {_HEAD}, 1) AS name, regexp_replace(regexp_extract(t, {_HEAD}, 2), '^\*', '') AS node, regexp_extract(t, {_HEAD}, 3) AS ret,
  {sql_value("dc")} * 1000 AS dc_ma, {sql_value("st")} * 1000 AS static_ma, nullif(regexp_extract(t, '(?i) inst="([^"]*)"', 1), '') AS instance,
  CAST(len(regexp_extract_all(t, '(?i) pulse\(')) AS INTEGER) AS pulses, CAST(len(regexp_extract_all(t, '(?i) pwl\(')) AS INTEGER) AS pwls FROM b""")
def parse_current_sources(t: Tables) -> DataFrame:
    return netlist.current_sources(_lines(t))


_LIST = r"list_filter(regexp_split_to_array(x, '[,\s]+'), lambda y: y <> '')"


@query(rf"""WITH {_DISTINCT}, a AS (SELECT line_id, regexp_extract_all(raw_line, '(?i)pulse\(([^()]*)\)', 1) AS p FROM l WHERE ends_with(file_name, '.sp')),
  b AS (SELECT line_id, unnest(p) AS x, unnest(range(len(p))) AS k FROM a), c AS (SELECT line_id, k, {_LIST} AS v FROM b)
SELECT line_id, CAST(k AS INTEGER) AS pulse_no, coalesce({sql_value("v[1]")}, 0) AS v1, coalesce({sql_value("v[2]")}, 0) AS v2, coalesce({sql_value("v[3]")}, 0) AS delay, coalesce({sql_value("v[7]")}, 0) AS period FROM c""")
def parse_pulse_literals(t: Tables) -> DataFrame:
    rows = _lines(t).filter(F.col("file_name").endswith(".sp"))
    return rows.select("line_id", F.posexplode(netlist.pulse_literals(F.col("raw_line"))).alias("pulse_no", "p")).select("line_id", "pulse_no", "p.v1", "p.v2", "p.delay", "p.period")


@query(rf"""WITH {_DISTINCT}, a AS (SELECT line_id, regexp_extract_all(raw_line, '(?i)pwl\(([^()]*)\)', 1) AS p FROM l WHERE ends_with(file_name, '.sp')),
  b AS (SELECT line_id, unnest(p) AS x, unnest(range(len(p))) AS k FROM a), c AS (SELECT line_id, k, {_LIST} AS v FROM b),
  d AS (SELECT line_id, k, unnest(range(1, len(v), 2)) AS i, v FROM c)
SELECT line_id, CAST(k AS INTEGER) AS pwl_no, count(*) AS points, min({sql_value("v[i]")}) AS t_first, max({sql_value("v[i]")}) AS t_last FROM d GROUP BY line_id, k""")
def parse_pwl_literals(t: Tables) -> DataFrame:
    rows = _lines(t).filter(F.col("file_name").endswith(".sp"))
    waves = rows.select("line_id", F.posexplode(netlist.pwl_literals(F.col("raw_line"))).alias("pwl_no", "w")).filter(F.size("w") > 0)
    times = F.transform("w", lambda p: p["t"])
    return waves.select("line_id", "pwl_no", F.size("w").cast("bigint").alias("points"), F.array_min(times).alias("t_first"), F.array_max(times).alias("t_last"))


@query("""WITH a AS (SELECT source_id, string_split(src_name, ':') AS p FROM pwl_sources)
SELECT source_id, nullif(nullif(p[1], '0'), '') AS instance, nullif(nullif(p[2], '0'), '') AS pin,
  TRY_CAST(nullif(regexp_extract(coalesce(p[3], ''), '^([0-9]+)_([0-9]+)$', 1), '') AS INTEGER) AS tile_x,
  TRY_CAST(nullif(regexp_extract(coalesce(p[3], ''), '^([0-9]+)_([0-9]+)$', 2), '') AS INTEGER) AS tile_y FROM a""")
def parse_instance_names(t: Tables) -> DataFrame:
    return t.pwl_sources.select("source_id", *[c.alias(n) for n, c in instance_parts(F.col("src_name")).items()])


@query(f"""WITH a AS (SELECT point_id, CAST(point_id % 1000 AS VARCHAR) || CASE point_id % 6 WHEN 0 THEN 'ps' WHEN 1 THEN 'ns' WHEN 2 THEN ' us' WHEN 3 THEN 'ms' WHEN 4 THEN '' ELSE 'h' END AS x FROM pwl_points)
SELECT point_id, CASE point_id % 6 WHEN 0 THEN (point_id % 1000) * 1e-12::DOUBLE WHEN 1 THEN (point_id % 1000) * 1e-9::DOUBLE WHEN 2 THEN (point_id % 1000) * 1e-6::DOUBLE
  WHEN 3 THEN (point_id % 1000) * 1e-3::DOUBLE WHEN 4 THEN (point_id % 1000) * 1.0::DOUBLE END AS seconds FROM a""")
def parse_time_literals(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("ps", "ns", " us", "ms", "", "h"))), (F.col("point_id") % 6 + 1).cast("int"))
    return t.pwl_points.select("point_id", time_value(F.concat((F.col("point_id") % 1000).cast("string"), unit)).alias("seconds"))


@query(f"""WITH {_DISTINCT}, a AS (SELECT line_id, {_FIELDS} AS f FROM l WHERE ends_with(file_name, '.ckt'))
SELECT line_id, f[4] AS literal, {sql_value("f[4]")} AS value FROM a WHERE len(f) = 4""")
def parse_spice_values(t: Tables) -> DataFrame:
    rows = _lines(t).filter(F.col("file_name").endswith(".ckt")).withColumn("f", netlist.fields(F.col("raw_line"))).filter(F.size("f") == 4)
    return rows.select("line_id", F.get("f", F.lit(3)).alias("literal"), spice_value(F.get("f", F.lit(3))).alias("value"))


@query(rf"""WITH {_DISTINCT}, a AS (SELECT line_id, {_FIELDS} AS f FROM l WHERE ends_with(file_name, '.ckt')), b AS (SELECT line_id, f[4] AS x FROM a WHERE len(f) = 4),
  c AS (SELECT *, regexp_extract(x, '^({PLAIN})[A-Za-z]*$', 1) AS d, lower(regexp_extract(x, '^{PLAIN}([A-Za-z]*)$', 1)) AS s FROM b)
SELECT line_id, CASE WHEN upper(x) = 'VDD' THEN 0.75::DOUBLE WHEN upper(x) = 'VSS' THEN 0.0::DOUBLE WHEN d <> '' THEN CAST(d AS DOUBLE) * CASE s WHEN '' THEN 1.0::DOUBLE
  WHEN 'f' THEN 1e-15::DOUBLE WHEN 'p' THEN 1e-12::DOUBLE WHEN 'n' THEN 1e-9::DOUBLE WHEN 'u' THEN 1e-6::DOUBLE WHEN 'm' THEN 1e-3::DOUBLE WHEN 'k' THEN 1e3::DOUBLE
  WHEN 'meg' THEN 1e6::DOUBLE WHEN 'x' THEN 1e6::DOUBLE WHEN 'g' THEN 1e9::DOUBLE WHEN 't' THEN 1e12::DOUBLE END END AS value FROM c""")
def parse_values_with_params(t: Tables) -> DataFrame:
    rows = _lines(t).filter(F.col("file_name").endswith(".ckt")).withColumn("f", netlist.fields(F.col("raw_line"))).filter(F.size("f") == 4)
    return rows.select("line_id", value_with_params(F.get("f", F.lit(3)), {"VDD": 0.75, "VSS": 0.0}).alias("value"))


@query("""WITH s AS (SELECT node_id AS grid_id, CAST(4 + node_id % 5 AS INTEGER) AS n0 FROM grid_nodes WHERE is_pad),
  x AS (SELECT grid_id, l, CAST(ceil(n0 / power(2, l)) AS INTEGER) AS a, CAST(ceil(n0 / power(2, l + 1)) AS INTEGER) AS b FROM s, (SELECT unnest([0, 1]) AS l)),
  i AS (SELECT *, unnest(range(a)) AS i FROM x), j AS (SELECT *, unnest(range(b)) AS j FROM i)
SELECT grid_id, 'via' AS kind, 'L' || l || '_' || i || '_' || j AS u, 'L' || (l + 1) || '_' || j || '_' || i AS v, 0.1::DOUBLE AS r FROM j
UNION ALL SELECT grid_id, 'stripe', 'L' || l || '_' || i || '_' || j, 'L' || l || '_' || i || '_' || (j + 1), (1.0::DOUBLE / power(2, l)) / (b - 1) FROM j WHERE j < b - 1""")
def synthetic_grid_edges(t: Tables) -> DataFrame:
    """A layered grid for each pad, its size from the pad's number."""
    specs = t.grid_nodes.filter("is_pad").select(F.col("node_id").alias("grid_id"), (4 + F.col("node_id") % 5).alias("n0"))
    return synthetic.layered_grid(specs)


@query("""WITH p AS (SELECT o_orderkey AS key FROM orders WHERE (o_orderkey * 7919 + 13) % 100 < 40)
SELECT key, (12.0::DOUBLE / 0.75::DOUBLE) / (SELECT count(*) FROM p) AS amps FROM p""")
def stimulus_uniform(t: Tables) -> DataFrame:
    return synthetic.uniform_stimulus(t.orders.select(F.col("o_orderkey").alias("key")), 12.0, 0.75, 40)


@query("""WITH n AS (SELECT p_partkey % 50 // 10 AS block, p_partkey AS node, unnest(range(4)) AS pattern FROM part),
  w AS (SELECT *, CASE WHEN pattern = 0 THEN 1 ELSE 1 + (node * 31 + pattern * 17) % 10 END AS weight FROM n)
SELECT block, CAST(pattern AS INTEGER) AS pattern, node, 1.0::DOUBLE * weight / sum(weight) OVER (PARTITION BY block, pattern) AS amps FROM w""")
def block_injections(t: Tables) -> DataFrame:
    nodes = t.part.select(F.expr("p_partkey % 50 div 10").alias("block"), F.col("p_partkey").alias("node"))
    return synthetic.block_patterns(nodes, 3, 1.0)


_PLACED = """s AS (SELECT node_id AS grid_id, CAST(4 + node_id % 5 AS INTEGER) AS n0 FROM grid_nodes WHERE is_pad),
  n AS (SELECT grid_id, n0, l, CAST(ceil(n0 / power(2, l)) AS INTEGER) AS n FROM s, (SELECT unnest(range(3)) AS l)),
  i AS (SELECT grid_id, l, n, unnest(range(n)) AS i FROM n), st AS (SELECT grid_id, l, n, i, (2 * i + 1) * 500000 // n AS pos FROM i),
  met AS (SELECT a.grid_id, a.l, a.pos AS across, b.l AS m, b.pos AS along FROM st a JOIN st b ON b.grid_id = a.grid_id AND abs(b.l - a.l) = 1),
  k AS (SELECT grid_id, unnest(range(8)) AS k FROM s), lim AS (SELECT grid_id, min(pos) AS lo, max(pos) AS hi FROM st WHERE l = 1 GROUP BY 1),
  ld AS (SELECT k.grid_id, (2 * ((k * 7919 + k.grid_id * 31) % n) + 1) * 500000 // n AS across, lo + (k * 104729 + k.grid_id * 613) % (hi - lo + 1) AS along FROM k JOIN n ON n.grid_id = k.grid_id AND n.l = 0 JOIN lim ON lim.grid_id = k.grid_id),
  pt AS (SELECT grid_id, l, across, along FROM met UNION SELECT grid_id, 0, across, along FROM ld),
  sg AS (SELECT *, lead(along) OVER (PARTITION BY grid_id, l, across ORDER BY along) AS t FROM pt),
  e2 AS (SELECT grid_id, n, unnest(range(least(4, 2 * n))) AS k FROM n WHERE l = 2), e3 AS (SELECT grid_id, n, k * 2 * n // least(4, 2 * n) AS e FROM e2),
  pd AS (SELECT DISTINCT e3.grid_id, (2 * (e // 2) + 1) * 500000 // n AS across, CASE WHEN e % 2 = 0 THEN lo ELSE hi END AS along FROM e3 JOIN lim USING (grid_id))"""


def _place_name(level: str, across: str, along: str) -> str:
    return f"CASE WHEN {level} % 2 = 0 THEN {along} || '_' || {across} ELSE {across} || '_' || {along} END || '_M' || ({level} + 1)"


@query(f"""WITH {_PLACED} SELECT grid_id, 'VIA' AS kind, {_place_name('l', 'across', 'along')} AS u, {_place_name('m', 'along', 'across')} AS v, 0.1::DOUBLE AS value FROM met WHERE m > l
UNION ALL SELECT grid_id, 'R', {_place_name('l', 'across', 'along')}, {_place_name('l', 'across', 't')}, round((1.0::DOUBLE / power(2, l)) * (t - along) / 1e6::DOUBLE, 12) FROM sg WHERE t IS NOT NULL
UNION ALL SELECT grid_id, 'I', {_place_name('0', 'across', 'along')}, '0', 0.001::DOUBLE FROM ld UNION ALL SELECT grid_id, 'V', {_place_name('2', 'across', 'along')}, '0', 1.0::DOUBLE FROM pd""")
def synthetic_power_grid(t: Tables) -> DataFrame:
    """A whole grid of three layers for each pad, with pads, vias, and loads spliced into its lowest stripes."""
    specs = t.grid_nodes.filter("is_pad").select(F.col("node_id").alias("grid_id"), (4 + F.col("node_id") % 5).cast("int").alias("n0"))
    return synthetic.power_grid(specs).withColumn("value", F.round("value", 12))


@query("""WITH p AS (SELECT node_id AS key, row_number() OVER (ORDER BY (node_id * 7919 + 13) % 10007, node_id) AS k, count(*) OVER () AS n FROM grid_nodes WHERE x BETWEEN 1000 AND 60000 AND y BETWEEN 0 AND 50000)
SELECT key, (12.0::DOUBLE / 0.75::DOUBLE) / least(n, 1000) AS amps FROM p WHERE k <= 1000""")
def stimulus_count_in_area(t: Tables) -> DataFrame:
    """A thousand nodes of a window, picked by hash, share the current evenly."""
    return synthetic.counted_stimulus(t.grid_nodes.select(F.col("node_id").alias("key"), "x", "y"), 12.0, 0.75, 1000, (1000, 60000, 0, 50000))
