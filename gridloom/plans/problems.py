"""Queries of the general problems: regular grids and rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.bad_rows import SCALE, classify, number, parse_lines
from ..operators.regular_grid import current_points, regular_grid
from ..session import table


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, hot = current_points(table(spark, sf_dir, "pwl_points"))
    runs = table(spark, sf_dir, "solve_runs").select("run_id", "t_start", "dt", "n_steps")
    sources = table(spark, sf_dir, "pwl_sources").select("source_id", "run_id", "delay").join(runs, "run_id")
    return regular_grid(readings, sources, hot)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each current source that have no reading."""
    return _grid(spark, sf_dir).filter("mark <> 'read'").select("source_id", "step")


def p2_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source on the time grid of its run, gaps marked and filled."""
    return _grid(spark, sf_dir).select("source_id", "step", "n_readings", "value", "mark", "filled")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of tile and instance files that can't be read, with the reason."""
    return parse_lines(table(spark, sf_dir, "netlist_lines"))[1].select("line_id", "reason").distinct()


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that can be read, with typed fields."""
    good = parse_lines(table(spark, sf_dir, "netlist_lines"))[0]
    return good.select("line_id", "design_id", "file_name", "line_no", "kind", "name", "u", "v", number(F.col("value")).alias("value"), "net", "options")


def p3_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each design made anew: whole-row copies count once; a tile without a node file has failed."""
    lines = table(spark, sf_dir, "netlist_lines").distinct()
    per = classify(lines).select("design_id", "kind", F.col("reason").isNotNull().cast("int").alias("bad"))
    element = F.col("kind").isin("ckt", "sp")
    counts = per.groupBy("design_id").agg(
        F.count(F.when(element, 1)).alias("elements_total"), F.count(F.when(element & (F.col("bad") == 1), 1)).alias("elements_removed"),
        F.count(F.when(~element & (F.col("bad") == 1), 1)).alias("nodes_removed"),
    )
    files = lines.select("design_id", F.regexp_extract("file_name", r"^(.*)\.([A-Za-z]+)$", 1).alias("tile"), F.lower(F.regexp_extract("file_name", r"\.([A-Za-z]+)$", 1)).alias("kind"))
    tiles = files.filter("kind IN ('ckt', 'nd')").groupBy("design_id", "tile").agg(F.max((F.col("kind") == "ckt").cast("int")).alias("ckt"), F.max((F.col("kind") == "nd").cast("int")).alias("nd"))
    tiles = tiles.filter("ckt = 1").groupBy("design_id").agg(F.sum("nd").alias("tiles_parsed"), F.sum(1 - F.col("nd")).alias("tiles_failed"))
    return counts.join(tiles, "design_id", "full").select("design_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("elements_total", "elements_removed", "nodes_removed", "tiles_parsed", "tiles_failed")])


QUERIES = {f.__name__: f for f in (p2_found, p2_series, p3_found, p3_loaded, p3_stats)}

_POINTS = """
  q0 AS (SELECT *, row_number() OVER (PARTITION BY source_id, seq ORDER BY arrived_at DESC NULLS LAST, point_id DESC) AS rn FROM pwl_points),
  q1 AS (SELECT source_id, amps_ma AS value, t * CASE WHEN t_unit IS NULL OR t_unit = 's' THEN 1.0::DOUBLE WHEN t_unit = 'us' THEN 1e-6::DOUBLE
           WHEN t_unit = 'ns' THEN 1e-9::DOUBLE WHEN t_unit = 'ps' THEN 1e-12::DOUBLE END AS sec
         FROM q0 WHERE rn = 1 AND amps_ma IS NOT NULL AND NOT isnan(amps_ma) AND t IS NOT NULL AND NOT isnan(t)),
  src AS (SELECT source_id, coalesce(delay, 0) AS delay, t_start, dt, n_steps FROM pwl_sources JOIN solve_runs USING (run_id)),
  hits AS (SELECT source_id, CAST(floor((sec + delay - t_start) / dt) AS BIGINT) AS step, count(*) AS n, max_by(value, (sec + delay, value)) AS value
           FROM q1 JOIN src USING (source_id) GROUP BY ALL),
  cells AS (SELECT source_id, unnest(range(n_steps)) AS step FROM src),
  grid AS (SELECT c.source_id, c.step, coalesce(n, 0) AS n_readings, value FROM cells c LEFT JOIN hits h ON h.source_id = c.source_id AND h.step = c.step)"""

# The fields of a line: quoted texts and lists in parentheses (to two levels) hold no field end.
_QUOTED = '"[^"]*"'
_F = rf'(?:[^ \t"()]|{_QUOTED}|\((?:[^"()]|{_QUOTED}|\((?:[^"()]|{_QUOTED})*\))*\))+'
_NUM = r"[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"
_VAL = rf"(?:{_NUM}(?:[tTgGkKmMuUnNpPfF]|[mM][eE][gG])?|[vV][dD][dD]|[vV][sS][sS])"
_NOD = r"[*]?(?:0|[0-9]+_[0-9]+_[mM][0-9]|pkg_[A-Za-z0-9_]+)"
_LIST_ITEMS = r"list_filter(regexp_split_to_array(regexp_extract(o, '(?s)[(](.*)[)]$', 1), '[, \t]+'), lambda z: z <> '')"
_JUDGED = rf"""
  l0 AS (SELECT *, lower(regexp_extract(file_name, '[.]([A-Za-z]+)$', 1)) AS kind, regexp_replace(raw_line, '(\r\n|\r|\n)$', '') AS line FROM lines),
  l1 AS (SELECT *, regexp_replace(line, '(?s)^((?:[ \t]*{_F}[ \t])*?[ \t]*)[*](?:[ \t].*)?$', '\1') AS cut FROM l0 WHERE kind IN ('ckt', 'nd', 'sp') AND regexp_matches(line, '^[ \t]*[^ \t*.]')),
  l2 AS (SELECT *, regexp_full_match(cut, '(?s)(?:[ \t]*{_F})*[ \t]*') AS paired, regexp_extract_all(cut, '(?s){_F}') AS f FROM l1),
  l3 AS (SELECT *, CASE WHEN kind = 'sp' THEN f[5:] ELSE [] END AS opts FROM l2),
  l4 AS (SELECT *,
      len(list_filter(opts, lambda o: regexp_matches(o, '(?is)^pulse[(].*[)]$') AND len({_LIST_ITEMS}) <> 7)) + len(list_filter(opts, lambda o: regexp_matches(o, '(?is)^pwl[(].*[)]$') AND (len({_LIST_ITEMS}) = 0 OR len({_LIST_ITEMS}) % 2 = 1))) AS miscounted,
      len(list_filter(opts, lambda o: NOT CASE WHEN regexp_matches(o, '(?is)^(pulse|pwl)[(].*[)]$') THEN len(list_filter({_LIST_ITEMS}, lambda z: NOT regexp_full_match(z, '{_VAL}'))) = 0
        ELSE regexp_full_match(o, '(?is)static_value={_VAL}|inst="(?:[^"]|"")*"') END)) AS odd FROM l3),
  judged AS (SELECT *, CASE WHEN NOT paired THEN 'quoting'
      WHEN (kind = 'ckt' AND len(f) <> 4) OR (kind = 'nd' AND len(f) <> 6) OR len(f) < 4 OR miscounted > 0 THEN 'column_count'
      WHEN kind = 'nd' AND NOT (regexp_full_match(f[1], '{_NOD}') AND regexp_full_match(f[2], '{_VAL}') AND regexp_full_match(f[3], '{_VAL}') AND regexp_full_match(f[4], '{_VAL}') AND regexp_full_match(f[5], '{_VAL}')
        AND regexp_full_match(f[6], '[A-Za-z][A-Za-z0-9_]*')) THEN 'bad_value'
      WHEN kind <> 'nd' AND NOT (regexp_matches(f[1], CASE kind WHEN 'sp' THEN '^[iI]' ELSE '^[rRcClL]' END) AND regexp_full_match(f[2], '{_NOD}') AND regexp_full_match(f[3], '{_NOD}') AND regexp_full_match(f[4], '{_VAL}')) THEN 'bad_value'
      WHEN kind = 'ckt' AND TRY_CAST(regexp_extract(f[4], '^({_NUM})', 1) AS DOUBLE) < 0 OR odd > 0 THEN 'bad_value' END AS reason FROM l4)"""

SQL = {
    "p2_found": f"WITH {_POINTS} SELECT source_id, CAST(step AS INTEGER) AS step FROM grid WHERE n_readings = 0",
    "p2_series": f"""WITH {_POINTS},
  f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY step) AS filled, count(value) OVER (PARTITION BY source_id) AS readings FROM grid)
SELECT source_id, CAST(step AS INTEGER) AS step, n_readings, value, filled,
       CASE WHEN n_readings > 0 THEN 'read' WHEN filled IS NOT NULL THEN 'carried' WHEN readings > 0 THEN 'before_first' ELSE 'no_readings' END AS mark FROM f""",
    "p3_found": f"WITH lines AS (SELECT * FROM netlist_lines), {_JUDGED} SELECT DISTINCT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_stats": f"""WITH lines AS (SELECT DISTINCT * FROM netlist_lines), {_JUDGED},
  counts AS (SELECT design_id, count(*) FILTER (kind <> 'nd') AS elements_total, count(*) FILTER (kind <> 'nd' AND reason IS NOT NULL) AS elements_removed, count(*) FILTER (kind = 'nd' AND reason IS NOT NULL) AS nodes_removed FROM judged GROUP BY 1),
  files AS (SELECT DISTINCT design_id, regexp_extract(file_name, '^(.*)[.]([A-Za-z]+)$', 1) AS tile, lower(regexp_extract(file_name, '[.]([A-Za-z]+)$', 1)) AS kind FROM lines),
  tiles AS (SELECT c.design_id, count(n.tile) AS tiles_parsed, count(*) - count(n.tile) AS tiles_failed FROM files c LEFT JOIN files n ON n.design_id = c.design_id AND n.tile = c.tile AND n.kind = 'nd' WHERE c.kind = 'ckt' GROUP BY 1)
SELECT design_id, coalesce(elements_total, 0) AS elements_total, coalesce(elements_removed, 0) AS elements_removed, coalesce(nodes_removed, 0) AS nodes_removed, coalesce(tiles_parsed, 0) AS tiles_parsed, coalesce(tiles_failed, 0) AS tiles_failed
FROM counts FULL JOIN tiles USING (design_id)""",
    "p3_loaded": rf"""WITH lines AS (SELECT * FROM netlist_lines), {_JUDGED}, good AS (SELECT *, CASE WHEN kind <> 'nd' THEN f[4] END AS raw_value FROM judged WHERE reason IS NULL)
SELECT line_id, design_id, file_name, line_no, kind, CASE WHEN kind <> 'nd' THEN f[1] END AS name, CASE kind WHEN 'nd' THEN f[1] ELSE f[2] END AS u, CASE WHEN kind <> 'nd' THEN f[3] END AS v,
  CASE lower(raw_value) WHEN 'vdd' THEN 0.75::DOUBLE WHEN 'vss' THEN 0.0::DOUBLE ELSE CAST(nullif(regexp_extract(raw_value, '^({_NUM})', 1), '') AS DOUBLE)
    * CASE lower(regexp_replace(raw_value, '^{_NUM}', '')) {" ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in SCALE.items())} ELSE 1.0::DOUBLE END END AS value,
  CASE kind WHEN 'nd' THEN f[6] END AS net,
  list_transform(opts, lambda o: CASE WHEN regexp_matches(o, '(?is)^(pulse|pwl)[(].*[)]$') THEN regexp_extract(o, '^([A-Za-z]+[(])', 1) || array_to_string({_LIST_ITEMS}, ',') || ')' ELSE o END) AS options FROM good""",
}
