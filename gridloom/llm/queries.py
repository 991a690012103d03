"""Registered queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.readings import current_readings
from ..session import Scratch, table
from .corpus_ids import decode_corpus, encode_corpus, tokenizer_path
from .islands import hash_to_min
from .packing import pack
from .percentiles import multi_select
from .subjects import subjects_of
from .top_n import RUNS, merge_runs, sorted_runs


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten worst nodes of every net of every run."""
    group = ["run_id", "net_name"]
    readings = current_readings(table(spark, sf_dir, "solve_drops"), group, parts=RUNS)
    runs = Scratch(spark).write(sorted_runs(readings, group, "ir_drop", "node", 10, "_salt"))
    return merge_runs(runs, group, 10, "drop_rank").select("run_id", "net_name", "drop_rank", F.col("item").alias("node"))


def node_key(c):
    """One leading ``*`` and the case of the layer's M make no difference to a node's name."""
    bare = F.when(c.startswith("*"), c.substr(F.lit(2), F.length(c))).otherwise(c)
    return F.when(bare.contains("_m"), F.regexp_replace(bare, "^([0-9]+_[0-9]+_)m([0-9])$", "$1M$2")).otherwise(bare)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of grid_nodes with the smallest node_id that resistive elements link it to."""
    nodes = table(spark, sf_dir, "grid_nodes").select("node_id", "design_id", node_key(F.col("node")).alias("name"))
    elements = table(spark, sf_dir, "grid_elements").filter((F.upper(F.trim("elem_type")) == "R") & F.col("elem_value").isNotNull())
    inner = elements.filter(~F.col("u").isin("0", "*0") & ~F.col("v").isin("0", "*0"))
    ends = inner.select("design_id", node_key(F.col("u")).alias("u"), node_key(F.col("v")).alias("v"))
    at_u = nodes.select("design_id", F.col("name").alias("u"), F.col("node_id").alias("a"))
    at_v = nodes.select("design_id", F.col("name").alias("v"), F.col("node_id").alias("b"))
    links = ends.join(at_u, ["design_id", "u"]).join(at_v, ["design_id", "v"]).select("a", "b")
    return hash_to_min(nodes.select(F.col("node_id").alias("id")), links, known=True).select(F.col("id").alias("node_id"), F.col("group_id").alias("island_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50th, 95th and 99th percentile of the drop for every net and layer, as bins of a tenth."""
    readings = current_readings(table(spark, sf_dir, "solve_drops"), ["net_name"], ["layer"], min_rows=50_000)
    from_name = F.regexp_extract("node", "^[0-9]+_[0-9]+_([A-Za-z][A-Za-z0-9]*)$", 1)
    layer = F.upper(F.coalesce("layer", F.when(from_name != "", from_name)))
    found = multi_select(readings.withColumn("layer", layer), ["net_name", "layer"], "ir_drop", [50, 95, 99], 100)
    return found.select("net_name", "layer", "pct", F.floor(F.log(F.col("value") * 1000000) / F.log(F.lit(1.1))).cast("int").alias("drop_bin"))


def _ranks(spark: SparkSession) -> str:
    return f"{tokenizer_path(spark)}/byte_bpe_50k.tiktoken"


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as its list of token ids by byte_bpe_50k; an empty and a NULL text have the empty list."""
    return encode_corpus(table(spark, sf_dir, "documents"), _ranks(spark))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: every text again from its ids."""
    return decode_corpus(p6_ids(spark, sf_dir), _ranks(spark))


def _packed(spark: SparkSession, sf_dir: str, **limits) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    sizes = Scratch(spark).write(encode_corpus(table(spark, sf_dir, "documents"), _ranks(spark), counts_only=True))
    windows = [(r.window_id, r.capacity_tokens) for r in table(spark, sf_dir, "context_windows").select("window_id", "capacity_tokens").collect()]
    return pack(sizes, windows, **limits), sizes, windows


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts put into the context windows of each capacity."""
    return _packed(spark, sf_dir)[0]


#: Documents of a window at most, and attention cost as a share of the square of its capacity, where these are to bind.
MAX_ITEMS, COST_SHARE = 6, 0.4


def p7_limited_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with few documents a window and a bounded attention cost."""
    return _packed(spark, sf_dir, max_items=MAX_ITEMS, cost_share=COST_SHARE)[0]


def p7_limited_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p7_limited_windows, for each capacity: all documents and tokens are there, no window is over a limit (but for a single item), nothing is divided that fits."""
    rows, sizes, windows = _packed(spark, sf_dir, max_items=MAX_ITEMS, cost_share=COST_SHARE)
    rows = Scratch(spark).write(rows)
    cap = F.create_map(*[F.lit(x) for kv in windows for x in kv])
    squares = F.sum(F.col("n_tokens").cast("double") ** 2)
    bins = rows.groupBy("window_id", "bin_id").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("items"), squares.alias("cost")).withColumn("cap", F.try_element_at(cap, F.col("window_id")))
    n = lambda test: F.count(F.when(test, 1))
    of_bins = bins.groupBy("window_id").agg(
        n(F.col("size") > F.col("cap")).alias("overfull"), n(F.col("items") > MAX_ITEMS).alias("over_items"),
        n((F.col("items") > 1) & (F.col("cost") > F.col("cap").cast("double") ** 2 * COST_SHARE * (1 + 1e-9))).alias("over_cost"),
    )
    docs = rows.groupBy("window_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces")).join(sizes.select("doc_id", F.col("n_tokens").alias("size")), "doc_id")
    docs = docs.withColumn("cap", F.try_element_at(cap, F.col("window_id")))
    of_docs = docs.groupBy("window_id").agg(F.count(F.lit(1)).alias("documents"), n(F.col("got") != F.col("size")).alias("lost"), n((F.col("pieces") > 1) & (F.col("size") <= F.col("cap"))).alias("divided"))
    return of_docs.join(of_bins, "window_id").select("window_id", "documents", "lost", "divided", "overfull", "over_items", "over_cost")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects on which each page has a paragraph."""
    names = [r.subject for r in table(spark, sf_dir, "subjects").orderBy("subject_id").collect()]
    return subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), names)


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p5_found, p6_ids, p6_decoded, p7_windows, p7_limited_windows, p7_limited_checks, p8_found)}

_RULE_R = """
  r0 AS (SELECT *, upper(trim(net_name)) AS net FROM solve_drops),
  r1 AS (SELECT *, row_number() OVER (PARTITION BY run_id, net, node ORDER BY ingested_at DESC NULLS LAST, drop_id DESC) AS rn FROM r0
         WHERE run_id IS NOT NULL AND net IS NOT NULL AND node IS NOT NULL),
  r AS (SELECT run_id, net, node, layer, ir_drop FROM r1 WHERE rn = 1 AND ir_drop IS NOT NULL AND NOT isnan(ir_drop))"""

SQL = {
    "p7_limited_checks": """SELECT window_id, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS lost, 0 AS divided, 0 AS overfull, 0 AS over_items, 0 AS over_cost FROM context_windows""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p1_found": f"""WITH {_RULE_R}
SELECT run_id, net AS net_name, CAST(k AS INTEGER) AS drop_rank, node
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, net ORDER BY ir_drop DESC, node) AS k FROM r) WHERE k <= 10""",
    "p4_found": r"""WITH RECURSIVE
  n AS (SELECT node_id, design_id, regexp_replace(regexp_replace(node, '^\*', ''), '^([0-9]+_[0-9]+_)m([0-9])$', '\1M\2') AS name FROM grid_nodes),
  e AS (SELECT design_id, regexp_replace(regexp_replace(u, '^\*', ''), '^([0-9]+_[0-9]+_)m([0-9])$', '\1M\2') AS u,
               regexp_replace(regexp_replace(v, '^\*', ''), '^([0-9]+_[0-9]+_)m([0-9])$', '\1M\2') AS v
        FROM grid_elements WHERE upper(elem_type) = 'R' AND elem_value IS NOT NULL),
  l AS (SELECT DISTINCT a.node_id AS x, b.node_id AS y FROM e JOIN n a ON a.design_id = e.design_id AND a.name = e.u
        JOIN n b ON b.design_id = e.design_id AND b.name = e.v),
  two AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
  reach(x, least) USING KEY (x) AS (
    SELECT node_id, node_id FROM n
    UNION
    SELECT t.y, min(r.least) FROM reach r JOIN two t ON t.x = r.x JOIN recurring.reach o ON o.x = t.y
    WHERE r.least < o.least GROUP BY t.y)
SELECT x AS node_id, least AS island_id FROM reach""",
    "p5_found": rf"""WITH {_RULE_R},
  g AS (SELECT net, upper(coalesce(layer, nullif(regexp_extract(node, '^[0-9]+_[0-9]+_([A-Za-z][A-Za-z0-9]*)$', 1), ''))) AS l, ir_drop FROM r),
  o AS (SELECT *, row_number() OVER (PARTITION BY net, l ORDER BY ir_drop) AS k, count(*) OVER (PARTITION BY net, l) AS n FROM g WHERE l IS NOT NULL),
  p AS (SELECT unnest([50, 95, 99]) AS pct)
SELECT net AS net_name, l AS layer, CAST(pct AS INTEGER) AS pct, CAST(floor(ln(ir_drop * 1000000) / ln(1.1::DOUBLE)) AS INTEGER) AS drop_bin
FROM o, p WHERE n >= 100 AND k = (n * pct + 99) // 100""",
}
