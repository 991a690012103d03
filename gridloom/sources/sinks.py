"""Results as text, JSON and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def worst_report(solution: DataFrame, k: int) -> DataFrame:
    """The k worst nodes as lines of fixed width: place, node, drop. Equal drops go by name."""
    top = solution.orderBy(F.desc("drop"), "node").limit(k).agg(F.sort_array(F.collect_list(F.struct((-F.col("drop")).alias("d"), "node"))).alias("rows"))
    rows = top.select(F.posexplode("rows").alias("k", "r"))
    return rows.select((F.col("k") + 1).alias("place"), F.col("r.node").alias("node"), F.format_string("%4d  %-24s %12d", F.col("k") + 1, F.col("r.node"), -F.col("r.d")).alias("line"))


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """One JSON object for each row, with its key."""
    return rows.select(key, F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("json"))


def as_nested_json(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The keys and one JSON object of the named fields for each row; structs and arrays nest, missing values are written as null."""
    return rows.select(*keys, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def write_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, partitioned by the given columns; rows of one partition are brought together first, so each gets few files."""
    out = rows.repartition(*by) if by else rows
    (out.write.mode("overwrite").partitionBy(*by) if by else out.write.mode("overwrite")).parquet(path)
