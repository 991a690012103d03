"""Rule R: of all deliveries of a reading the latest counts, whatever it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import hot_keys, with_salt


def clean_net(c: str | Column) -> Column:
    return F.upper(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n")))


def current_readings(drops: DataFrame, spread_by: list[str], keep: list[str] = [], min_rows: int = 200_000, parts: int = 1) -> DataFrame:
    """The readings of ``solve_drops``: one row for each (run_id, net_name, node) with a usable ``ir_drop``.

    ``net_name`` is trimmed and in upper case. The row with the latest ``ingested_at`` counts (NULL is the earliest;
    equal times: the greater ``drop_id``); if its ``ir_drop`` is NULL or NaN there is no reading. Rows without run,
    net or node name no reading and are left out.

    The result is partitioned by ``spread_by`` (columns of the key) and a salt that splits the hot values of
    ``spread_by``, so one shuffle serves this step and a grouping by ``[*spread_by, "_salt"]`` after it. ``parts`` is the
    number of salts of an ordinary value.
    """
    key = ["run_id", "net_name", "node"]
    rows = drops.select("run_id", clean_net("net_name").alias("net_name"), "node", "ir_drop", "ingested_at", "drop_id", *keep)
    rows = rows.dropna(subset=key)
    rest = [k for k in key if k not in spread_by]
    hot = hot_keys(rows.select(*spread_by), spread_by, min_rows)
    salted = hot is not None or parts > 1
    place = [*spread_by, "_salt"] if salted else spread_by
    rows = with_salt(rows, spread_by, rest, hot, parts=parts) if salted else rows
    w = Window.partitionBy(*place, *rest).orderBy(F.desc_nulls_last("ingested_at"), F.desc_nulls_last("drop_id"), F.desc_nulls_last("ir_drop"))
    latest = rows.repartition(*place).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    drop = F.col("ir_drop")
    salt = F.col("_salt") if salted else F.lit(0)
    return latest.filter(drop.isNotNull() & ~F.isnan(drop)).select(*spread_by, salt.alias("_salt"), *rest, (drop + F.lit(0.0)).alias("ir_drop"), *keep)
