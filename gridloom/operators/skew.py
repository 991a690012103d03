"""Hot keys: found by a count that is combined before its shuffle, then spread over salts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

#: No table of hot keys can have more rows than this, as each of them holds more than 1/MAX_HOT of all rows.
MAX_HOT = 10_000


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = 200_000) -> DataFrame | None:
    """Keys that hold more than ``max(min_rows, rows / MAX_HOT)`` rows, with ``_parts``, the salts to spread each over.

    One pass over ``df``, combined before its shuffle. There are fewer than MAX_HOT such keys whatever the data, so the
    table may be broadcast, and the greatest MAX_HOT counts are enough to find them all. None if there are none.
    """
    seen = Observation()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.sum("_n").alias("total"))
    top = counts.filter(F.col("_n") > min_rows).orderBy(F.desc("_n")).limit(MAX_HOT).collect()
    if not top:
        return None
    limit = max(min_rows, seen.get["total"] // MAX_HOT)
    rows = [(*r[:-1], -(-r["_n"] // limit)) for r in top if r["_n"] > limit]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.sparkSession.createDataFrame(rows, f"{kinds}, _parts int") if rows else None


def with_salt(df: DataFrame, keys: list[str], spread: list[str], hot: DataFrame | None, salt: str = "_salt", parts: int = 1) -> DataFrame:
    """Adds a salt: a hash of ``spread`` modulo ``parts`` for ordinary keys, modulo the key's own parts times as many for hot ones."""
    if hot is None:
        return df.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int") if parts > 1 else F.lit(0))
    out = df.join(F.broadcast(hot), keys, "left")
    own = F.coalesce(F.col("_parts"), F.lit(1)) * parts
    return out.withColumn(salt, F.when(own > 1, F.pmod(F.xxhash64(*spread), own)).otherwise(0).cast("int")).drop("_parts")
