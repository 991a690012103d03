"""Filling fixed-capacity containers: best fit over several capacities at once, in shards whose open containers are merged afterwards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch

#: Items or open containers of one group, about; classes of residual tokens; containers with room kept for each one that is at most half full.
GROUP, CLASSES, OFFERED = 4096, 64, 4
#: Weights of the residual token, document-count and attention-cost capacities.
WEIGHTS = np.array([1.0, 0.02, 0.02])


class _Shelves:
    """Open containers by class of residual tokens: their residual capacities and numbers."""

    def __init__(self):
        self.free = [np.empty((4, 3)) for _ in range(CLASSES)]
        self.number = [np.empty(4, np.int64) for _ in range(CLASSES)]
        self.used = [0] * CLASSES

    def add(self, left: np.ndarray, number: int) -> None:
        c = min(CLASSES - 1, int(left[0] * CLASSES))
        k = self.used[c]
        if k == len(self.free[c]):
            self.free[c], self.number[c] = np.concatenate([self.free[c]] * 2), np.concatenate([self.number[c]] * 2)
        self.free[c][k], self.number[c][k], self.used[c] = left, number, k + 1

    def take(self, need: np.ndarray) -> tuple[np.ndarray, int] | None:
        """Takes out the container that the need fits under every capacity and that then has the least weighted norm of
        residuals. A class is looked at only while its least residual could still give a smaller norm."""
        best, where = np.inf, None
        for c in range(min(CLASSES - 1, int(max(0.0, need[0] - 1e-9) * CLASSES)), CLASSES):
            k = self.used[c]
            if not k:
                continue
            if where and max(0.0, c / CLASSES - need[0]) ** 2 * WEIGHTS[0] >= best:
                break
            left = self.free[c][:k] - need
            norm = np.where((left >= -1e-12).all(1), (left * left) @ WEIGHTS, np.inf)
            j = int(norm.argmin())
            if norm[j] < best:
                best, where = norm[j], (c, j)
        if where is None:
            return None
        c, j = where
        left, number, k = np.maximum(self.free[c][j] - need, 0.0), int(self.number[c][j]), self.used[c] - 1
        self.free[c][j], self.number[c][j], self.used[c] = self.free[c][k], self.number[c][k], k
        return left, number


def best_fit(size: np.ndarray, count: np.ndarray, cost: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """A container number for each item. Items come by size, greatest first; each goes to the container that it fits
    under every capacity and that then has the least weighted norm of residual capacities, or to a new one."""
    need = np.stack([size, count, cost], 1).astype(float) / capacity
    least = need.min(0) if len(need) else need
    out, shelves, made = np.empty(len(size), np.int64), _Shelves(), 0
    for i in np.lexsort((count, -size)):
        left, number = shelves.take(need[i]) or (1 - need[i], -1)
        if number < 0:
            number, made = made, made + 1
        out[i] = number
        if (left >= least - 1e-12).all():  # else nothing fits any more
            shelves.add(left, number)
    return out


def _by_window(values: dict[int, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("window_id"))


def _merge_level(bins: DataFrame, limits: dict[int, tuple], level: int) -> tuple[DataFrame, int, int] | None:
    """window_id, bin, into of the containers that take part in a level; how many at most half full ones there were, and in how many groups; None if no two containers can merge.

    Of two containers that merge, one is at most half full, and neither is fuller than the least container of its
    window allows. Those at most half full all take part; of the others, OFFERED for each of them, with the most room
    (all that are equal at the limit). They are dealt to groups of about GROUP by a hash.
    """
    cap = _by_window({w: c[0] for w, c in limits.items()})
    low = {r.window_id: r for r in bins.groupBy("window_id").agg(F.min("size").alias("size"), F.min("items").alias("items"), F.min("cost").alias("cost")).collect()}
    if not low:
        return None
    room = F.lit(True)
    for k, c in enumerate(("size", "items", "cost")):
        room = room & (F.col(c) + _by_window({w: float(r[c]) for w, r in low.items()}) <= _by_window({w: limits[w][k] for w in low}))
    able = bins.filter(room).withColumn("half", F.col("size") * 2 <= cap)
    count = {r.window_id: (r.movers, r.others) for r in able.groupBy("window_id").agg(F.count(F.when(F.col("half"), 1)).alias("movers"), F.count(F.when(~F.col("half"), 1)).alias("others")).collect() if r.movers and r.movers + r.others > 1}
    if not count:
        return None
    able = able.filter(F.col("window_id").isin(list(count)))
    many = {w: min(1.0, OFFERED * m / n) for w, (m, n) in count.items() if n}
    limit = {w: limits[w][0] for w in count}
    for w, share in many.items():
        if share < 1:
            limit[w] = float(able.filter((F.col("window_id") == w) & ~F.col("half")).agg(F.percentile_approx("size", share, 10_000)).first()[0])
    able = able.filter(F.col("half") | (F.col("size") <= _by_window(limit)))
    groups = {r.window_id: -(-r["count"] // GROUP) for r in able.groupBy("window_id").count().collect()}

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        at = best_fit(pdf["size"].to_numpy(), pdf["items"].to_numpy(), pdf["cost"].to_numpy(), np.array(limits[int(pdf.window_id.iloc[0])]))
        return pdf.assign(into=[f"m{level}.{g}.{b}" for g, b in zip(pdf["group"], at)])[["window_id", "bin", "into"]]

    dealt = able.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(level)), _by_window(groups)).cast("int"))
    return dealt.groupBy("window_id", "group").applyInPandas(again, "window_id int, bin string, into string"), sum(m for m, _ in count.values()), max(groups.values())


def pack(items: DataFrame, containers: list[tuple[int, int]], max_items: int | None = None, cost_share: float | None = None) -> DataFrame:
    """Items put into containers of each capacity: window_id, bin_id STRING, doc_id, piece INT, start INT, n_tokens INT.

    ``items``: doc_id (unique), n_tokens; items without tokens (NULL, zero or less) are left out. ``containers``: the
    fixed list of (window_id, capacity). Only an item above the capacity is divided: into full pieces, each a container,
    and a rest that is packed like any item. A container holds ``max_items`` items at most and an attention cost, the
    sum of the squares of their tokens, of ``cost_share`` of the capacity's square at most (both by default never bind);
    an item that alone costs more has a container of its own.

    Shards of about GROUP items are packed apart; then containers that can still merge are, in groups of about GROUP
    containers, until they fit one group or a level no longer finds much. No task holds more than about GROUP rows.
    """
    spark, scratch = items.sparkSession, Scratch(items.sparkSession)
    whole = scratch.write(items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("int").alias("n_tokens")).filter("n_tokens > 0 AND doc_id IS NOT NULL"))
    limits = {w: (float(c), float(max_items or c), float(c) * c * (cost_share or 1.0)) for w, c in containers if c and c > 0}
    if not limits:
        return spark.createDataFrame([], "window_id int, bin_id string, doc_id bigint, piece int, start int, n_tokens int")
    each = F.explode(F.array(*[F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(int(c[0])).cast("int").alias("cap")) for w, c in limits.items()]))
    rows = whole.select("doc_id", "n_tokens", each.alias("w")).select("doc_id", "n_tokens", "w.*")
    full = F.expr("n_tokens div cap").cast("int")
    pieces = rows.filter("n_tokens > cap").select("window_id", "doc_id", "cap", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    filled = pieces.select("window_id", F.concat_ws(".", F.lit("d"), "doc_id", "piece").alias("bin_id"), "doc_id", "piece", (F.col("piece") * F.col("cap")).cast("int").alias("start"), F.col("cap").alias("n_tokens"))
    over = F.col("n_tokens") > F.col("cap")
    rest = rows.select(
        "window_id", "doc_id", F.when(over, full).otherwise(0).cast("int").alias("piece"), F.when(over, full * F.col("cap")).otherwise(0).cast("int").alias("start"),
        F.when(over, F.col("n_tokens") - full * F.col("cap")).otherwise(F.col("n_tokens")).cast("int").alias("n_tokens"),
    ).filter("n_tokens > 0")
    shards = max(1, -(-whole.count() // GROUP))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf.n_tokens.to_numpy()
        at = best_fit(size, np.ones(len(size)), size.astype(float) ** 2, np.array(limits[int(pdf.window_id.iloc[0])]))
        return pdf.assign(bin=[f"s{s}.{b}" for s, b in zip(pdf.shard, at)])[["window_id", "bin", "doc_id", "piece", "start", "n_tokens"]]

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    packed = rest.select("*", shard).groupBy("window_id", "shard").applyInPandas(first, "window_id int, bin string, doc_id long, piece int, start int, n_tokens int")
    packed = scratch.write(packed)
    bins = scratch.write(packed.groupBy("window_id", "bin").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("items"), F.sum(F.col("n_tokens").cast("double") ** 2).alias("cost")))
    moved, level, before = None, 0, None
    while True:
        made = _merge_level(bins, limits, level)
        if made is None or (before and made[1] > 0.9 * before):
            break
        into, before, groups = scratch.write(made[0]), made[1], made[2]
        merged = bins.join(into, ["window_id", "bin"], "left").groupBy("window_id", F.coalesce("into", "bin").alias("bin"))
        bins = scratch.write(merged.agg(F.sum("size").alias("size"), F.sum("items").alias("items"), F.sum("cost").alias("cost")))
        if moved is None:
            moved = into
        else:
            step = into.select("window_id", F.col("bin").alias("into"), F.col("into").alias("_next"))
            known = moved.join(step, ["window_id", "into"], "left").select("window_id", "bin", F.coalesce("_next", "into").alias("into"))
            moved = scratch.write(known.unionByName(into.join(known.select("window_id", F.col("bin")), ["window_id", "bin"], "left_anti").filter(~F.col("bin").startswith("m"))))
        level += 1
        if groups == 1:
            break
    if moved is not None:
        packed = packed.join(moved, ["window_id", "bin"], "left").withColumn("bin", F.coalesce("into", "bin"))
    return filled.unionByName(packed.select("window_id", F.col("bin").alias("bin_id"), "doc_id", "piece", "start", "n_tokens"))
