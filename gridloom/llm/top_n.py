"""Top N items within every group: bucketed sorted runs, merged by a loser tree that seeks to the next group after N outputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

#: Runs that an ordinary group is cut into; blocks of a bucket, about.
RUNS, BUCKET = 4, 10_000


def sorted_runs(df: DataFrame, group: list[str], score: str, item: str, n: int, run: str) -> DataFrame:
    """Runs of each group, each ordered by score (greatest first) and then by item (smallest first, byte order).

    ``run`` names the column that splits a group into runs; if ``df`` is partitioned by ``[*group, run]`` nothing is
    shuffled. No run needs more than its first ``n`` entries. Rows whose score is NULL or NaN have no rank and are
    left out, as are rows without an item; repeated rows keep their places. Result: group, _run, ``entries`` (an array
    of structs score, item), one block for each group of a run; it can be written and merged with other runs later.
    """
    rows = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score)) & F.col(item).isNotNull())
    rows = rows.select(*group, F.col(run).alias("_run"), F.col(score).cast("double").alias("_score"), F.col(item).alias("_item"))
    w = Window.partitionBy(*group, "_run").orderBy(F.desc("_score"), F.asc("_item"))
    top = rows.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= n)
    packed = top.groupBy(*group, "_run").agg(F.array_sort(F.collect_list(F.struct("_at", "_score", "_item"))).alias("e"))
    return packed.select(*group, "_run", F.transform("e", lambda x: F.struct(x["_score"].alias("score"), x["_item"].alias("item"))).alias("entries"))


class Run:
    """A sorted run: entries (group, -score, item) in this order, and where each of its groups ends."""

    def __init__(self, groups: list[int], sizes: list[int], scores: list[float], items: list):
        self.keys = [(g, s, x) for g, s, x in zip(np.repeat(groups, sizes).tolist(), scores, items)]
        self.ends = dict(zip(groups, np.cumsum(sizes).tolist()))
        self.at = 0

    def head(self):
        return self.keys[self.at] if self.at < len(self.keys) else None

    def seek(self, group: int) -> bool:
        """Past all that is left of a group; False if the head was beyond it."""
        x = self.head()
        if x is None or x[0] != group:
            return False
        self.at = self.ends[group]
        return True


class LoserTree:
    """Merges sorted runs: each inner place holds the run that lost there, so one output costs one walk to the root."""

    def __init__(self, runs: list[Run]):
        self.runs, self.k = runs, max(1, len(runs))
        self._build()

    def _build(self) -> None:
        self.heads = [r.head() for r in self.runs]
        self.tree = [-1] * self.k
        for r in range(len(self.runs)):
            self._climb(r)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def _climb(self, r: int) -> None:
        """From a run's leaf to the root; while the tree is built, the first to reach a free place waits there."""
        place = (r + self.k) // 2
        while place > 0:
            other = self.tree[place]
            if other < 0:
                self.tree[place] = r
                return
            if self._beats(other, r):
                self.tree[place], r = r, other
            place //= 2
        self.tree[0] = r

    def head(self):
        return self.heads[self.tree[0]] if self.runs else None

    def pop(self):
        """The least head of all runs, or None."""
        r = self.tree[0]
        x = self.heads[r] if self.runs else None
        if x is not None:
            self.runs[r].at += 1
            self.heads[r] = self.runs[r].head()
            self._climb(r)
        return x

    def seek(self, group: int) -> None:
        """Leaves a group: every run that stands in it goes to its next one."""
        if any([r.seek(group) for r in self.runs]):
            self._build()


def _merge(runs: list[Run], n: int) -> Iterator[tuple[int, int, float, object]]:
    """group, rank, -score, item of the first ``n`` entries of every group."""
    tree, group, rank = LoserTree(runs), None, 0
    while (x := tree.pop()) is not None:
        group, rank = x[0], rank + 1 if x[0] == group else 1
        yield group, rank, x[1], x[2]
        if rank == n:
            tree.seek(group)


def merge_runs(runs: DataFrame, group: list[str], n: int, rank: str = "rank", buckets: int | None = None) -> DataFrame:
    """The first ``n`` entries of each group over all its runs, as columns group, rank (from 1), item, score.

    Groups are dealt to ``buckets`` by a hash (by default one for each BUCKET blocks, counted, so ``runs`` should be
    written before); a task holds the blocks of one bucket, at most ``n`` entries each, and merges its runs. Runs of
    several days can be united before: blocks of a group with equal ``_run`` are put in different runs. Empty runs give
    an empty result; a NULL group is a group.
    """
    kind = runs.schema["entries"].dataType.elementType["item"].dataType.simpleString()
    buckets = buckets or max(1, -(-runs.count() // BUCKET))
    again = Window.partitionBy("_bucket", *group, "_run").orderBy(F.lit(1))
    placed = runs.select(F.pmod(F.xxhash64(*group), F.lit(buckets)).cast("int").alias("_bucket"), *group, "_run", "entries").repartition("_bucket")
    placed = placed.withColumn("_again", F.row_number().over(again))

    def merge(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        code = np.zeros(t.num_rows, np.int64)  # groups by number, in the order of their first block
        for c in group:
            d = t.column(c).combine_chunks().dictionary_encode("encode")
            d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
            code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        first = np.unique(code, return_index=True)[1]
        number = np.unique(np.stack([pc.fill_null(pc.cast(t.column(c), pa.int64()), -1).to_numpy() for c in ("_again", "_run")]), axis=1, return_inverse=True)[1].ravel()
        order = np.lexsort((code, number))
        lists = t.column("entries").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lists = lists.take(pa.array(order))
        number, code, size = number[order], code[order], pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        score, item = pc.negate(flat.field("score")).to_pylist(), flat.field("item").to_pylist()
        cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
        at = np.r_[0, np.cumsum(size)]
        made = [Run(code[a:b].tolist(), size[a:b].tolist(), score[at[a] : at[b]], item[at[a] : at[b]]) for a, b in zip(cut[:-1], cut[1:])]
        out = list(_merge(made, n))
        g, k, s, x = zip(*out) if out else ((), (), (), ())
        keys = t.select(group).take(pa.array(first[np.array(g, np.int64)]))
        return keys.append_column(rank, pa.array(k, pa.int32())).append_column("item", pa.array(x, flat.field("item").type)).append_column("score", pa.array(-np.array(s, float)))

    kinds = ", ".join(f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in group)
    return placed.groupBy("_bucket").applyInArrow(merge, f"{kinds}, `{rank}` int, `item` {kind}, `score` double")
