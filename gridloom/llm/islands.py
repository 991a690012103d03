"""Consolidating pairwise matches into groups: hash-to-min over rows, without the vertices and groups that are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.skew import hot_keys, with_salt
from ..session import Scratch

#: Rows up to which a table of vertices is broadcast; rows of one vertex, two integers each, that make up a partition of Spark's advised 64 MB.
BROADCAST_ROWS, PARTITION_ROWS = 50_000, 4_000_000


def _pair(v: str, u: str) -> Column:
    return F.struct(F.col(v).alias("v"), F.col(u).alias("u"))


class _Clusters:
    """One round's rows (v, u, m): members u of v's cluster, with its least member m."""

    def __init__(self, scratch: Scratch, min_rows: int):
        self.scratch, self.min_rows = scratch, min_rows

    def gather(self, sent: DataFrame, rows: int, first: bool = False) -> tuple[DataFrame, int, int]:
        """The clusters that rows (v, u) make, written, and how many rows of inner and of least vertices they have.

        Vertices with very many rows are dealt to salts; their minima are put together afterwards. A vertex that knows
        nothing but another one, its leaf, is left out: its minimum holds it.
        """
        hot = hot_keys(sent.select("v"), ["v"], self.min_rows) if rows > self.min_rows else None
        place = ["v"] if hot is None else ["v", "_salt"]
        met = (sent if hot is None else with_salt(sent, ["v"], ["u"], hot)).repartition(*place).dropDuplicates([*place, "u"])
        w = Window.partitionBy(*place)
        known = met.withColumn("m", F.min("u").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
        if first:
            # Every vertex is in its own cluster.
            known = known.withColumn("_at", F.row_number().over(w.orderBy("u"))).withColumn("m", F.least("m", "v"))
            known = known.select(*place, "m", (F.col("n") + 1).alias("n"), F.explode(F.when(F.col("_at") == 1, F.array("u", "v")).otherwise(F.array("u"))).alias("u"))
        if hot is None:
            known = known.filter("n > 1 OR m = v").select("v", "u", "m")
            out, (inner, least) = self.scratch.write_and_sum(known, *self.kinds())
            return out, inner or 0, least or 0
        known = known.join(F.broadcast(hot), "v", "left").filter("n > 1 OR m = v OR _parts IS NOT NULL")
        out = self.scratch.write(known.select("v", "u", "m", F.col("_parts").isNotNull().alias("hot")))
        minima = self.scratch.write(out.filter("hot").groupBy("v").agg(F.min("m").alias("_m")))  # at most skew.MAX_HOT rows
        out = self.scratch.write(out.join(F.broadcast(minima), "v", "left").select("v", "u", F.coalesce("_m", "m").alias("m")))
        inner, least = out.agg(*self.kinds()).first()
        return out, inner or 0, least or 0

    @staticmethod
    def kinds() -> list[Column]:
        return [F.sum(F.when(F.col("v") != F.col("m"), 1).otherwise(0)), F.sum(F.when(F.col("v") == F.col("m"), 1).otherwise(0))]


def hash_to_min(vertices: DataFrame, links: DataFrame, min_rows: int = PARTITION_ROWS, max_rounds: int = 200, known: bool = False) -> DataFrame:
    """Each vertex with the least vertex that is linked to it directly or indirectly: id, group_id.

    ``vertices``: id BIGINT. ``links``: a, b BIGINT. A link with a NULL end, or an end that is no vertex, links nothing;
    repeated links, links to itself and either direction make no difference. NULL ids are no vertices, repeated ids are
    one. A vertex without links is its own group. ``known`` says that all ends are vertices, so they aren't looked up.

    Each round every vertex sends its cluster to the cluster's least member, and that member to all others, until no
    cluster changes. A vertex that knows only its minimum sends nothing, as the minimum holds it. A group is settled
    when all members of its least vertex know nothing else; settled groups are set aside when the rows of unsettled
    vertices have halved. Vertices of more than ``min_rows`` rows are dealt to salts. When no vertex but the least of each group holds a cluster, everything is settled. One
    exchange a round.
    """
    scratch = Scratch(vertices.sparkSession)
    ids = vertices.select(F.col("id").cast("long").alias("id")).dropna().distinct()
    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().filter("a <> b")
    if not known:
        pairs = pairs.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    clusters, done, asked = _Clusters(scratch, min_rows), [], None
    both, (rows,) = scratch.write_and_sum(pairs.select(F.explode(F.array(_pair("a", "b"), _pair("b", "a"))).alias("x")).select("x.*"), F.count(F.lit(1)))
    state, inner, least = clusters.gather(both, rows or 0, True)
    scratch.drop(both)
    for _ in range(max_rounds):
        if not inner:
            break
        old = state
        if inner * 2 < (asked or least):
            asked = inner
            # A member of a group that isn't settled knows the least vertex of that group, besides others.
            pending = old.filter("v <> m").select(F.col("u").alias("v")).distinct()
            pending = F.broadcast(pending) if inner <= BROADCAST_ROWS else pending
            roots = old.filter("v = m")
            done.append(scratch.write(roots.join(pending, "v", "left_anti").select(F.col("u").alias("id"), F.col("v").alias("least"))))
            state = old.filter("v <> m").unionByName(roots.join(pending, "v", "left_semi"))
        two = F.when(F.col("u") == F.col("m"), F.array(_pair("m", "u"))).otherwise(F.array(_pair("m", "u"), _pair("u", "m")))
        state, inner, least = clusters.gather(state.select(F.explode(two).alias("x")).select("x.*"), 2 * (inner + least))
        scratch.drop(old)
    else:
        raise RuntimeError(f"clusters still change after {max_rounds} rounds")
    found = state.select(F.col("u").alias("id"), F.col("v").alias("least"))
    for d in done:
        found = found.unionByName(d)
    return ids.join(found, "id", "left").select("id", F.coalesce("least", "id").alias("group_id"))
