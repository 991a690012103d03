"""Nearest ports over paths of any length, against Dijkstra's method."""

import heapq
from collections import defaultdict
from pathlib import Path

import pytest

from gridloom.operators import graph as g
from gridloom.plans.queries import QUERIES
from gridloom.plans.registry import Tables
from gridloom.plans.views import thin


def nearest(rows, ports, k, r_max=float("inf")):
    links, best = defaultdict(list), defaultdict(dict)
    for u, v, r in rows:
        links[u].append((v, r))
        links[v].append((u, r))
    heap = [(0, p, p) for p in ports]
    heapq.heapify(heap)
    while heap:
        d, p, x = heapq.heappop(heap)
        if p in best[x] or len(best[x]) >= k:
            continue
        best[x][p] = d
        for y, r in links[x]:
            if d + r <= r_max:
                heapq.heappush(heap, (d + r, p, y))
    return {(x, p, d) for x, own in best.items() for p, d in own.items()}


def test_paths_of_many_links(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 1) for i in range(20)] + [("n00", "n12", 50)]
    ports = ["n00", "n20"]
    edges = spark.createDataFrame(chain, "u string, v string, r bigint")
    named = spark.createDataFrame([(p,) for p in ports], "node string")
    for k, r_max in ((1, float("inf")), (2, float("inf")), (2, 9.0)):
        assert {tuple(r) for r in g.nearest_ports(edges, named, k, r_max).select("node", "port", "r").collect()} == nearest(chain, ports, k, r_max)
    with pytest.raises(RuntimeError):
        g.nearest_ports(edges, named, 1, float("inf"), 6)
    assert g.nearest_ports(edges, named.filter("false"), 1, float("inf")).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_shortest_resistance(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    ports = ["c" + str(r[0]) for r in t.customer.filter("c_custkey % 300 = 11").select("c_custkey").collect()]
    want = {(x, d) for x, _, d in nearest([tuple(r) for r in thin(t).collect()], ports, 1)}
    assert {(r.node, r.r) for r in QUERIES["shortest_resistance"](spark, t.dir).collect()} == want
