"""Tiles linked to ports, against searches in plain Python."""

import random
from collections import deque
from pathlib import Path

import pytest

from gridloom.operators import graph as g, relational as rel
from gridloom.plans import q_graph
from gridloom.plans.queries import QUERIES
from gridloom.plans.q_relational import layer_split_ports
from gridloom.plans.registry import Tables


def search(start, links, allowed):
    hops, queue = {x: 0 for x in start}, deque(start)
    while queue:
        x = queue.popleft()
        for y in links.get(x, ()):
            if y not in hops and y in allowed:
                hops[y] = hops[x] + 1
                queue.append(y)
    return hops


def want(edges, members, ports, inner):
    links = {}
    for u, v in edges:
        if u != v:
            links.setdefault(u, set()).add(v)
            links.setdefault(v, set()).add(u)
    hops, out = search(ports, links, ports | inner), set()
    for tile in {m[0] for m in members}:
        role = {n: r for k, n, r in members if k == tile}
        own = {n for n, r in role.items() if r == "port"}
        seen, added = search(own, links, set(role)), {}
        for x in [n for n, r in role.items() if r == "core" and n not in seen and n in hops]:
            while hops[x]:
                x = min(y for y in links[x] if hops.get(y) == hops[x] - 1)
                if x not in role:
                    added[x] = "port" if x in ports else "halo"
        seen = search(own | {n for n, r in added.items() if r == "port"}, links, set(role) | set(added))
        for n, r in (role | added).items():
            out.add((tile, n, r, n in added, "linked" if n in seen else "floating" if r == "core" else "dropped"))
    return out


def test_small(spark):
    # Tile a: 1 and 2 hang together but lead to port 9 only over 3 and 4 of tile b; 5 floats; halo node 6 leads nowhere.
    edges = [(1, 2), (2, 3), (3, 4), (4, 9), (5, 5), (6, 7)]
    members = [("a", 1, "core"), ("a", 2, "core"), ("a", 5, "core"), ("a", 6, "halo"), ("b", 3, "core"), ("b", 4, "core"), ("b", 9, "port")]
    got = run(spark, edges, members, {9}, {1, 2, 3, 4, 5, 6, 7})
    assert got == want(edges, members, {9}, {1, 2, 3, 4, 5, 6, 7})
    assert {("a", 1, "core", False, "linked"), ("a", 3, "halo", True, "linked"), ("a", 9, "port", True, "linked"), ("a", 5, "core", False, "floating"), ("a", 6, "halo", False, "dropped")} <= got


def run(spark, edges, members, ports, inner):
    one = lambda rows: spark.createDataFrame([(x,) for x in sorted(rows)], "node bigint")
    found = g.tile_connectivity(spark.createDataFrame(edges, "u bigint, v bigint"), spark.createDataFrame(members, "tile string, node bigint, role string"), one(ports), one(inner))
    return {tuple(r) for r in found.select("tile", "node", "role", "added", "state").collect()}


def test_random(spark):
    r = random.Random(5)
    ports, inner = set(range(90, 96)), set(range(80))
    edges = [(x, y) for x, y in ((r.randrange(80), r.randrange(80)) for _ in range(75))] + [(r.randrange(80), p) for p in ports] + [(3, 85), (85, 91)]
    members = [(f"t{x // 20}", x, "core") for x in range(80)] + [(f"t{(x // 20 + 1) % 4}", x, "halo") for x in range(80) if x % 4 == 0] + [(f"t{p % 2}", p, "port") for p in ports]
    assert run(spark, edges, members, ports, inner) == want(edges, members, ports, inner)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_query(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    edges = [tuple(r) for r in rel.with_ends(rel.of_type(rel.elements_once(t.grid_elements), "R"), t.grid_nodes).select("a", "b").collect()]
    ports = layer_split_ports(t)
    members = [(tuple(r.tile), r.node, r.role) for r in q_graph.tile_members(t, ports, 0.3).collect()]
    inner = {r[0] for r in t.grid_nodes.filter(q_graph._below()).select("node_id").collect()}
    rows = want(edges, members, {r.port for r in ports.collect()}, inner)
    tiles = {}
    for tile, _, role, added, state in rows:
        n = tiles.setdefault(tile, [0] * 7)
        for k, x in enumerate((role == "core", state == "floating", role == "halo" and state == "linked", state == "dropped", role == "halo" and added, role == "port", role == "port" and added)):
            n[k] += x
    assert {tuple(r)[:3]: list(r)[3:] for r in QUERIES["tile_port_connectivity"](spark, t.dir).collect()} == tiles
