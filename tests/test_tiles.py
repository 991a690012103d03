import random

from gridloom.operators import tiles as tl

NX, NY = 3, 2


def brute(places, ports, loads):
    """The same rounds over lists, for one key."""
    x0, x1, y0, y1 = min(p[1] for p in places), max(p[1] for p in places), min(p[2] for p in places), max(p[2] for p in places)
    w, h = (x1 - x0) / NX, (y1 - y0) / NY
    t = {r * NX + c: [x0 + c * w, x1 if c == NX - 1 else x0 + (c + 1) * w, y0 + r * h, y1 if r == NY - 1 else y0 + (r + 1) * h] for r in range(NY) for c in range(NX)}
    held = lambda b, xs: sum(b[0] <= x <= b[1] and b[2] <= y <= b[3] for x, y in xs)
    share = max(1, -(-len(ports) // (NX * NY)))
    for _ in range(2 * NX * NY):
        n, new = {k: held(b, ports) for k, b in t.items()}, {}
        for k, b in t.items():
            sides = [(k % NX > 0, k - 1), (k % NX < NX - 1, k + 1), (k >= NX, k - NX), (k < NX * (NY - 1), k + NX)]
            best = max(((n[to] - share, -way, to) for way, (ok, to) in enumerate(sides) if ok), default=None)
            if n[k] >= share or best is None or best[0] <= 0:
                continue
            o, b, dx, dy = t[best[2]], list(b), (t[best[2]][1] - t[best[2]][0]) * 0.1, (t[best[2]][3] - t[best[2]][2]) * 0.1
            way = -best[1]
            b[way] = [max(o[0], b[0] - dx), min(o[1], b[1] + dx), max(o[2], b[2] - dy), min(o[3], b[3] + dy)][way]
            if b != t[k]:
                new[k] = b
        if not new:
            break
        t |= new
    empty = [k for k in sorted(t) if not held(t[k], loads)]
    for k in empty:
        if k in t:  # what a tile took in had no load either
            for ok, to in ((k % NX > 0, k - 1), (k % NX < NX - 1, k + 1), (k >= NX, k - NX), (k < NX * (NY - 1), k + NX)):
                if ok and to in t:
                    a, b = t[to], t.pop(k)
                    t[to] = [min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])]
                    break
    return {n: min((k for k, b in t.items() if b[0] <= x <= b[1] and b[2] <= y <= b[3]), default=None) for n, x, y in places}


def test_against_lists(spark):
    r = random.Random(3)
    want, rows, port, load = {}, [], [], []
    for d in range(4):
        places = [(d * 1000 + i, float(r.randrange(0, 90)), float(r.randrange(0, 60))) for i in range(120)]
        ports = [(x, y) for _, x, y in places if x > 50 and r.random() < 0.3] if d < 3 else []
        loads = [(x, y) for _, x, y in places if y > 25 and x < 70][: 9 if d else 0]
        want |= brute(places, ports, loads) if d else {}
        rows += [(d, n, x, y, "z") for n, x, y in places if d] + [(9, d, None, 1.0, "z")]
        port += [(d, x, y) for x, y in ports] + [(d, None, 1.0)]
        load += [(d, x, y) for x, y in loads]
    places = spark.createDataFrame(rows, "k bigint, node bigint, x double, y double, ports string")
    ports, loads = (spark.createDataFrame(v, "k bigint, x double, y double") for v in (port, load))
    first = tl.uniform_tiles(places.dropna(subset=["x"]), "k", NX, NY)
    grown = tl.grow(first, ports, "k", NX, NY)
    assert grown.count() == 18
    got = {x.node: x.tile_id for x in tl.shared_out(tl.merge_loadless(grown, loads, "k", NX, NY), places, "k", "node").collect()}
    assert got == {n: k for n, k in want.items() if k is not None} and len(set(got.values())) > 2


def test_empty(spark):
    none = spark.createDataFrame([], "k bigint, node bigint, x double, y double")
    grown = tl.grow(tl.uniform_tiles(none, "k", NX, NY), none, "k", NX, NY)
    assert tl.shared_out(tl.merge_loadless(grown, none, "k", NX, NY), none, "k", "node").count() == 0
