import datetime as dt
import math
import random

from pyspark.sql import functions as F

from gridloom.operators.regular_grid import current_points, regular_grid

POINTS = "point_id bigint, source_id bigint, seq int, t double, t_unit string, amps_ma double, arrived_at timestamp, delay double"
SOURCES = "source_id bigint, delay double, t_start double, dt double, n_steps int"


def grid(spark, points, sources, min_rows=200_000, shard=64, block=256):
    readings, hot = current_points(spark.createDataFrame(points, POINTS), min_rows)
    return regular_grid(readings, spark.createDataFrame(sources, SOURCES), hot, shard, block)


def brute(points, sources):
    latest = {}
    for p in points:
        if p[1] is None or p[2] is None:
            continue
        rank = (p[6] is not None, p[6] or dt.datetime.min, p[0])
        if (p[1], p[2]) not in latest or rank > latest[p[1], p[2]][0]:
            latest[p[1], p[2]] = (rank, p)
    unit = {None: 1, "s": 1, "ns": 1e-9, "us": 1e-6, "ps": 1e-12, "ms": 1e-3}
    out = {}
    for s, delay, t0, step, n in sources:
        if t0 is None or not step or step <= 0 or not n or n < 0:
            continue
        cells = {k: [] for k in range(n)}
        for (sid, _), (_, p) in latest.items():
            if sid == s and p[3] is not None and p[5] is not None and not math.isnan(p[3]) and not math.isnan(p[5]) and p[4] in unit:
                k = math.floor((p[3] * unit[p[4]] + (delay or 0) - t0) / step)
                if 0 <= k < n:
                    cells[k].append((p[3] * unit[p[4]] + (delay or 0), p[5]))
        before, any_ = None, any(cells.values())
        for k in range(n):
            value = max(cells[k])[1] if cells[k] else None
            before = value if value is not None else before
            mark = "read" if cells[k] else "carried" if before is not None else "before_first" if any_ else "no_readings"
            out[s, k] = (len(cells[k]), value, mark, before)
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    sources = [(s, r.choice([None, 0.0, 2.5]), 0.0, 1.0, r.randint(1, 40)) for s in range(8)] + [(90, 0.0, None, 1.0, 5), (91, 0.0, 0.0, 0.0, 5), (92, None, 0.0, 1.0, None), (93, None, 0.0, 1.0, 3)]
    when = dt.datetime(2026, 1, 1)
    points = []
    for i in range(400):
        u = r.choice([None, "s", "ns", "us", "ps", "fortnight"])
        t = r.randint(-3, 45) + 0.5 + r.choice([0, 0.1, 0.2])
        factor = {"ns": 1e9, "us": 1e6, "ps": 1e12}.get(u, 1)
        points.append((i, r.choice([0, 0, 0, 1, 2, 3, 4, 5, 90, None]), r.choice([None, *range(60)]), r.choice([None, float("nan"), *[t * factor] * 8]), u, r.choice([None, float("nan"), *[float(r.randint(0, 9))] * 8]), r.choice([None, when + dt.timedelta(seconds=r.randint(0, 9))]), 1.0))
    points += points[:30]
    want = brute(points, sources)
    for min_rows, shard, block in ((200_000, 64, 256), (20, 4, 3), (20, 1, 5)):
        got = {(x.source_id, x.step): (x.n_readings, x.value, x.mark, x.filled) for x in grid(spark, points, sources, min_rows, shard, block).collect()}
        assert got == want


def test_linear(spark):
    points = [(1, 1, 1, 0.5, "s", 1.0, None, None), (2, 1, 2, 4.5, "s", 5.0, None, None)]
    rows = grid(spark, points, [(1, None, 0.0, 1.0, 6)], shard=2, block=2).orderBy("step").collect()
    assert [x.linear for x in rows] == [1.0, 1.5, 2.5, 3.5, 4.5, 5.0]
    assert [x.filled for x in rows] == [1.0, 1.0, 1.0, 1.0, 5.0, 5.0]


def test_empty(spark):
    assert grid(spark, [], []).count() == 0
    assert grid(spark, [], [(1, 0.0, 0.0, 1.0, 3)]).filter(F.col("mark") == "no_readings").count() == 3
