import math
import random

from gridloom.llm import percentiles
from gridloom.llm.percentiles import bounded, multi_select, summarise


def exact(rows, pcts, least):
    groups = {}
    for a, b, v, *_ in rows:
        if a is not None and b is not None and v is not None and v == v:
            groups.setdefault((a, b), []).append(v)
    return {(*g, p, sorted(vs)[max(1, math.ceil(len(vs) * p / 100)) - 1]) for g, vs in groups.items() if len(vs) >= least for p in pcts}


def check(spark, rows, pcts, least=1):
    df = spark.createDataFrame(rows, "a string, b string, x double, value string, weight string")
    got = multi_select(df, ["a", "b"], "x", pcts, least)
    assert {(r.a, r.b, r.pct, r.value) for r in got.collect()} == exact(rows, pcts, least)
    assert got.count() == len(exact(rows, pcts, least))


def test_against_sorting(spark):
    r = random.Random(8)
    value = lambda g: r.choice([None, float("nan"), r.gauss(0, 1), r.gauss(0, 1), 7.0 if g == "ties" else r.random()])
    names = ["big"] * 6 + ["ties", "ties", "small", None]
    rows = [(g := r.choice(names), r.choice(["M1", "M1", "M2", None]), value(g), None, None) for _ in range(6000)]
    rows += [("one", "M1", 3.0, None, None), ("two", "M1", -1.0, None, None), ("two", "M1", float("inf"), None, None)]
    check(spark, rows, [1, 50, 95, 99, 100])
    check(spark, rows, [50], 100)


def test_rounds_with_few_slices(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "SLICES", 4)
    monkeypatch.setattr(percentiles, "FLUSH", 500)
    monkeypatch.setattr(percentiles, "BROADCAST_ROWS", 0)
    r = random.Random(9)
    check(spark, [("g", r.choice("xy"), r.paretovariate(1), None, None) for _ in range(3000)], [10, 50, 99])


def test_days_put_together(spark, monkeypatch):
    """Two days' summaries united answer within their bound, and start the exact search over both days."""
    monkeypatch.setattr(percentiles, "SLICES", 16)
    r = random.Random(10)
    day = lambda k: [(r.choice("pq"), r.choice(["M1", None]), r.gauss(k, 1), None, None) for _ in range(4000)]
    rows = [day(0), day(3)]
    days = [spark.createDataFrame(x, "a string, b string, x double, value string, weight string") for x in rows]
    summary = summarise(days[0], ["a", "b"], "x").unionByName(summarise(days[1], ["a", "b"], "x"))
    pcts = [5, 50, 99]
    got = multi_select(days[0].unionByName(days[1]), ["a", "b"], "x", pcts, summary=summary)
    assert {(g.a, g.b, g.pct, g.value) for g in got.collect()} == exact(rows[0] + rows[1], pcts, 1)
    for g in bounded(summary, ["a", "b"], pcts).collect():
        values = sorted(v for a, b, v, *_ in rows[0] + rows[1] if (a, b) == (g.a, g.b))
        assert g.n == len(values) and 0 < g.max_error < 0.2
        assert abs(sum(v <= g.value for v in values) - len(values) * g.pct / 100) <= g.max_error * g.n + 1


def test_empty(spark):
    assert bounded(summarise(spark.createDataFrame([], "a string, x double"), ["a"], "x"), ["a"], [50]).count() == 0
    check(spark, [], [50])
    check(spark, [("a", "b", None, None, None)], [50])
