import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridloom.llm.top_n import RUNS, LoserTree, Run, _merge, merge_runs, sorted_runs
from gridloom.operators.readings import current_readings


ENTRIES = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(0, 2)), max_size=12)


def as_run(entries):
    xs = sorted(entries)
    groups = sorted({g for g, *_ in xs})
    return Run(groups, [sum(x[0] == g for x in xs) for g in groups], [x[1] for x in xs], [x[2] for x in xs])


@given(st.lists(ENTRIES, max_size=9))
@settings(max_examples=300, deadline=None)
def test_loser_tree_merges(runs):
    tree = LoserTree([as_run(r) for r in runs])
    out = []
    while (x := tree.pop()) is not None:
        out.append(x)
    assert out == sorted(x for r in runs for x in r)


@given(st.lists(ENTRIES, max_size=9), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_seeks_past_n(runs, n):
    made = [as_run(r) for r in runs]
    whole = sorted(x for r in runs for x in r)
    want = [(g, k + 1, s, i) for h in range(4) for k, (g, s, i) in enumerate([x for x in whole if x[0] == h][:n])]
    assert list(_merge(made, n)) == want


def test_ordinary_groups_have_several_runs(spark):
    """On the normal path, with the settings of the query, the tree merges more than one run of a group."""
    rows = [(i, 1 + i % 2, " vdd", f"n{i:03d}", None, 1.0, float(i % 97), None, None) for i in range(400)]
    drops = spark.createDataFrame(rows, "drop_id bigint, run_id bigint, net_name string, node string, layer string, voltage double, ir_drop double, t_peak double, ingested_at timestamp")
    group = ["run_id", "net_name"]
    runs = sorted_runs(current_readings(drops, group, parts=RUNS), group, "ir_drop", "node", 10, "_salt")
    assert {(r.run_id, r.n, r.most) for r in runs.groupBy("run_id").agg(F.count("*").alias("n"), F.max(F.size("entries")).alias("most")).collect()} == {(1, RUNS, 10), (2, RUNS, 10)}
    got = {(r.run_id, r["rank"], r.item, r.score) for r in merge_runs(runs, group, 10, buckets=3).collect()}
    assert got == {(g, k, i, s) for g, k, i, s in ranked([(r[1], r[6], r[3]) for r in rows], 10)}


def ranked(rows, n):
    groups = {}
    for g, s, i, *_ in rows:
        if s is not None and s == s and i is not None:
            groups.setdefault(g, []).append((-s, i))
    return {(g, k + 1, i, -s) for g, xs in groups.items() for k, (s, i) in enumerate(sorted(xs)[:n])}


def test_against_sorting(spark):
    r = random.Random(4)
    items = ["a", "B", "é", "zz", "", "a" * 5000, None]
    rows = [(r.choice(["g", "g", "g", "h", None]), r.choice([None, float("nan"), float("inf"), -0.0, 0.0, *map(float, range(6))]), r.choice(items), r.randrange(7), "x") for _ in range(500)]
    rows += rows[:20] + [("alone", 1.0, "i", 0, "x"), ("nothing", None, "i", 0, "x")]
    df = spark.createDataFrame(rows, "grp string, s double, i string, part int, entries string")
    got = merge_runs(sorted_runs(df, ["grp"], "s", "i", 4, "part"), ["grp"], 4)
    assert {(x.grp, x["rank"], x.item, x.score) for x in got.collect()} == ranked(rows, 4)


def test_runs_of_two_days_unite(spark):
    df = spark.createDataFrame([(1, float(i % 10), f"n{i:02d}", i % 3) for i in range(60)], "grp int, s double, i string, day int")
    runs = [sorted_runs(df.filter(F.col("day") == d), ["grp"], "s", "i", 5, "day") for d in range(3)]
    got = merge_runs(runs[0].unionByName(runs[1]).unionByName(runs[2]), ["grp"], 5).orderBy("rank").collect()
    assert [x.item for x in got] == ["n09", "n19", "n29", "n39", "n49"]


def test_empty(spark):
    df = spark.createDataFrame([], "grp string, s double, i string, day int")
    assert merge_runs(sorted_runs(df, ["grp"], "s", "i", 5, "day"), ["grp"], 5).count() == 0
