import random

from pyspark.sql import functions as F

from gridloom.operators.aggregates import separated_worst

SCHEMA = "g string, node string, x double, y double, drop double, pick int"


def window(dx, dy, ex, ey):
    return (dx <= ex * 0.2) & (dy <= ey * 0.2)


def greedy(rows, k):
    out = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4], r[1]))
        ex, ey = (max(r[i] for r in own) - min(r[i] for r in own) for i in (2, 3))
        kept = []
        for r in own:
            if len(kept) < k and not any(abs(r[2] - p[2]) <= ex * 0.2 and abs(r[3] - p[3]) <= ey * 0.2 for p in kept):
                kept.append(r)
        out += [(g, i + 1, *r[1:5]) for i, r in enumerate(kept)]
    return sorted(out)


def found(spark, rows, k=4):
    places = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in separated_worst(places, ["g"], k, window).collect())


def test_against_greedy_loop(spark):
    rnd = random.Random(3)
    rows = [(f"g{rnd.randrange(3)}", f"n{i:03}", rnd.randrange(30) * 1.0, rnd.randrange(30) * 1.0, rnd.randrange(12) * 0.1, 9) for i in range(300)]
    assert found(spark, rows) == greedy(rows, 4)


def test_nulls_copies_and_one_node(spark):
    good = [("a", "n1", 0.0, 0.0, 1.0, 1), ("a", "n1", 0.0, 0.0, 1.0, 1), ("b", "n2", 5.0, 5.0, -1.0, None)]
    bad = [(None, "n3", 0.0, 0.0, 9.0, 1), ("a", None, 0.0, 0.0, 9.0, 1), ("a", "n4", None, 0.0, 9.0, 1), ("a", "n5", 0.0, 0.0, float("nan"), 1), ("a", "n6", 0.0, 0.0, None, 1)]
    assert found(spark, good + bad) == [("a", 1, "n1", 0.0, 0.0, 1.0), ("b", 1, "n2", 5.0, 5.0, -1.0)]


def test_empty(spark):
    df = separated_worst(spark.createDataFrame([], SCHEMA), ["g"], 2, window)
    assert df.count() == 0 and df.columns == ["g", "pick", "node", "x", "y", "drop"]


def test_touching_windows_are_near(spark):
    rows = [("a", "n1", 0.0, 0.0, 3.0, 1), ("a", "n2", 2.0, 2.0, 2.0, 1), ("a", "n3", 10.0, 10.0, 1.0, 1)]
    assert [r[2] for r in found(spark, rows)] == ["n1", "n3"]
    assert separated_worst(spark.createDataFrame(rows, SCHEMA), ["g"], 9, lambda dx, dy, ex, ey: F.lit(False)).count() == 3
