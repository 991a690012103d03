import random

from pyspark.sql import functions as F

from gridloom.operators.running import running

SCHEMA = "g string, k int, x bigint, rank string"


def test_against_sorting(spark):
    """One group holds most rows; ties, NULL groups and values, and a column that is named like a result."""
    r = random.Random(6)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), i, r.choice([None, r.randrange(50), 7])) for i in range(2000)]
    df = spark.createDataFrame([(g, k, x, "c") for g, k, x in rows], SCHEMA).drop("rank").repartition(5)
    got = {(v.g, v.k): (v["rank"], v.group_rows, v.s, v.all_s) for v in running(df, ["g"], [F.desc_nulls_last("x"), F.asc("k")], {"s": F.col("x")}).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))
        at, whole = 0, sum(x[2] or 0 for x in own)
        for i, (_, k, x) in enumerate(own):
            at += x or 0
            want[g, k] = (i + 1, len(own), at, whole)
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA).drop("rank")
    assert running(df, ["g"], [F.asc("k")]).count() == 0
