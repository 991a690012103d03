import random

from gridloom.plans.queries import QUERIES, SQL
from oracle import same

NAME = "overlapping_windows"


def parts(spark, folder, keys):
    spark.createDataFrame([(k, 1 + i % 50) for i, k in enumerate(keys)], "p_partkey bigint, p_size int").coalesce(1).write.parquet(f"{folder}/rows")
    next((folder / "rows").glob("*.parquet")).rename(folder / "part.parquet")
    for p in (folder / "rows").iterdir():
        p.unlink()
    (folder / "rows").rmdir()
    return str(folder)


def test_gaps_repeats_and_nulls(spark, tmp_path):
    """Cells of all fillings, keys that come twice, keys below 0 and of NULL."""
    r = random.Random(3)
    keys = r.sample(range(-700, 3000), 1900) + r.choices(range(200), k=60) + [None, None]
    r.shuffle(keys)
    same(spark, NAME, QUERIES[NAME], SQL[NAME], parts(spark, tmp_path, keys))


def test_copies_are_not_broadcast(spark, tmp_path):
    """The copies are several times the table whatever Spark takes them for, so the driver must not hold them."""
    df = QUERIES[NAME](spark, parts(spark, tmp_path, range(2000)))
    assert df.count() > 2000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
