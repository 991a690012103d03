import datetime as dt

from gridloom.operators.readings import current_readings
from gridloom.operators.skew import hot_keys, with_salt

SCHEMA = "drop_id bigint, run_id bigint, net_name string, node string, layer string, voltage double, ir_drop double, t_peak double, ingested_at timestamp, run string"


def test_rule_r(spark):
    t = lambda k: dt.datetime(2026, 1, k)
    row = lambda i, run, net, node, drop, at: (i, run, net, node, "M1", 1.0, drop, None, at, "x")
    rows = [row(1, 1, " vdd ", "a", 1.0, t(1)), row(2, 1, "VDD", "a", 2.0, t(3)), row(3, 1, "Vdd", "a", 9.0, t(2)), row(4, 1, "VDD", "b", 5.0, t(1)), row(5, 1, "VDD", "b", None, t(2)), row(6, 1, "VDD", "c", 5.0, t(2)), row(7, 1, "VDD", "c", float("nan"), t(3)), row(8, 1, "VDD", "d", -1.0, None), row(9, 1, "VDD", "d", -2.0, None), row(10, None, "VDD", "e", 1.0, t(1)), row(11, 1, None, "e", 1.0, t(1)), row(12, 1, "VDD", None, 1.0, t(1))]
    for min_rows in (2, 200_000):
        got = current_readings(spark.createDataFrame(rows * 2, SCHEMA), ["run_id", "net_name"], ["layer"], min_rows)
        assert {(r.run_id, r.net_name, r.node, r.ir_drop) for r in got.collect()} == {(1, "VDD", "a", 2.0), (1, "VDD", "d", -2.0)} and got.count() == 2


def test_hot_keys(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [(None, i) for i in range(3)], "k string, v int")
    hot = hot_keys(df, ["k"], 10)
    assert [(r.k, r._parts) for r in hot.collect()] == [("a", 10)]
    salted = with_salt(df, ["k"], ["v"], hot)
    assert salted.count() == 103 and salted.filter("k = 'a'").select("_salt").distinct().count() > 5
    assert hot_keys(df.filter("false"), ["k"]) is None
