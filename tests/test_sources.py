import gzip
import time
from pathlib import Path

import pytest

from gridloom import session
from gridloom.sources import netlist, sinks, synthetic
from gridloom.streaming import monitor


def test_files_and_logical_lines(spark, tmp_path):
    text = "* title\nr1 a b\n+ 5\n\n  c1 a\t0   3p * note\nr *x y 1 *\n.param vdd=0.75\n"
    (tmp_path / "a.ckt").write_text(text)
    with gzip.open(tmp_path / "b.ckt.gz", "wt") as f:
        f.write(text)
    lines = netlist.read_files(spark, str(tmp_path))
    got = netlist.logical_lines(lines)
    assert got.count() == 8
    assert [r.text for r in got.filter("file_name LIKE '%a.ckt'").orderBy("line_no").collect()] == ["r1 a b 5", "c1 a 0 3p", "r *x y 1", ".param vdd=0.75"]


def test_literals(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("pulse(1, 2) PWL(3 30 1 10 7) pulse()",), (None,), ("",)], "x string")
    a, b, c = df.select(netlist.pulse_literals(F.col("x")).alias("p"), netlist.pwl_literals(F.col("x")).alias("w")).collect()
    assert [(p.v1, p.v2, p.period) for p in a.p] == [(1.0, 2.0, 0.0), (0.0, 0.0, 0.0)]
    assert [[(q.t, q.v) for q in w] for w in a.w] == [[(1.0, 10.0), (3.0, 30.0)]]
    assert b.p is None and c.p == []


def test_synthetic(spark):
    specs = spark.createDataFrame([(1, 4), (2, 1)], "grid_id int, n0 int")
    e = synthetic.layered_grid(specs)
    assert e.filter("grid_id = 1 AND kind = 'via'").count() == 4 * 2 + 2 * 1
    assert abs(sum(r.r for r in e.filter("u LIKE 'L0_0_%' AND grid_id = 1 AND kind = 'stripe'").collect()) - 1.0) < 1e-12
    nodes = spark.createDataFrame([(b, n) for b in range(3) for n in range(4)], "block int, node int")
    sums = synthetic.block_patterns(nodes, 2, 5.0).groupBy("block", "pattern").sum("amps").collect()
    assert len(sums) == 9 and all(abs(r[2] - 5.0) < 1e-9 for r in sums)


def test_gaussian_stimulus(spark):
    loads = spark.range(2000).withColumnRenamed("id", "key")
    a = {r.key: r.amps for r in synthetic.gaussian_stimulus(loads, 10.0, 2.0, 1.0, 0.5).collect()}
    b = {r.key: r.amps for r in synthetic.gaussian_stimulus(loads.repartition(7), 10.0, 2.0, 1.0, 0.5).collect()}
    assert abs(sum(a.values()) - 5.0) < 1e-9 and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    mean = 5.0 / 2000
    assert 0.4 < (sum((x / mean - 1) ** 2 for x in a.values()) / 2000) ** 0.5 < 0.6


def test_report_and_json(spark):
    s = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9)], "node string, drop bigint")
    assert [r.node for r in sinks.worst_report(s, 2).orderBy("place").collect()] == ["c", "a"]
    assert sinks.as_json(s, "node").filter("node = 'c'").first().json == '{"node":"c","drop":9}'


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 5} 00:00:0{i % 10}", "click" if i % 3 else "view", i / 4) for i in range(60)]
    batch = spark.createDataFrame(rows, "event_id int, t string, event_type string, value double").selectExpr("event_id", "timestamp(t) ts", "event_type", "value")
    batch.repartition(3).write.parquet(str(tmp_path / "e"))
    got = monitor.run_once(monitor.windowed_metrics(monitor.read_stream(spark, str(tmp_path / "e"), batch)), ["start", "event_type"])
    want = batch.selectExpr("date_trunc('day', ts) start", "event_type", "value").groupBy("start", "event_type").agg({"value": "max", "*": "count"})
    assert {(r.start, r.event_type, r.n, r.most) for r in got.collect()} == {(r.start, r.event_type, r["count(1)"], r["max(value)"]) for r in want.collect()}


def test_stream_leaves_out_late_rows(spark, tmp_path):
    """Batches by file: a window gets its later rows while it is open; rows of a window that the watermark has passed are left out."""
    days = ["2024-01-01", "2024-01-02", "2024-01-01", "2024-01-20", "2024-01-20", "2024-01-01", "2024-01-19"]
    schema = "event_id int, t string, event_type string, value double"
    for i, d in enumerate(days):
        rows = spark.createDataFrame([(i, f"{d} 01:00:00", "click", float(i))], schema).selectExpr("event_id", "timestamp(t) ts", "event_type", "value")
        rows.coalesce(1).write.parquet(str(tmp_path / "all" / f"{i}"))
        time.sleep(0.05)  # files are taken in order of their times
    like = spark.read.parquet(str(tmp_path / "all" / "0"))
    got = monitor.run_once(monitor.windowed_metrics(monitor.read_stream(spark, str(tmp_path / "all" / "*"), like, 1)), ["start", "event_type"])
    assert {(str(r.start)[:10], r.n, r.most) for r in got.collect()} == {("2024-01-01", 2, 2.0), ("2024-01-02", 1, 1.0), ("2024-01-20", 2, 4.0), ("2024-01-19", 1, 6.0)}


def test_shared_folder(spark, monkeypatch):
    """Intermediate tables are deleted by drop and clear; on a cluster an unset folder is an error."""
    scratch = session.Scratch(spark)
    a, b = scratch.write(spark.range(3)), scratch.write(spark.range(4))
    path = Path(scratch.root.removeprefix("file:"))
    scratch.drop(a)
    assert not (path / "0").exists() and b.count() == 4
    session.clear(spark)
    assert not path.exists()

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://x"})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster())


def test_write_table(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int")
    sinks.write_table(rows, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).filter("k = 1").count() == 10


def test_power_grid(spark):
    specs = spark.createDataFrame([(1, 4), (2, 1), (3, 0), (4, None), (5, 9)], "grid_id long, n0 int")
    rows = synthetic.power_grid(specs, 3, 2.0, 0.1, 3, 5, 0.8, 0.01).collect()
    assert {r.grid_id for r in rows} == {1, 2, 5}
    for grid in (1, 5):
        own = [r for r in rows if r.grid_id == grid]
        kinds = {k: [r for r in own if r.kind == k] for k in ("R", "VIA", "I", "V")}
        n = [-(-{1: 4, 5: 9}[grid] // 2**k) for k in range(3)]
        assert len(kinds["VIA"]) == n[0] * n[1] + n[1] * n[2] and len(kinds["I"]) == 5 and len(kinds["V"]) == min(3, 2 * n[2])
        wired = {x for r in kinds["R"] + kinds["VIA"] for x in (r.u, r.v)}
        assert {r.u for r in kinds["I"] + kinds["V"]} <= wired
        root = {x: x for x in wired}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in kinds["R"] + kinds["VIA"]:
            root[top(r.u)] = top(r.v)
        assert len({top(x) for x in wired}) == 1  # everything hangs together
        # Splicing changes no stripe as a whole: layer 0 spans the outermost of its crossings.
        ohms = {}
        for r in kinds["R"]:
            if r.u.endswith("M1"):
                y = r.u.split("_")[1]
                ohms[y] = ohms.get(y, 0) + r.value
        assert all(abs(x - 2.0 * (1 - 1 / n[1])) < 1e-5 for x in ohms.values()) and len(ohms) == n[0]
    assert synthetic.power_grid(specs, loads=0).filter("kind = 'I'").count() == 0
    with pytest.raises(ValueError):
        synthetic.power_grid(specs, 1)


def test_counted_stimulus(spark):
    loads = spark.createDataFrame([(k, float(k % 10), None if k % 7 == 0 else float(k % 3)) for k in range(100)], "key long, x double, y double")
    got = synthetic.counted_stimulus(loads, 6.0, 0.5, 12).collect()
    want = sorted(range(100), key=lambda k: ((k * 7919 + 13) % 10_007, k))[:12]
    assert {r.key for r in got} == set(want) and all(r.amps == 1.0 for r in got)
    few = synthetic.counted_stimulus(loads, 6.0, 0.5, 1000, (0, 2, 0, 1)).collect()
    inside = [k for k in range(100) if k % 10 <= 2 and k % 7 and k % 3 <= 1]
    assert {r.key for r in few} == set(inside) and abs(sum(r.amps for r in few) - 12.0) < 1e-9
    assert synthetic.counted_stimulus(loads.limit(0), 6.0, 0.5, 5).count() == 0


def test_nested_json(spark):
    rows = spark.sql("SELECT 1 AS k, named_struct('a', CAST(NULL AS INT), 'b', array(1, NULL)) AS x, '\"' AS s")
    assert sinks.as_nested_json(rows, ["k"], ["x", "s"]).first().json == '{"x":{"a":null,"b":[1,null]},"s":"\\""}'
