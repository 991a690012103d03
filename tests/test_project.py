import gzip

import numpy as np
import pytest

from gridloom.cli import main, solve
from gridloom.operators import model
from gridloom.sources.netlist import logical_lines
from gridloom.sources.project import load, read_lines


def folder(tmp_path, side=5):
    """A two-layer grid with packed and plain files, an island, and a missing include."""
    at = lambda x, y, l: f"{x * 1000}_{y * 1000}_M{l}"
    r = []
    for y in range(side):
        r += [(at(x, y, 1), at(x + 1, y, 1), 0.02) for x in range(side - 1)] + [(at(y, x, 2), at(y, x + 1, 2), 0.015) for x in range(side - 1)]
        r += [(at(x, y, 1), at(x, y, 2), 0.005) for x in range(side)]
    loads = [(at(1, 2, 1), 1.5e-3), (at(3, 3, 1), 2e-3), (at(3, 3, 1), 1e-3)]
    pads = [at(0, 0, 2), at(4, 4, 2)]
    tile = ["* tile"] + [f"r {u} *{v}\n+ {x}" for u, v, x in r] + ["r 9_9_M1 8_8_M1 1", "c 0_0_M1 0 1p", "m1 a b c d"]
    (tmp_path / "tile_0_0.ckt").write_text("\n".join(tile))
    with gzip.open(tmp_path / "tile_0_0.nd", "wt") as f:
        f.write("\n".join(f"{at(x, y, 1)} 0 0 0 0 VDD" for x in range(side) for y in range(side)))
    with gzip.open(tmp_path / "inst.sp.gz", "wt") as f:
        f.write("\n".join(f"i_{k} {n} 0 {a / 2} static_value={a / 2}" for k, (n, a) in enumerate(loads)))
    top = [".partition_info 1 1", ".parameter VDD 0.75", *[f"v{k} {p} 0 VDD_IGNORED" for k, p in enumerate(pads)], ".include tile_0_0.ckt", ".include inst.sp", ".include gone.sp"]
    (tmp_path / "ckt.sp").write_text("\n".join(top))
    names = sorted({n for u, v, _ in r for n in (u, v)})
    g = np.zeros((len(names), len(names)))
    k = {n: i for i, n in enumerate(names)}
    for u, v, x in r:
        for i, j in ((k[u], k[v]), (k[v], k[u])):
            g[i, i] += 1 / x
            g[i, j] -= 1 / x
    b = np.zeros(len(names))
    for n, a in loads:
        b[k[n]] += a
    free = [k[n] for n in names if n not in pads]
    want = np.zeros(len(names))
    want[free] = np.linalg.solve(g[np.ix_(free, free)], b[free])
    return dict(zip(names, want))


@pytest.mark.parametrize("dense", [2000, 3])
def test_folder_to_drops(spark, tmp_path, dense, monkeypatch):
    want = folder(tmp_path)
    p = load(spark, str(tmp_path), cache=str(tmp_path / "cache"))
    assert p.missing == ["gone.sp"] and p.node_nets.count() == 25 and [r.text for r in p.unsupported.collect()] == ["m1 a b c d"]
    assert p.elements.groupBy("kind").count().filter("kind = 'R'").first()["count"] == 66
    monkeypatch.setattr(model.network_drop, "__defaults__", (dense, 1e-11))
    got = {r.node: r.drop for r in solve(p).collect()}
    assert set(got) == set(want) and max(abs(got[n] - x) for n, x in want.items()) < 1e-9


def test_command_line(spark, tmp_path, capsys):
    want = folder(tmp_path)
    main(["solve", str(tmp_path), "--top", "3", "--out", str(tmp_path / "out")])
    worst = sorted(want.items(), key=lambda x: (-round(x[1], 12), x[0]))[:1]
    assert capsys.readouterr().out.split()[0] == worst[0][0]
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_options_nets_and_statistics(spark, tmp_path):
    (tmp_path / "ckt.sp").write_text(
        ".subckt cell a b c\nK1 l1 l2 0.5\nv1 *p1 0 0.75 AC 1.5 PORTID x=7\nv2 q1 0 DCX pwl(0 1 2 3)\nE1 1_1_M1 0 *2_2_M1 0 2.5\nX1 a b cell\n.include package.ckt\n.include tile_0_1.ckt\n.include instanceModels_0_1.sp\n"
    )
    (tmp_path / "package.ckt").write_text("rs p1 p2 0.001\nr2 p2 1_1_M1 0.002\nr3 q1 5_5_M1 0.004\n")
    (tmp_path / "tile_0_1.ckt").write_text("r 1_1_M1 2_2_M1 0.5\nr 5_5_M1 6_6_M1 1\nc 1_1_M1 0 1p")
    (tmp_path / "tile_0_1.nd").write_text("1_1_M1 0 0 0 0 VDD\n2_2_M1 0 0 0 0 VDD\n5_5_M1 0 0 0 0 VSS\n6_6_M1 0 0 0 0 VSS\n")
    (tmp_path / "instanceModels_0_1.sp").write_text(
        'i_a:10_20:vdd 2_2_M1 0 dc 1m static_value=2m pulse(0 1 0 1n 1n 5n 0) pulse(0 1 0 1n 1n 5n 3n) sp=10n pwl(1n 2 0 1) pwl_period=4n pwl_delay=1n pwl(0 1,2n 3) pwl_period=8n inst="x y"\ni_b 6_6_M1 0 1m fsdb wave.fsdb 2.5 bad\n'
    )
    p = load(spark, str(tmp_path))
    e = {r.name: r for r in p.elements.collect()}
    a, b = e["i_a:10_20:vdd"], e["i_b"]
    assert (a.dc, a.static_value, a.value, a.inst_x, a.inst_y, a.instance, a.file_type, a.tile_x, a.tile_y, a.net) == (1e-3, 2e-3, 3e-3, 10, 20, "x y", "instance", 0, 1, "VDD")
    assert [round(x.period * 1e9, 6) for x in a.pulses] == [10, 3]
    assert [([(round(t.t * 1e9, 6), t.v) for t in x.points], round(x.period * 1e9, 6), round(x.delay * 1e9, 6)) for x in a.pwls] == [([(0, 1), (1, 2)], 4, 1), ([(0, 1), (2, 3)], 8, 0)]
    assert (b.fsdb_path, b.fsdb_coeff, b.fsdb_shift, b.net, b.pulses, b.pwls) == ("wave.fsdb", 2.5, None, "VSS", [], [])
    assert (e["v1"].ac, e["v1"].portid, e["v1"].u, e["v1"].net) == (1.5, "7", "p1", "VDD") and e["v2"].pwl_text == "pwl(0 1 2 3)"
    assert (e["E1"].kind, e["E1"].value, e["E1"].ctrl_pos) == ("E", 2.5, "2_2_M1")
    assert [tuple(r) for r in p.couplings.collect()] == [("K1", "l1", "l2", 0.5)] and [tuple(r) for r in p.subcircuits.collect()] == [("cell", ["a", "b", "c"])]
    assert [r.text for r in p.unsupported.collect()] == ["X1 a b cell"]
    assert {(r.node, r.net) for r in p.nets.filter("category = 'package'").collect()} == {("p1", "VDD"), ("p2", "VDD"), ("q1", "VSS")}
    stats = {(r.net, r.category, r.kind): (r.n, round(r.total or 0, 9)) for r in p.statistics().collect()}
    assert stats["VDD", "package", "R"] == (2, 0.003) and stats["VSS", "package", "R"] == (1, 0.004) and stats["VDD", "die", "I"] == (1, 0.003) and stats["VDD", "die", "R"] == (1, 0.5)
    vss = {r.name for r in load(spark, str(tmp_path), net="vss").elements.collect()}
    assert {"v2", "r3", "i_b"} <= vss and not vss & {"v1", "rs", "r2", "i_a:10_20:vdd", "E1"}


def test_plain_files_are_read_in_pieces(spark, tmp_path):
    """Line numbers and continued lines hold across the pieces of a file and the blocks of lines."""
    lines = [f"r{i} a{i} b{i} {i}" if i % 3 else f"+ x{i}" for i in range(3000)]
    (tmp_path / "a.ckt").write_bytes("\n".join(lines).encode() + b"\nr\xff9 a b 1\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        read = read_lines(spark, [str(tmp_path / "a.ckt")])
        assert read.rdd.getNumPartitions() > 1
        got = {r.line_no: r.raw_line for r in read.collect()}
        assert got == {i + 1: x for i, x in enumerate([*lines, "r9 a b 1"])}
        whole = {r.line_no: r.text for r in logical_lines(read).collect()}
        assert {r.line_no: r.text for r in logical_lines(read, 7).collect()} == whole
        assert whole[1] == "x0" and whole[3] == "r2 a2 b2 2 x3" and len(whole) == 2002
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ground_and_islands(spark):
    e = spark.createDataFrame([("p", "a", 1.0), ("a", "0", 1.0), ("x", "y", 1.0), (None, "a", 1.0), ("a", "a", 5.0), ("a", "b", None)], "u string, v string, g double")
    pads = spark.createDataFrame([("p",), (None,), ("nowhere",)], "node string")
    loads = spark.createDataFrame([("a", 0.0), ("y", 1.0), ("nowhere", 1.0), (None, 1.0)], "node string, amps double")
    assert {(r.node, r.drop) for r in model.network_drop(e, pads, loads, 1.0).collect()} == {("p", 0.0), ("a", 0.5)}
    assert model.network_drop(e.filter("false"), pads, loads, 1.0).count() == 0
