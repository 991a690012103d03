import pytest
from pyspark.sql import functions as F

from gridloom.functions.elements import conductance, end_name
from gridloom.functions.values import instance_parts, net_kind, node_place, spice_value, time_value, value_with_params
from gridloom.functions.waveforms import pulse_at, pulse_average, pwl_at, pwl_average


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_spice_values(spark):
    texts = ["1K", "1M", "1MEG", "1U", "1N", "1P", "1F", "1G", "1t", "+3.0", "-2.5", "2.5E+6", "4.7k", "100n", "5.", ".5", "3volts", "x", "", None]
    want = [1e3, 1e-3, 1e6, 1e-6, 1e-9, 1e-12, 1e-15, 1e9, 1e12, 3.0, -2.5, 2.5e6, 4700.0, 1e-7, 5.0, 0.5, 3.0, None, None, None]
    got = column(spark, texts, spice_value)
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None])


def test_values_with_params(spark):
    got = column(spark, ["vdd", "VSS", "2X", "3MEG", "3volts", "7", "5.5\r", None], lambda c: value_with_params(c, {"VDD": 0.75, "VSS": 0.0}))
    assert got == [0.75, 0.0, 2e6, 3e6, None, 7.0, None, None]


def test_times(spark):
    assert column(spark, ["5ps", "2 ns", "1us", "3ms", "2s", "1e-9", "4h", None], time_value) == pytest.approx([5e-12, 2e-9, 1e-6, 3e-3, 2.0, 1e-9, None, None])


def test_names(spark):
    assert column(spark, ["10_20_M3", "-1_2", "pkg_1", "10_20_M3x", None], lambda c: node_place(c)["layer_num"]) == [3, None, None, None, None]
    assert column(spark, ["10_20_M3", "-1_2", "pkg_1", None], lambda c: node_place(c)["x"]) == [10.0, -1.0, None, None]
    assert column(spark, ["a:b:1_2", "a:0:9_8", "a", None], lambda c: instance_parts(c)["pin"]) == ["b", None, None, None]
    assert column(spark, ["VDD_1", "vss", "VDD_GND", "clk", None], net_kind) == ["power", "ground", "ground", "unknown", "unknown"]
    assert column(spark, ["*1_2_m3", "1_2_M3", "**1_2_m3", "pkg_m1"], end_name) == ["1_2_M3", "1_2_M3", "*1_2_m3", "pkg_m1"]


def test_conductance(spark):
    assert column(spark, [2.0, 0.0, -1.0, 1e-7, None, float("nan")], conductance, "double") == [0.5, 1e5, 1e5, 1e5, None, None]


def pulse(spark, t, *p):
    return spark.range(1).select(pulse_at(F.lit(t), *map(F.lit, map(float, p)))).first()[0]


def test_pulse(spark):
    assert pulse(spark, 0.5, 0, 1, 0, 1, 1, 2, 10) == 0.5
    assert pulse(spark, 3.5, 0, 1, 0, 1, 1, 2, 10) == 0.5
    assert pulse(spark, 13.5, 0, 1, 0, 1, 1, 2, 10) == 0.5
    assert pulse(spark, 0.5e-9, 0, 1, 1e-9, 1e-10, 1e-10, 5e-10, 2e-9) == 0.0
    average = lambda *p: spark.range(1).select(pulse_average(*map(F.lit, map(float, p)))).first()[0]
    assert average(0, 1, 0, 0, 5, 10) == 0.5
    assert average(0, 1, 0, 0, 5, 0) == 0.0


def wave(points):
    return F.array(*[F.struct(F.lit(float(a)).alias("t"), F.lit(float(b)).alias("v")) for a, b in points]) if points else F.array().cast("array<struct<t:double,v:double>>")


@pytest.mark.parametrize(
    "points,delay,period,t,want",
    [([(1, 0.5), (2, 1), (3, 0)], 0, 0, 0.5, 0.5), ([(1, 0.5), (2, 1), (3, 0)], 0, 0, 2, 1), ([(1, 0.5), (2, 1), (3, 0)], 0, 0, 5, 0), ([(0, 0), (2, 2)], 0, 0, 1, 1), ([(0, 0), (1, 1)], 5, 0, 5, 0), ([(0, 0), (1, 1)], 5, 0, 5.5, 0.5), ([(0, 0), (1, 1)], 0, 2, 3.5, 0), ([], 0, 0, 1, 0)],
)
def test_pwl(spark, points, delay, period, t, want):
    assert spark.range(1).select(pwl_at(F.lit(float(t)), wave(points), F.lit(float(delay)), F.lit(float(period)))).first()[0] == want


def test_pwl_average(spark):
    average = lambda p, period: spark.range(1).select(pwl_average(wave(p), F.lit(float(period)))).first()[0]
    assert average([(0, 0), (1, 2), (2, 0)], 2) == 1.0
    assert average([(0, 0), (1, 2)], 0) == 0.0
    assert average([(3, 7)], 0) == 7.0
    assert average([], 5) == 0.0
