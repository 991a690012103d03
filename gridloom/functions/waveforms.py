"""Loads over time: pulses and piecewise-linear waves as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _modulo(t: Column, period: Column) -> Column:
    return F.when(period > 0, t - F.floor(t / period) * period).otherwise(t)


def pulse_at(t: Column, v1: Column, v2: Column, delay: Column, rise: Column, fall: Column, width: Column, period: Column) -> Column:
    """Value of a pulse at t; the phase wraps at the period if that is positive."""
    s = _modulo(t, period) - delay
    s = F.when((s < 0) & (period > 0), s + period).otherwise(s)
    up = v1 + (v2 - v1) * s / rise
    down = v2 + (v1 - v2) * (s - rise - width) / fall
    return F.when(s < 0, v1).when(s < rise, up).when(s < rise + width, v2).when(s < rise + width + fall, down).otherwise(v1)


def pulse_average(v1: Column, v2: Column, rise: Column, fall: Column, width: Column, period: Column) -> Column:
    """Average over a period; 0 for a pulse without one."""
    low = F.greatest(F.lit(0.0), period - rise - fall - width)
    return F.when(period > 0, ((rise + fall) * (v1 + v2) / 2 + width * v2 + low * v1) / period).otherwise(0.0)


def pwl_at(t: Column, points: Column, delay: Column | None = None, period: Column | None = None) -> Column:
    """Value at t of a wave given as an array of structs (t, v) in order of t.

    Before the first point its value; after the last one its value, or the first value if the wave is periodic; between
    two points the line; 0 without points.
    """
    s = t - (delay if delay is not None else F.lit(0.0))
    cycle = (period > 0) if period is not None else F.lit(False)
    if period is not None:
        s = F.when(cycle & (s >= 0), _modulo(s, period)).otherwise(s)
    n = F.size(points)
    upto = F.size(F.filter(points, lambda p: p["t"] <= s))
    a, b = F.get(points, upto - 1), F.get(points, upto)
    line = F.when(b["t"] > a["t"], a["v"] + (b["v"] - a["v"]) * (s - a["t"]) / (b["t"] - a["t"])).otherwise(a["v"])
    first, last = F.get(points, F.lit(0)), F.get(points, n - 1)
    inside = F.when(upto == 0, first["v"]).when(upto >= n, F.when(cycle & (s > last["t"]), first["v"]).otherwise(last["v"])).otherwise(line)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(inside)


def pwl_average(points: Column, period: Column) -> Column:
    """Average over a period by trapezoids, with the closing piece; 0 for two or more points without a period; one point: its value."""
    n = F.size(points)
    areas = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (F.get(points, k)["t"] - F.get(points, k - 1)["t"]) * (F.get(points, k)["v"] + F.get(points, k - 1)["v"]) / 2)
    area = F.aggregate(areas, F.lit(0.0), lambda acc, x: acc + x)
    first, last = F.get(points, F.lit(0)), F.get(points, n - 1)
    closing = F.greatest(period - last["t"], F.lit(0.0)) * (last["v"] + first["v"]) / 2
    return F.when(n < 1, 0.0).when(n == 1, first["v"]).when(period > 0, (area + closing) / period).otherwise(0.0)
