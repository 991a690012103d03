"""Elements of a network as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Below this resistance (or at zero and less) an element is a short of this conductance.
SHORT, SHORT_G = 1e-6, 1e5


def conductance(r: Column) -> Column:
    """1/R, a fixed large value for shorts; NULL stays NULL, NaN is NULL."""
    return F.when(F.isnan(r), F.lit(None)).when((r <= 0) | (r < SHORT), F.lit(SHORT_G)).otherwise(1 / r)


def end_name(c: Column) -> Column:
    """A node without the mark of the boundary and with the layer's M in upper case."""
    return F.regexp_replace(F.regexp_replace(c, r"^\*", ""), r"^([0-9]+_[0-9]+_)m([0-9]+)\z", "$1M$2")
