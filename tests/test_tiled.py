"""Sweeps over tiles against the whole network."""

import numpy as np
import pytest

from gridloom.operators import solvers as so
from test_networks import network


def test_sweeps_end_by_change(spark):
    matrix, b, places, want = network(spark)
    x = so.tiled(places, matrix, b, 3000, 1000, 100, 1e-7)
    assert np.abs(np.array([r.x for r in x.orderBy("node").collect()]) - want).max() < 1e-7
    with pytest.raises(RuntimeError):
        so.tiled(places, matrix, b, 3000, 1000, 3, 1e-7)
