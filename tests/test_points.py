"""Sobol points against their published first rows and their own evenness."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators.points import sobol_array, sobol_columns

#: First ten points of three coordinates, as published with the direction numbers.
PUBLISHED = [(0, 0, 0), (0.5, 0.5, 0.5), (0.75, 0.25, 0.25), (0.25, 0.75, 0.75), (0.375, 0.375, 0.625), (0.875, 0.875, 0.125), (0.625, 0.125, 0.875), (0.125, 0.625, 0.375), (0.1875, 0.3125, 0.9375), (0.6875, 0.8125, 0.4375)]


def test_points_are_the_published_ones(spark):
    assert np.array_equal(sobol_array(3, 10), np.array(PUBLISHED, float))
    for seed in (None, 5):
        rows = spark.range(300).select(*sobol_columns(F.col("id"), 10, 300, seed)).collect()
        assert np.array_equal(np.array([tuple(r) for r in rows]), sobol_array(10, 300, seed))


def test_points_are_even():
    """Every coordinate has one point in each of 2**k cells, shifted or not; shorter tables begin longer ones; pairs fill their squares."""
    for seed in (None, 1, 2):
        x = sobol_array(10, 4096, seed)
        assert (np.sort(np.floor(x * 4096), axis=0) == np.arange(4096)[:, None]).all()
        assert np.array_equal(sobol_array(10, 1000, seed), x[:1000])
        for d in range(0, 10, 2):
            cells = np.floor(x[:, d : d + 2] * 16).astype(int) @ [16, 1]
            assert np.ptp(np.bincount(cells, minlength=256)) <= 16
        assert (x >= 0).all() and (x < 1).all() and (seed is None or (x > 0).all())
