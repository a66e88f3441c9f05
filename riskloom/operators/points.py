"""Low-discrepancy points: Sobol sequences as column expressions and as arrays.

Coordinate d of point i is the exclusive or of the direction numbers whose bits
the Gray code of i has set, so any point is made by itself, in any task and
order, and the first points of a longer table are the shorter one. A digital shift, another
exclusive or with bits from an MD5 digest of seed and coordinate, keeps their evenness.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Degree, inner coefficients as bits and first direction numbers of the primitive polynomials of coordinates 2 to 10 (Joe and Kuo).
POLYNOMIALS = [
    (1, 0, (1,)),
    (2, 1, (1, 3)),
    (3, 1, (1, 3, 1)),
    (3, 2, (1, 1, 1)),
    (4, 1, (1, 1, 3, 3)),
    (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)),
    (5, 7, (1, 1, 7, 11, 19)),
]
BITS = 32


def directions(d: int) -> list[int]:
    """Direction numbers of coordinate d, counted from 0, as whole numbers of BITS bits."""
    if d == 0:
        return [1 << (BITS - k) for k in range(1, BITS + 1)]
    degree, inner, first = POLYNOMIALS[d - 1]
    v = [m << (BITS - k) for k, m in enumerate(first, 1)]
    for k in range(degree, BITS):
        terms = [v[k - degree], v[k - degree] >> degree, *(v[k - j] for j in range(1, degree) if inner >> (degree - 1 - j) & 1)]
        v.append(reduce(int.__xor__, terms))
    return v


def shift(seed: int | None, d: int) -> int:
    """The digital shift of a coordinate; none without a seed."""
    return 0 if seed is None else int(md5(f"{seed}:{d}".encode()).hexdigest()[: BITS // 4], 16)


def sobol_columns(i: Column, dims: int, points: int, seed: int | None = None) -> list[Column]:
    """Coordinates of point i, below ``points``, each between 0 and 1: the middles of cells of 2**-32 with a seed, their lower ends without."""
    gray = i.bitwiseXOR(F.shiftright(i, 1))
    out = []
    for d in range(dims):
        bits = [F.shiftright(gray, k).bitwiseAND(F.lit(1)) * F.lit(v) for k, v in enumerate(directions(d)[: max(points - 1, 1).bit_length()])]
        x = reduce(Column.bitwiseXOR, bits).bitwiseXOR(F.lit(shift(seed, d)).cast("long"))
        out.append((x.cast("double") + (0.0 if seed is None else 0.5)) / 2**BITS)
    return out


def sobol_array(dims: int, points: int, seed: int | None = None) -> np.ndarray:
    """The same as an array, a row a point."""
    i = np.arange(points, dtype=np.uint64)
    gray, out = i ^ (i >> np.uint64(1)), np.empty((points, dims))
    for d in range(dims):
        x = np.full(points, shift(seed, d), np.uint64)
        for k, v in enumerate(directions(d)[: max(points - 1, 1).bit_length()]):
            x ^= (gray >> np.uint64(k) & np.uint64(1)) * np.uint64(v)
        out[:, d] = (x.astype(float) + (0.0 if seed is None else 0.5)) / 2**BITS
    return out
