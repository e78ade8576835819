"""Reproducible random draws: a pure function of the key, never of partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from limbwise.functions.columns import let


def digest(*key: Column | str | int) -> Column:
    """md5 of the key parts joined by '|'."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def lane(hashed: Column, k: int = 0) -> Column:
    """Uniform [0, 1) from the k-th 32-bit word (0..3) of a digest."""
    return F.conv(F.substring(hashed, 1 + 8 * k, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(*key: Column | str | int) -> Column:
    return lane(digest(*key))


def normals(hashed: Column) -> Column:
    """Three standard normals from one digest (Box-Muller on its four words)."""
    def radius(u: Column) -> Column:
        return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u))
    tau = F.lit(2.0 * math.pi)
    return let(hashed, lambda h: F.array(
        radius(lane(h, 0)) * F.cos(tau * lane(h, 1)),
        radius(lane(h, 0)) * F.sin(tau * lane(h, 1)),
        radius(lane(h, 2)) * F.cos(tau * lane(h, 3))))
