"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A column that is only read inside a lambda is inlined by the optimizer and would
    be evaluated once per element; a one-element ``transform`` evaluates it once.
    """
    return F.transform(F.array(value), body)[0]


def doubles(count: int, value: float = 0.0) -> Column:
    return F.array_repeat(F.lit(float(value)), count)


def steps(count: Column | int) -> Column:
    """0 .. count-1 as INT, empty for count <= 0."""
    count = F.lit(count) if isinstance(count, int) else count
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>"))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def ratio(num: Column, den: Column) -> Column:
    """num/den, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def between_ranks(values: Column, q: float) -> Column:
    """Linear-interpolated percentile of a bounded array column (null when empty)."""
    def pick(s: Column) -> Column:
        pos = (F.size(s) - 1) * F.lit(float(q))
        lo = F.floor(pos).cast("int")
        hi = F.ceil(pos).cast("int")
        return F.when(F.size(s) > 0, F.get(s, lo) + (F.get(s, hi) - F.get(s, lo)) * (pos - lo))
    return let(F.sort_array(values), pick)


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where null equals null; one column per key, like a join by name.

    The keys are compared as a struct: still an equi-join that can be hashed and sorted.
    """
    keys = list(keys)
    a = left.withColumn("_left", F.struct(*keys))
    b = right.select(F.struct(*keys).alias("_right"), *[c for c in right.columns if c not in keys])
    out = a.join(b, F.col("_left") == F.col("_right"), how)
    if how in ("left_semi", "left_anti"):
        return out.drop("_left")
    at = F.coalesce("_left", "_right")
    return out.select(*[at.getField(k).alias(k) for k in keys], *[F.col(c) for f in (left, right) for c in f.columns if c not in keys])


def one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row results side by side (a union of at most one row each, not a join)."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns])
