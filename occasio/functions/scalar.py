"""Column expressions that the operators share. All stay inside generated code; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Upper ends of the basket size buckets 0 to 3; larger baskets are in bucket 4.
SIZE_BUCKETS = (1, 5, 15, 50)


def size_bucket(n: Column) -> Column:
    """0 to 4 by the number of products."""
    out = F.lit(len(SIZE_BUCKETS))
    for i, top in reversed(list(enumerate(SIZE_BUCKETS))):
        out = F.when(n <= top, i).otherwise(out)
    return out.cast("int")


def basket_id(household: Column, week: Column) -> Column:
    return F.concat_ws("_", household.cast("string"), week.cast("string"))


def household_of(key: Column) -> Column:
    """What stands before the last underscore, as a long; null if it is no number."""
    return F.regexp_extract(key, r"^(.*)_([^_]+)$", 1).try_cast("long")


def week_of(key: Column) -> Column:
    return F.regexp_extract(key, r"^(.*)_([^_]+)$", 2).try_cast("int")


def blank_to(text: Column, default: str = "UNKNOWN") -> Column:
    return F.coalesce(F.nullif(F.trim(text.cast("string")), F.lit("")), F.lit(default))


def log_units(units: Column) -> Column:
    """log1p above -1, else 0: returns must not make infinities."""
    return F.when(units > -1, F.log1p(units)).otherwise(F.lit(0.0))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def minmax_within(x: Column, *keys: str) -> Column:
    """Min-max scale inside a group; a group of one value gives 1 if that is above 0, else 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (x - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.when(high > 0, 1.0).otherwise(0.0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(doubles(v), lambda x: F.when(norm > 0, x / F.nullif(norm, F.lit(0.0))).otherwise(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; the denominator is at least 1e-12."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1e-12))


def banded(x: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first band whose upper end is at least ``x``."""
    out = F.when(x.isNull(), None).otherwise(F.lit(last))
    for top, name in reversed(edges):
        out = F.when(x <= top, name).otherwise(out)
    return out
