"""Column helpers shared by the operators: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def present(c: Column) -> Column:
    """The value, or null where it is the empty string."""
    return F.nullif(c, F.lit(""))


def one_of(pairs: dict, key: Column, default=None) -> Column:
    """A value chosen by equality with the keys of ``pairs``."""
    out = F.lit(default)
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def ranked(by, *order) -> Column:
    """Row number within ``by`` in a total order."""
    return F.row_number().over(Window.partitionBy(*([by] if isinstance(by, (str, Column)) else by)).orderBy(*order))


def compact(c: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return EARTH_M * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def valid_point(lat: Column, lon: Column) -> Column:
    """Finite coordinates in range that are not the origin."""
    la, lo = lat.try_cast("double"), lon.try_cast("double")
    ok = ~F.isnan(la) & ~F.isnan(lo) & (F.abs(la) <= 90) & (F.abs(lo) <= 180) & ~((F.abs(la) < 1e-4) & (F.abs(lo) < 1e-4))
    return F.coalesce(ok, F.lit(False))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def rounded(c: Column, digits: int) -> Column:
    """A double rounded half away from zero by its product with the power of ten, as SQL engines in C do; ``round`` rounds its shortest decimal form."""
    scaled = c * F.lit(10.0**digits)
    return F.signum(c) * F.floor(F.abs(scaled) + 0.5) / F.lit(10.0**digits)


def unit(v: Column) -> Column:
    """A vector over its length; both are worked out once a row, not once a component."""
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    held = F.transform(F.array(v), lambda w: F.struct(w.alias("v"), norm(w).alias("norm")))
    return F.transform(held, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["norm"]))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def retry_delay_s(attempts: Column, base: float = 30.0, longest: float = 604_800.0) -> Column:
    """Exponential backoff in seconds, capped."""
    return F.least(F.lit(longest), F.greatest(F.lit(30.0), F.lit(float(base))) * F.pow(F.lit(2.0), attempts - 1))
