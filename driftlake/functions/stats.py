"""Column functions: the four quantile conventions, robust scale, transforms and angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted array (no averaging)."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def nearest_rank(values: Column, q: float) -> Column:
    """Element floor(q * (n - 1) + 0.5) of the sorted array, q from 0 to 1."""
    return F.get(F.sort_array(values), F.floor(F.lit(q) * (F.size(values) - 1) + 0.5).cast("int"))


def ceil_rank(values: Column, q: float) -> Column:
    """Element ceil(q * n) - 1 of the sorted array."""
    return F.get(F.sort_array(values), F.greatest(F.lit(0), F.ceil(F.lit(q) * F.size(values)).cast("int") - 1))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(values)


def robust_scale(values: Column) -> Column:
    """1.4826 times the median absolute value; the 90th percentile where that is zero; 1e-4 at least."""
    a = F.transform(values, F.abs)
    mad = upper_median(a) * 1.4826
    return F.greatest(F.lit(1e-4), F.when(mad > 0, mad).otherwise(nearest_rank(a, 0.9)))


def huber_weight(x: Column, c: float = 1.345) -> Column:
    return F.when(F.abs(x) <= c, F.lit(1.0)).otherwise(F.lit(c) / F.abs(x))


def tukey_weight(x: Column, c: float = 4.685) -> Column:
    u = F.lit(1.0) - (x / c) * (x / c)
    return F.when(F.abs(x) < c, u * u).otherwise(F.lit(0.0))


def transform(dx: Column, dy: Column, theta: Column) -> Column:
    return F.struct(dx.cast("double").alias("dx"), dy.cast("double").alias("dy"), theta.cast("double").alias("theta"))


def then(a: Column, b: Column) -> Column:
    """First a, then b."""
    c, s = F.cos(b["theta"]), F.sin(b["theta"])
    return transform(c * a["dx"] - s * a["dy"] + b["dx"], s * a["dx"] + c * a["dy"] + b["dy"], a["theta"] + b["theta"])


def inverse(a: Column) -> Column:
    c, s = F.cos(a["theta"]), F.sin(a["theta"])
    return transform(-(c * a["dx"] + s * a["dy"]), s * a["dx"] - c * a["dy"], -a["theta"])


def wrap_angle(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))


def enum_name(text: Column) -> Column:
    """Forgiving names: letters and digits in upper case, all else as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def parse_series(text: Column) -> Column:
    """'x0;x1;...' as an array of doubles; what is no number is null."""
    return F.transform(F.split(text, ";"), lambda x: x.try_cast("double"))
