"""Number, place and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two places in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a vector of nearly no length stays nearly so."""
    n = F.greatest(norm(a), F.lit(1e-6))
    return F.transform(a, lambda x: x.cast("double") / n)


def right_closed(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the bin whose upper edge is the first at or above the value; the last label beyond all edges; null
    for null."""
    out = None
    for edge, label in zip(edges, labels, strict=False):
        out = F.when(value <= edge, label) if out is None else out.when(value <= edge, label)
    return out.when(value.isNotNull(), labels[len(edges)]) if len(labels) > len(edges) else out


def half(value: Column) -> Column:
    """The number as it comes back from 16 bits: 11 binary digits, ties to even; beyond 65504 infinite."""
    x = value.cast("double")
    unit_of = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14.0)) - 10)
    y = F.rint(x / unit_of) * unit_of
    return F.when(x == 0, x).when(F.abs(y) > 65504, F.signum(x) * F.lit(float("inf"))).otherwise(y)


def valid_price(price: Column, most: float = 1e8) -> Column:
    """The price as a double where it is above zero and below ``most``, else null."""
    p = price.cast("double")
    return F.when((p > 0) & (p < most), p)
