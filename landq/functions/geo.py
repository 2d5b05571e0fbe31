"""Geometry of parcels and of boxes on a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landq import dims

DEFAULT_CENTRE = (77.4126, 23.2599)


def ring_centroid(coordinates: Column, default: tuple[float, float] = DEFAULT_CENTRE) -> Column:
    """struct(lon, lat): mean of the outer ring's vertices, the closing one included."""
    ring = F.get(coordinates, F.lit(0))

    def mean(i: int, otherwise: float) -> Column:
        total = F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[i])
        return F.when(F.coalesce(F.size(ring), F.lit(0)) > 0, total / F.size(ring)).otherwise(F.lit(otherwise))
    return F.struct(mean(0, default[0]).alias("lon"), mean(1, default[1]).alias("lat"))


def parcel_verified(status: Column) -> Column:
    return F.coalesce(status.isin(dims.LEGACY_PUBLIC_STATUSES), F.lit(False))


def polygon_box(points: Column) -> Column:
    """struct(x, y, w, h) of a polygon given as [x, y] points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"),
                    (F.array_max(ys) - F.array_min(ys)).alias("h"))


def box_percent(box: Column, width: Column | float = 1000.0, height: Column | float = 1400.0) -> Column:
    """struct(left, top, width, height) in percent of the page, from pixels or from shares of 1."""
    page_w, page_h = (F.lit(v) if not isinstance(v, Column) else v for v in (width, height))
    share = (box["x"] <= 1.0) & (box["y"] <= 1.0) & (box["w"] <= 1.0)

    def of(name: str, page: Column, as_share: Column) -> Column:
        return F.when(share, as_share).otherwise(box[name] / page * 100)
    return F.struct(of("x", page_w, F.greatest(F.lit(0.0), box["x"] * 100.0)).alias("left"),
                    of("y", page_h, F.greatest(F.lit(0.0), box["y"] * 100.0)).alias("top"),
                    of("w", page_w, F.least(F.lit(100.0), box["w"] * 100.0)).alias("width"),
                    of("h", page_h, F.least(F.lit(100.0), box["h"] * 100.0)).alias("height"))
