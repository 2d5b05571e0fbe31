"""Parcel geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.functions import geo
from landq.plans.suite import Suite
from landq.plans.tables import RING

suite = Suite()
q = suite.query


@q("GE01_ring_centroid", """select id, round(case when id % 9 = 0 then 77.4126::double else (lon * 3 + (lon + 0.0025::double) * 2) / 5 end, 6) as lon,
   round(case when id % 9 = 0 then 23.2599::double else (lat * 3 + (lat - 0.0025::double) * 2) / 5 end, 6) as lat from geo""", "geo")
def _(v):
    rings = v.geo.select("id", F.expr(f"case when id % 9 = 0 then array() else array({RING}) end").alias("coordinates"))
    centre = geo.ring_centroid(F.col("coordinates"))
    return rings.select("id", centre.alias("c")).select("id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@q("GE02_parcel_verified", "select id, status in ('APPROVED', 'PUBLISHED') as verified from lr", "lr")
def _(v):
    return v.lr.select("id", geo.parcel_verified(F.col("status")).alias("verified"))
