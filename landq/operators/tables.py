"""Table maintenance: replace, conform, upsert, purge, export."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows of keys that have no new rows, and all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def conform_schema(df: DataFrame, additions: dict[str, tuple[str, object]]) -> DataFrame:
    """Add the columns that are absent, with their type and default; present columns stay as they are."""
    absent = {c: F.lit(default).cast(kind) for c, (kind, default) in additions.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def upsert_partial(table: DataFrame, changes: DataFrame, key: str, insert: bool = False) -> DataFrame:
    """Set only the supplied columns: a NULL in `changes` keeps the stored value. `changes` has one row per key."""
    columns = [c for c in changes.columns if c != key and c in table.columns]
    renamed = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = table.join(renamed, key, "full" if insert else "left")
    return joined.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
                           for c in table.columns])


def purge_predicate(names: list[str] = (), patterns: list[str] = (), districts: list[str] = ()) -> Column:
    """True for records to delete: listed owner, owner like a pattern, or listed district."""
    parts = []
    if names:
        parts.append(F.col("owner_name").isin(list(names)))
    parts += [F.lower("owner_name").like(p.lower()) for p in patterns]
    if districts:
        parts.append(F.col("district").isin(list(districts)))
    return reduce(or_, parts, F.lit(False))


def purge(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true; as in SQL DELETE, an unknown predicate keeps the row."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def export_corrections(corrections: DataFrame, limit: int = 1000) -> DataFrame:
    """The newest corrections with ISO time stamps."""
    newest = corrections.orderBy(F.desc("id")).limit(limit)
    return newest.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def geojson_polygon(ring: Column) -> Column:
    """GeoJSON text of a polygon with one ring of [lon, lat] points."""
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


POLYGON = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
])


def feature_collection(parcels: DataFrame, properties: list[str], geometry: str = "geometry") -> DataFrame:
    """One GeoJSON Feature text per parcel; the lines of the written file form the collection."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
                       F.col(geometry).alias("geometry"))
    return parcels.select("id", F.to_json(feature).alias("feature"))
