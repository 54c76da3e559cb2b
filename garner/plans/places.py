"""Places: coordinates, known places, venue tiers and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garner.functions.geo import meters, venue_reach
from garner.sources.tables import table

#: Points of interest to which fixes are compared: name, category, latitude, longitude.
POINTS = (("Quay cafe", "cafe", 45.0, 0.0), ("Quay shop", "shop", 45.0, 0.001), ("Mill", "museum", 50.0, 5.0), ("Station", "station", 55.0, 10.0), ("Tower", "museum", 60.0, 12.0), ("Market", "shop", 48.0, 2.0))


def _points() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(y).alias("lat"), F.lit(x).alias("lon")) for n, c, y, x in POINTS])


def fixes(spark: SparkSession, folder: str) -> DataFrame:
    """(event_uid, lat, lon) of events whose place is written as coordinates within range."""
    e = table(spark, folder, "calendar_events", "event_uid", "location_address").distinct()
    form = r"^\s*(-?[0-9]{1,2}\.[0-9]+)\s*,\s*(-?[0-9]{1,3}\.[0-9]+)\s*$"
    e = e.where(F.col("location_address").rlike(form))
    part = lambda i: F.regexp_extract("location_address", form, i).try_cast("double")
    return e.select("event_uid", part(1).alias("lat"), part(2).alias("lon")).where("lat between -90 and 90 and lon between -180 and 180")


def _distances(spark: SparkSession, folder: str) -> DataFrame:
    f = fixes(spark, folder).withColumn("p", F.explode(_points()))
    return f.select("event_uid", "p.name", "p.category", meters(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon")).alias("distance"))


def point_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Metres from each fix to each point."""
    return _distances(spark, folder).select("event_uid", "name", F.round("distance", 1).alias("meters"))


def venue_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Tier of each point for each fix of wide accuracy: a candidate within reach without a rival of another category at the same whole metre."""
    reach = venue_reach(F.lit(600_000.0))
    d = _distances(spark, folder).withColumn("whole", F.round("distance")).withColumn("near", F.col("distance") <= reach)
    rivals = F.size(F.collect_set(F.when(F.col("near"), F.col("category"))).over(Window.partitionBy("event_uid", "whole")))
    tier = F.when(F.col("near") & (rivals <= 1), "venue_candidate").otherwise("nearby_poi")
    return d.select("event_uid", "name", tier.alias("tier"))


def top_points(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest points of each fix, by distance and name."""
    w = Window.partitionBy("event_uid").orderBy("distance", "name")
    return _distances(spark, folder).withColumn("place", F.row_number().over(w)).where("place <= 3").select("event_uid", "place", "name")


def place_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label of each event's place: the point within 60 km, the venue's title, the address, or the coordinates' text."""
    e = table(spark, folder, "calendar_events", "event_uid", "location_title", "location_address").groupBy("event_uid").agg(F.min("location_title").alias("title"), F.min("location_address").alias("address"))
    known = _distances(spark, folder).where("distance <= 60000").groupBy("event_uid").agg(F.min(F.struct("distance", "name")).alias("k")).select("event_uid", F.col("k.name").alias("known"))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return e.join(known, "event_uid", "left").select("event_uid", F.coalesce("known", blank("title"), blank("address"), F.lit("")).alias("label"))


QUERIES = {f.__name__: f for f in (fixes, point_distances, venue_tiers, top_points, place_labels)}

_FIX = r"""f as (
  select event_uid, try_cast(regexp_extract(location_address, '^\s*(-?[0-9]{1,2}\.[0-9]+)\s*,\s*(-?[0-9]{1,3}\.[0-9]+)\s*$', 1) as double) as lat,
         try_cast(regexp_extract(location_address, '^\s*(-?[0-9]{1,2}\.[0-9]+)\s*,\s*(-?[0-9]{1,3}\.[0-9]+)\s*$', 2) as double) as lon
  from (select distinct event_uid, location_address from calendar_events)
  where regexp_matches(location_address, '^\s*(-?[0-9]{1,2}\.[0-9]+)\s*,\s*(-?[0-9]{1,3}\.[0-9]+)\s*$'))"""
_POINTS = "p(name, category, lat, lon) as (values " + ", ".join(f"('{n}', '{c}', cast({y} as double), cast({x} as double))" for n, c, y, x in POINTS) + ")"
_DIST = f"""{_FIX}, {_POINTS}, d as (
  select f.event_uid, p.name, p.category, 2 * 6371008.8 * asin(sqrt(sin((radians(p.lat) - radians(f.lat)) / 2) ** 2 + cos(radians(f.lat)) * cos(radians(p.lat)) * sin(radians(p.lon - f.lon) / 2) ** 2)) as distance
  from f, p where f.lat between -90 and 90 and f.lon between -180 and 180)"""
SQL = {
    "fixes": f"with {_FIX} select * from f where lat between -90 and 90 and lon between -180 and 180",
    "point_distances": f"with {_DIST} select event_uid, name, round(distance, 1) as meters from d",
    "venue_tiers": f"""
with {_DIST}, r as (select *, round(distance) as whole, distance <= 600000 as near from d)
select a.event_uid, a.name, case when a.near and not exists (select 1 from r b where b.event_uid = a.event_uid and b.near and b.whole = a.whole and b.category <> a.category) then 'venue_candidate' else 'nearby_poi' end as tier from r a""",
    "top_points": f"with {_DIST} select event_uid, cast(place as integer) as place, name from (select *, row_number() over (partition by event_uid order by distance, name) as place from d) where place <= 3",
    "place_labels": f"""
with {_DIST}, e as (select event_uid, min(location_title) as t, min(location_address) as a from calendar_events group by 1),
k as (select event_uid, arg_min(name, (distance, name)) as known from d where distance <= 60000 group by 1)
select e.event_uid, coalesce(k.known, nullif(trim(t), ''), nullif(trim(a), ''), '') as label from e left join k using (event_uid)""",
}
