"""Queries of the general problems 1 to 3 over the biographical tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.functions.keys import id_key
from meibo.operators.orphans import orphan_references, orphan_report, parent_intervals, references
from meibo.operators.spatial import has_position, near_pairs, regions_of_points
from meibo.operators.variants import CAREER, EDUCATION, RELATIVE, nested_nodes, subtype_table, variant_catalogue
from meibo.sources.tables import table

NEAR_KM = 2.0


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    career, edu = table(spark, d, "person_career"), table(spark, d, "person_family_education")
    orgs, locs = table(spark, d, "organizations"), table(spark, d, "locations")
    volume = F.element_at("source_volume", 1)
    month = F.date_format("loaded_at", "yyyy-MM")
    to_orgs = references(career, "person_career", "row_id", "organization_id", period=volume).unionByName(
        references(edu, "person_family_education", "row_id", "organization_id", period=volume)
    )
    to_locs = references(career, "person_career", "row_id", "location_id", period=volume).unionByName(
        references(orgs, "organizations", "row_id", "location_id", period=month)
    )
    return orphan_references(to_orgs, parent_intervals(orgs, "organization_id")).unionByName(
        orphan_references(to_locs, parent_intervals(locs, "location_id"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference to an organisation or location that is missing, deleted or not yet loaded."""
    return _orphans(spark, d).select("table_name", "row_id", "ref_field")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, period (volume; month of loading for organisations) and status."""
    return orphan_report(_orphans(spark, d))


def _located(spark: SparkSession, d: str) -> DataFrame:
    locs = table(spark, d, "locations").select(id_key("location_id").alias("location_id"), "latitude", "longitude", "province")
    return locs.where(F.col("location_id").isNotNull() & has_position(F.col("latitude"), F.col("longitude")))


def p2_near(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different locations at most 2 km apart."""
    return near_pairs(_located(spark, d), "location_id", "latitude", "longitude", NEAR_KM)


def p2_inside(spark: SparkSession, d: str) -> DataFrame:
    """The region each location lies in where the recorded province is missing or another one."""
    locs, regions = _located(spark, d), table(spark, d, "provinces")
    spots = locs.select(F.struct("latitude", "longitude").alias("_pid"), F.col("longitude").alias("_x"), F.col("latitude").alias("_y")).distinct()
    held = regions_of_points(spots, regions)
    named = held.join(regions.select("region_id", F.col("province").alias("region_province")), "region_id")
    hit = locs.withColumn("_pid", F.struct("latitude", "longitude")).join(named, "_pid")
    wrong = F.col("province").isNull() | (F.col("province") != F.col("region_province"))
    return hit.where(wrong).select("location_id", "region_id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs and the regions of locations whose province is missing or wrong."""
    near = p2_near(spark, d).select(F.lit("near").alias("kind"), "key_a", "key_b")
    inside = p2_inside(spark, d).select(F.lit("inside").alias("kind"), F.col("location_id").alias("key_a"), F.col("region_id").alias("key_b"))
    return near.unionByName(inside)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested_nodes(table(spark, d, "biographies_extracted"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every relative, and every education or career entry of one, with its parent link."""
    return _nodes(spark, d).select("bio_id", "parent_path", "node_path")


def p3_relatives(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of relatives at any depth."""
    return subtype_table(_nodes(spark, d), RELATIVE)


def p3_education(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of relatives' education entries."""
    return subtype_table(_nodes(spark, d), EDUCATION)


def p3_career(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of relatives' career entries."""
    return subtype_table(_nodes(spark, d), CAREER)


def p3_variants(spark: SparkSession, d: str) -> DataFrame:
    """The structural variants met, with the number of objects of each."""
    return variant_catalogue(_nodes(spark, d))


_KEY = (
    "nullif(nullif(regexp_replace(regexp_replace(upper(translate(@COLUMN@, "
    "'" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "', "
    "'" + "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + "'))"
    ", '^[\\s\\p{Z}\\p{Cc}]+|[\\s\\p{Z}\\p{Cc}]+$', '', 'g'), '^(\\D*)0+(\\d)', '\\1\\2'), ''), 'NULL')"
)


def key_sql(c: str) -> str:
    """``id_key`` of a column as DuckDB SQL."""
    return _KEY.replace("@COLUMN@", c)


def _ref_sql(name: str, field: str, target: str, period: str) -> str:
    return f"""select '{name}' as table_name, r.row_id, '{field}' as ref_field, {period} as period, case
      when not exists (select 1 from p_{target} p where p.k = r.k) then 'missing'
      when exists (select 1 from p_{target} p where p.k = r.k and p.loaded_at <= r.loaded_at and (p.deleted_at is null or p.deleted_at > r.loaded_at)) then null
      when exists (select 1 from p_{target} p where p.k = r.k and p.loaded_at <= r.loaded_at) then 'deleted' else 'late' end as status
      from (select *, {key_sql(field)} as k from {name}) r where r.k is not null"""


_P1 = f"""with p_organizations as (select distinct {key_sql('organization_id')} as k, loaded_at, deleted_at from organizations),
p_locations as (select distinct {key_sql('location_id')} as k, loaded_at, deleted_at from locations),
o as ({_ref_sql('person_career', 'organization_id', 'organizations', 'source_volume[1]')} union all
{_ref_sql('person_family_education', 'organization_id', 'organizations', 'source_volume[1]')} union all
{_ref_sql('person_career', 'location_id', 'locations', 'source_volume[1]')} union all
{_ref_sql('organizations', 'location_id', 'locations', "strftime(r.loaded_at, '%Y-%m')")})
"""

_USABLE = "latitude between -90 and 90 and longitude between -180 and 180 and not (latitude = 0 and longitude = 0)"
_LOCS = f"l as (select distinct {key_sql('location_id')} as k, latitude, longitude, province from locations where {_USABLE})"
_NEAR = f"""select distinct a.k as key_a, b.k as key_b from l a join l b on a.k < b.k and abs(a.latitude - b.latitude) < 0.02
where 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2)
 + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) <= {NEAR_KM}"""
_INSIDE = """select distinct l.k as location_id, g.region_id from l join (
 select l.latitude, l.longitude, e.region_id, count(*) as n from (select distinct latitude, longitude from l) l join e
 on (e.y1 > l.latitude) <> (e.y2 > l.latitude) and l.longitude < (e.x2 - e.x1) * (l.latitude - e.y1) / (e.y2 - e.y1) + e.x1
 group by all) g on g.latitude = l.latitude and g.longitude = l.longitude and g.n % 2 = 1
 join provinces p on p.region_id = g.region_id where l.province is null or l.province <> p.province"""
_EDGES = """r as (select region_id, unnest(rings) as ring from provinces),
v as (select region_id, ring, len(ring) as m, unnest(range(1, len(ring) + 1)) as i from r),
e as (select region_id, ring[i].lon as x1, ring[i].lat as y1, ring[i % m + 1].lon as x2, ring[i % m + 1].lat as y2 from v)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p2_near, p2_inside, p3_found, p3_relatives, p3_education, p3_career, p3_variants)
}
SQL: dict[str, str] = {
    "p1_found": _P1 + "select table_name, row_id, ref_field from o where status is not null",
    "p1_report": _P1 + "select table_name, ref_field, period, status, count(*) as n_orphans from o where status is not null group by all",
    "p2_near": f"with {_LOCS} {_NEAR}",
    "p2_inside": f"with {_LOCS}, {_EDGES} {_INSIDE}",
    "p2_found": f"with {_LOCS}, {_EDGES} select 'near' as kind, key_a, key_b from ({_NEAR}) union all select 'inside', location_id, region_id from ({_INSIDE})",
}
