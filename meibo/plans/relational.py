"""Groups b to e: ordered, join, resolution and quality queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.functions import classify as C
from meibo.functions import era as E
from meibo.functions import text as X
from meibo.functions.keys import id_key
from meibo.operators import ordered as O
from meibo.operators import places as P
from meibo.operators import quality as Q
from meibo.operators import resolve as R
from meibo.operators.spatial import has_position, regions_of_points
from meibo.plans.problems import key_sql
from meibo.plans.scalars import base_sql, era_sql
from meibo.sources.tables import table


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segmented_output")


def stitch_segments(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each volume with their continuations."""
    return O.stitch(_segments(spark, d), "volume", "segment_id").select("volume", "first", "n_segments", "text")


def stitch_segments_neardup(spark: SparkSession, d: str) -> DataFrame:
    """The same, near-duplicate entries dropped."""
    return O.stitch_dropping_duplicates(_segments(spark, d), "volume", "segment_id")


def enumerate_entries(spark: SparkSession, d: str) -> DataFrame:
    """Standard segments of a page numbered in order; bodies under five characters keep their number."""
    s = _segments(spark, d).where("segment_type = 'standard'")
    n = O.enumerate_rows(s, ["segment_id"], ["volume", "source_page"], "entry_index")
    return n.where(F.length(F.trim("body_text")) >= 5).select("segment_id", "entry_index")


def era_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Career years in document order, "the same era" resolved."""
    b = table(spark, d, "biographies_extracted").select("bio_id", F.posexplode("career").alias("pos", "c")).select("bio_id", "pos", F.col("c.start_year_raw").alias("raw"))
    return O.carry_era(b.withColumn("raw", F.when(F.col("pos") % 3 == 2, F.regexp_replace("raw", "^(明治|大正|昭和|慶應)", "同")).otherwise(F.col("raw"))), ["bio_id"], ["pos"], "raw").select("bio_id", "pos", "western")


def child_row_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Relatives numbered within their person."""
    m = table(spark, d, "person_family_members")
    return R.ordered_row_number(m, ["person_id"], ["member_id"], "number").select("member_id", "person_id", F.concat(F.lit("R"), F.col("number").cast("string")).alias("relation_no"))


def sibling_order_check(spark: SparkSession, d: str) -> DataFrame:
    """Children whose years contradict their ordinals, per person and sex; the first numeral up to ten in the relation is the ordinal."""
    m = table(spark, d, "person_family_members").where(F.col("relation").rlike("[男女]$"))
    first = F.regexp_extract("relation", "[長一次二三四五六七八九十]", 0)
    rank = F.when(first == "長", 1).when(first == "次", 2).when(first != "", F.position(first, F.lit("一二三四五六七八九十")))
    m = m.select("member_id", "person_id", F.substring("relation", -1, 1).alias("sex"), rank.alias("rank"), "birth_year").where("rank is not null")
    return O.ordinal_order_conflicts(m, ["person_id", "sex"], "rank", "birth_year", ["member_id"]).select("member_id", "conflict")


def unique_role_check(spark: SparkSession, d: str) -> DataFrame:
    """Parents and spouses that a person has more than one of."""
    m = table(spark, d, "person_family_members").where("relation is not null")
    return O.unique_role_conflicts(m, ["person_id"], "relation", ["父", "母", "養父", "養母"]).where("conflict").select("member_id", "person_id", "relation")


def _known_places(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "locations").select(id_key("location_id").alias("loc"), "province", "country")
    return l.where("loc is not null").groupBy("loc").agg(F.max("province").alias("province"), F.max("country").alias("country"))


def latest_residence(spark: SparkSession, d: str) -> DataFrame:
    """Persons counted by the province of their latest job, its own location or its organisation's."""
    c = table(spark, d, "person_career").select("person_id", "row_id", "start_year", "is_current", id_key("organization_id").alias("org"), id_key("location_id").alias("own"))
    o = table(spark, d, "organizations").select(id_key("organization_id").alias("org"), id_key("location_id").alias("org_loc")).groupBy("org").agg(F.max("org_loc").alias("org_loc"))
    last = O.latest(c, ["person_id"], O.latest_job_order("start_year", "is_current", "row_id"))
    loc = last.join(o, "org", "left").select("person_id", P.located_by(F.col("own"), F.col("org_loc")).alias("loc"))
    return loc.join(_known_places(spark, d), "loc", "left").groupBy("province").agg(F.count(F.lit(1)).alias("n_persons"))


def gap_fill_years(spark: SparkSession, d: str) -> DataFrame:
    """Relatives' missing birth years from their neighbours in the person's list."""
    m = table(spark, d, "person_family_members").select("person_id", "member_id", "birth_year")
    return O.fill_years(m, ["person_id"], ["member_id"], "birth_year").select("member_id", "filled")


def next_entry_index(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's image and the next one's on the page."""
    return O.next_value(_segments(spark, d), ["volume", "source_page"], ["segment_id"], "source_image", "next_image").select("segment_id", "source_image", "next_image")


def longest_prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Career places by the longest location name they begin with."""
    return P.longest_prefix_join(table(spark, d, "person_career"), "place_name", table(spark, d, "locations"), "name").select("place_name", F.col("_entry").alias("location_name"))


# Names of regions, countries and trades that are no parent of an organisation.
SKIP_PARENTS = "朝鮮 臺灣 台灣 横濱 九州 奉天 滿洲 満洲 米国 米國 獨逸 英國 英国 佛國 佛国 鐵道 鉄道 臨時 農商務".split()


def org_hierarchy_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Organisations whose name continues another's."""
    return P.name_hierarchy(table(spark, d, "organizations").select("organization_id", "name").distinct(), "organization_id", "name", SKIP_PARENTS, table(spark, d, "locations"))


def geocode_places(spark: SparkSession, d: str) -> DataFrame:
    """Career places matched to a gazetteer made of the locations."""
    g = table(spark, d, "locations").where("geonameid is not null and latitude is not null").select("name", "geonameid", "latitude", "longitude", F.lit("PPL").alias("code"), F.when(F.col("country") == "ja", "JP").when(F.col("country") == "ko", "KR").otherwise("CN").alias("country")).distinct()
    p = table(spark, d, "person_career").select(F.col("place_name").alias("place"), F.lit(None).cast("string").alias("origin")).distinct()
    return P.geocode(p, g).select("place", "geonameid")


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """The first region each usable location lies in."""
    l = table(spark, d, "locations").where(has_position(F.col("latitude"), F.col("longitude")))
    pts = l.select(F.col("location_id").alias("_pid"), F.col("longitude").alias("_x"), F.col("latitude").alias("_y")).distinct()
    return P.first_region(pts, regions_of_points(pts, table(spark, d, "provinces"))).select(F.col("_pid").alias("location_id"), "region_id")


def remap_ids(spark: SparkSession, d: str) -> DataFrame:
    """Career rows per organisation after merging spellings of equal names."""
    o = table(spark, d, "organizations").select(id_key("organization_id").alias("organization_id"), "name").distinct()
    first = o.groupBy("name").agg(F.min("organization_id").alias("new_id"))
    m = o.join(first, "name").where("organization_id <> new_id").select(F.col("organization_id").alias("old_id"), "new_id")
    c = table(spark, d, "person_career").select(id_key("organization_id").alias("organization_id")).where("organization_id is not null")
    return R.remap(c, "organization_id", m).groupBy("organization_id").agg(F.count(F.lit(1)).alias("n"))


def remap_closure(spark: SparkSession, d: str) -> DataFrame:
    """Every organisation's topmost parent: the parent links as a remap, followed to its ends."""
    o = table(spark, d, "organizations").select(id_key("organization_id").alias("old_id"), id_key("parent_organization_id").alias("new_id")).where("old_id is not null")
    return R.close_remap(o.groupBy("old_id").agg(F.max("new_id").alias("new_id")))


def parent_depth(spark: SparkSession, d: str) -> DataFrame:
    """Steps from each organisation to its topmost parent."""
    o = table(spark, d, "organizations").select(id_key("organization_id").alias("organization_id"), id_key("parent_organization_id").alias("parent")).where("organization_id is not null").groupBy("organization_id").agg(F.max("parent").alias("parent"))
    return R.parent_depth(o, "organization_id", "parent").select("organization_id", "depth")


def semi_anti_resume(spark: SparkSession, d: str) -> DataFrame:
    """Customers with and without orders: what a resumed run would skip and do."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    done = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("done"))
    todo = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("todo"))
    return done.unionByName(todo)


def header_in_row(spark: SparkSession, d: str) -> DataFrame:
    """Header centres assigned to the first horizontal range of the page that holds them."""
    s = _segments(spark, d)
    c = P.box_centre(F.col("bbox_header"))
    pts = s.where("bbox_header is not null").select("volume", "source_page", "segment_id", c["x"].alias("x"))
    rng = s.where("segment_x_range is not null").select("volume", "source_page", F.col("segment_id").alias("range_id"), F.array(F.col("segment_x_range")[0], F.lit(-2147483648), F.col("segment_x_range")[1], F.lit(2147483647)).alias("box"))
    page = lambda df: df.withColumn("page", F.concat_ws("/", "volume", "source_page")).drop("volume", "source_page")
    return P.contained_in(page(pts).withColumn("y", F.lit(0)), page(rng), "page", "x", "y", "box", "range_id", "segment_id").select("segment_id", "range_id")


def row_to_page_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's nearest other header on the page by horizontal centre."""
    s = _segments(spark, d).where("bbox_header is not null").select(F.concat_ws("/", "volume", "source_page").alias("page"), "segment_id", P.box_centre(F.col("bbox_header"))["x"].alias("x"))
    other = s.select("page", F.col("segment_id").alias("other_id"), F.col("x").alias("ox"))
    met = s.join(other, "page").where("segment_id <> other_id")
    return met.groupBy("segment_id").agg(F.min_by("other_id", F.struct(F.abs(F.col("x") - F.col("ox")).alias("d"), F.col("other_id").alias("o"))).alias("other_id"))


def person_exact_groups(spark: SparkSession, d: str) -> DataFrame:
    """Relatives of equal folded name, birth year and sex in two volumes or more, with the places they differ in."""
    m = table(spark, d, "person_family_members").where("name <> '' and gender is not null").withColumn("vol", F.element_at("source_volume", 1))
    return R.exact_groups(m, [X.fold_col("name"), F.col("birth_year"), F.col("gender")], "member_id", "vol", ["vol", "member_id"], "place")


def person_band_tier(spark: SparkSession, d: str) -> DataFrame:
    """Relatives of equal name and person in two volumes or more with years at most three apart."""
    m = table(spark, d, "person_family_members").where("name is not null").select("person_id", "name", "member_id", "birth_year", F.element_at("source_volume", 1).alias("vol"))
    return R.band_groups(m, ["person_id", "name"], "member_id", "birth_year", "vol")


def decade_tier(spark: SparkSession, d: str) -> DataFrame:
    """Relatives of equal name and person whose birth years lie exactly ten years apart, in different volumes."""
    rel = table(spark, d, "person_family_members")
    m = rel.select("member_id", "name", "birth_year", F.element_at("source_volume", 1).alias("volume"), F.array("person_id").alias("orgs")).where("name is not null and birth_year is not null")
    return R.decade_pairs(m, "name", "member_id", "birth_year", "volume", "orgs")


def merge_last_non_null(spark: SparkSession, d: str) -> DataFrame:
    """The last known scalar values of each person's relatives by name; the romanised name only from rows of the first one's sex."""
    m = table(spark, d, "person_family_members").where("name is not null")
    return R.merge_last_non_null(m, ["person_id", "name"], ["member_id"], ["relation", "birth_year", "place"], ["name_latin"], "gender")


def dedup_fold_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Career rows of equal key folded, with the provenance of all."""
    c = table(spark, d, "person_career")
    return R.fold_provenance(c, ["person_id", "job_title", "organization_id", "start_year"], ["row_id"], ["source_volume", "source_page"], ["location_id"])


def subset_elimination(spark: SparkSession, d: str) -> DataFrame:
    """Career rows that add something to the others of the same person and organisation."""
    c = table(spark, d, "person_career").where("organization_id is not null").select("row_id", "person_id", "organization_id", "job_title", "start_year", "place_name")
    return R.drop_subsets(c, ["person_id", "organization_id"], ["job_title", "start_year", "place_name"], "row_id").select("row_id")


def fuzzy_name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Romanised organisation names of Jaro-Winkler similarity of 0.9 or more (plain ASCII, which the SQL engine compares by bytes)."""
    return R.fuzzy_pairs(table(spark, d, "organizations"), "organization_id", "name_en", 0.90, floor=True, boost_above=0.7)


def variant_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Hobbies grouped by folded spelling."""
    return R.variant_groups(table(spark, d, "person_hobbies"), "hobby")


def org_surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Institutions and employers of all biographies numbered by name."""
    b = table(spark, d, "biographies_extracted")
    n = b.select(F.explode(F.transform("career", lambda c: c["organization"])).alias("name")).unionByName(b.select(F.explode(F.transform("education", lambda e: e["institution"])).alias("name")))
    return O.number_rows(n.where("name is not null").distinct(), ["name"], "number").select("name", F.concat(F.lit("O"), F.col("number").cast("string")).alias("organization_id"))


def first_seen_ids(spark: SparkSession, d: str) -> DataFrame:
    """Career places numbered by first appearance."""
    return O.first_seen_ids(table(spark, d, "person_career"), "place_name", "row_id", "L")


def suffix_merge(spark: SparkSession, d: str) -> DataFrame:
    """Organisations that equal another's name without its corporate ending."""
    return R.suffix_merges(table(spark, d, "organizations").select("organization_id", "name").distinct(), "organization_id", "name")


def audit_year_rules(spark: SparkSession, d: str) -> DataFrame:
    """Audit of career years after the volume's year."""
    c = table(spark, d, "person_career")
    _, audit = Q.rule_null(c, Q.year_after(F.col("start_year"), E.volume_year(F.col("source_volume"))), "start_year", "row_id", "null_future_career_year", "year after publication")
    return audit


def audit_conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Audit of contradicting spouse relations; a subject with a career of their own is taken for a man here."""
    working = table(spark, d, "person_career").select("person_id", F.lit("m").alias("subject")).distinct()
    m = table(spark, d, "person_family_members").join(working, "person_id", "left").withColumn("subject", F.coalesce("subject", F.lit("f")))
    bad = Q.spouse_conflicts(m, "person_id", "relation", "subject").where("conflict")
    return Q.audit_rows(bad, "member_id", "null_spouse", "relation", F.col("relation"), F.lit(None).cast("string"), "wife and husband")


def null_stale_refs(spark: SparkSession, d: str) -> DataFrame:
    """Organisations per location after references to hollow locations are emptied."""
    l = table(spark, d, "locations").where("latitude is null and province is null").select("location_id")
    o = table(spark, d, "organizations").select("organization_id", "location_id").distinct()
    return Q.stale_refs(o, "location_id", l, "location_id").groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))


def org_location_mode(spark: SparkSession, d: str) -> DataFrame:
    """The commonest career location of organisations whose places lie within 200 km."""
    c = table(spark, d, "person_career").select(id_key("organization_id").alias("org"), id_key("location_id").alias("loc"), "row_id").where("org is not null and loc is not null")
    l = table(spark, d, "locations").where(has_position(F.col("latitude"), F.col("longitude"))).select(id_key("location_id").alias("loc"), "latitude", "longitude").distinct()
    spread = P.organisation_spread(c.select("org", "loc").distinct().join(l, "loc"), "org", "latitude", "longitude").where("spread_km <= 200")
    return P.commonest(c, "org", "loc", "row_id").join(spread, "org").select("org", "loc", F.round("spread_km", 6).alias("spread_km"))


def normalise_answers(spark: SparkSession, d: str) -> DataFrame:
    """Education and career of the subjects as flat rows, era dates moved out of wrong fields."""
    b = table(spark, d, "biographies_extracted")
    e = b.select("bio_id", F.posexplode("education").alias("pos", "e"))
    inst, raw = E.relocate_era(F.col("e.institution"), F.col("e.year_raw"))
    return e.select("bio_id", "pos", inst.alias("institution"), raw.alias("year_raw"), E.valid_year("e.year_graduated", 1850, 1943).alias("year_graduated"))


def phantom_relatives(spark: SparkSession, d: str) -> DataFrame:
    """Relatives without any identity, and false job titles, counted."""
    m = Q.phantom_rows(table(spark, d, "person_family_members"), ["name", "birth_year", "place"]).groupBy().agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("phantom relative"))
    j = table(spark, d, "person_career").where(C.is_false_job(F.col("job_title"))).groupBy().agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("false job"))
    return m.unionByName(j)


_EC = "(select bio_id, pos, case when pos % 3 = 2 then regexp_replace(raw, '^(明治|大正|昭和|慶應)', '同') else raw end as raw from (select bio_id, pos, c.start_year_raw as raw from (select bio_id, unnest(career) as c, generate_subscripts(career, 1) - 1 as pos from biographies_extracted)))"
_E, _N = era_sql("raw")
_FOLDS = (''.join(X.GROUPING), ''.join(X.GROUPING.values()))
_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"
_USABLE = "latitude between -90 and 90 and longitude between -180 and 180 and not (latitude = 0 and longitude = 0)"
_ORGS = "(select distinct organization_id, name from organizations)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        stitch_segments, stitch_segments_neardup, enumerate_entries, era_carry_forward, child_row_numbering, sibling_order_check, unique_role_check, latest_residence, gap_fill_years, next_entry_index, longest_prefix_lookup,
        org_hierarchy_prefix, geocode_places, point_in_polygon, remap_ids, remap_closure, parent_depth, semi_anti_resume, header_in_row, row_to_page_nearest, person_exact_groups, person_band_tier, decade_tier, merge_last_non_null,
        dedup_fold_provenance, subset_elimination, fuzzy_name_pairs, variant_grouping, org_surrogate_ids, first_seen_ids, suffix_merge, audit_year_rules, audit_conflict_pairs, null_stale_refs, org_location_mode, normalise_answers, phantom_relatives,
    )
}
SQL: dict[str, str] = {
    "stitch_segments": "select volume, min(segment_id) as first, count(*) as n_segments, string_agg(coalesce(body_text, ''), ' ' order by segment_id) as text from (select *, count(*) filter (segment_type = 'standard') over (partition by volume order by segment_id) as entry from segmented_output where segment_type in ('standard', 'orphan')) where entry > 0 group by volume, entry",
    "enumerate_entries": "select segment_id, entry_index from (select *, row_number() over (partition by volume, source_page order by segment_id) - 1 as entry_index from segmented_output where segment_type = 'standard') where length(trim(body_text)) >= 5",
    "era_carry_forward": f"select bio_id, cast(pos as int) as pos, {base_sql('used')} + num as western from (select *, case when era = '同' then last_value(case when era <> '同' and num is not null then era end ignore nulls) over (partition by bio_id order by pos rows unbounded preceding) else era end as used from (select bio_id, pos, {_E} as era, {_N} as num from {_EC}))",
    "child_row_numbering": "select member_id, person_id, 'R' || row_number() over (partition by person_id order by member_id) as relation_no from person_family_members",
    "sibling_order_check": "select member_id, coalesce(bool_or(fell) over (partition by person_id, sex), false) as conflict from (select *, known and birth_year < lag(case when known then birth_year end) over (partition by person_id, sex, known order by rk, member_id) as fell from (select member_id, person_id, right(relation, 1) as sex, birth_year, case f when '長' then 1 when '次' then 2 else strpos('一二三四五六七八九十', f) end as rk, birth_year is not null as known from (select *, regexp_extract(relation, '[長一次二三四五六七八九十]') as f from person_family_members where regexp_matches(relation, '[男女]$')) where f <> ''))",
    "unique_role_check": "select member_id, person_id, relation from (select *, count(*) over (partition by person_id, relation) as n from person_family_members where relation in ('父', '母', '養父', '養母')) where n > 1",
    "latest_residence": f"""with o as (select {key_sql('organization_id')} as org, max({key_sql('location_id')}) as org_loc from organizations group by 1), l as (select {key_sql('location_id')} as loc, max(province) as province from locations group by 1),
c as (select person_id, {key_sql('organization_id')} as org, {key_sql('location_id')} as own, row_number() over (partition by person_id order by (start_year is null), start_year desc nulls last, coalesce(is_current, false) desc, row_id) as rn from person_career)
select province, count(*) as n_persons from c left join o using (org) left join l on l.loc = coalesce(c.own, o.org_loc) where rn = 1 group by province""",
    "gap_fill_years": "select member_id, coalesce(cast(birth_year as double), case when b is not null and a is not null then (b + a) / 2.0 when b is not null then b + 0.5 when a is not null then a - 0.5 end) as filled from (select *, last_value(birth_year ignore nulls) over (partition by person_id order by member_id rows between unbounded preceding and 1 preceding) as b, first_value(birth_year ignore nulls) over (partition by person_id order by member_id rows between 1 following and unbounded following) as a from person_family_members)",
    "next_entry_index": "select segment_id, source_image, lead(source_image) over (partition by volume, source_page order by segment_id) as next_image from segmented_output",
    "longest_prefix_lookup": "select place_name, arg_max(name, length(name)) as location_name from (select distinct place_name from person_career where place_name is not null) join (select distinct name from locations where length(name) >= 2) on starts_with(place_name, name) group by place_name",
    "org_hierarchy_prefix": f"""with s as (select distinct c.name as child, p.name as parent from {_ORGS} c join (select distinct name from organizations where regexp_replace(name, '[^\u4e00-\u9fff]', '', 'g') not in ({", ".join(f"'{x}'" for x in SKIP_PARENTS)}) and regexp_replace(name, '[^\u4e00-\u9fff]', '', 'g') not in (select name from locations where name is not null)) p on starts_with(c.name, p.name) and length(p.name) >= 2 and length(p.name) <= length(c.name) - 2 where length(c.name) >= 4),
b as (select child, arg_max(parent, length(parent)) as parent from s group by child)
select c.organization_id as child_id, p.parent_id, b.child as child_name, b.parent as parent_name from b join {_ORGS} c on c.name = b.child join (select name, min(organization_id) as parent_id from organizations group by name) p on p.name = b.parent""",
    "geocode_places": """with g as (select distinct name, geonameid, case when country = 'ja' then 'JP' when country = 'ko' then 'KR' else 'CN' end as country from locations where geonameid is not null and latitude is not null),
p as (select distinct place_name as place, regexp_replace(place_name, '[^一-鿿ケヶ]', '', 'g') as t, regexp_matches(place_name, '郡.{1,10}(町|村)|[區区]|丁目|番地|番町') as jp from person_career where place_name is not null)
select place, arg_max(geonameid, (length(name), -geonameid)) as geonameid from p join g on length(g.name) >= 2 and starts_with(p.t, g.name) where not jp or g.country = 'JP' group by place""",
    "point_in_polygon": f"""with l as (select distinct location_id, latitude, longitude from locations where {_USABLE}), r as (select region_id, unnest(rings) as ring from provinces), v as (select region_id, ring, len(ring) as m, unnest(range(1, len(ring) + 1)) as i from r), e as (select region_id, ring[i].lon as x1, ring[i].lat as y1, ring[i % m + 1].lon as x2, ring[i % m + 1].lat as y2 from v)
select location_id, min(region_id) as region_id from (select l.location_id, e.region_id, count(*) as n from l join e on (e.y1 > l.latitude) <> (e.y2 > l.latitude) and l.longitude < (e.x2 - e.x1) * (l.latitude - e.y1) / (e.y2 - e.y1) + e.x1 group by all) where n % 2 = 1 group by location_id""",
    "remap_ids": f"with o as (select distinct {key_sql('organization_id')} as id, name from organizations), m as (select id, min(id) over (partition by name) as new_id from o), c as (select {key_sql('organization_id')} as id from person_career) select coalesce(m.new_id, c.id) as organization_id, count(*) as n from c left join (select id, min(new_id) as new_id from m group by id) m using (id) where c.id is not null group by 1",
    "remap_closure": f"with recursive m as (select * from (select {key_sql('organization_id')} as old_id, max({key_sql('parent_organization_id')}) as new_id from organizations group by 1) where old_id <> new_id), w(old_id, new_id, d) as (select old_id, new_id, 0 from m union all select w.old_id, m.new_id, d + 1 from w join m on m.old_id = w.new_id where d < 64) select old_id, arg_max(new_id, d) as new_id from w group by old_id",
    "parent_depth": f"with recursive o as (select {key_sql('organization_id')} as id, max({key_sql('parent_organization_id')}) as parent from organizations group by 1), w(id, up, d) as (select id, parent, case when parent is null then 0 else 1 end from o where id is not null union all select w.id, o.parent, d + 1 from w join o on o.id = w.up where o.parent is not null and d < 64) select id as organization_id, max(d) as depth from w group by id",
    "semi_anti_resume": "select c_mktsegment, count(*) as n, case when exists (select 1 from orders where o_custkey = c_custkey) then 'done' else 'todo' end as state from customer group by all",
    "header_in_row": "select a.segment_id, min(b.segment_id) as range_id from segmented_output a join segmented_output b using (volume, source_page) where a.bbox_header is not null and b.segment_x_range is not null and (a.bbox_header[1] + a.bbox_header[3]) / 2 between b.segment_x_range[1] and b.segment_x_range[2] group by a.segment_id",
    "row_to_page_nearest": "select a.segment_id, arg_min(b.segment_id, (abs((a.bbox_header[1] + a.bbox_header[3]) / 2 - (b.bbox_header[1] + b.bbox_header[3]) / 2), b.segment_id)) as other_id from segmented_output a join segmented_output b using (volume, source_page) where a.bbox_header is not null and b.bbox_header is not null and a.segment_id <> b.segment_id group by a.segment_id",
    "person_exact_groups": f"select ids[1] as canonical_id, ids[2:] as merged_ids, n_volumes, case when len(places) > 1 then places end as conflicts from (select list(member_id order by source_volume[1], member_id) as ids, count(distinct source_volume[1]) as n_volumes, list_sort(list(distinct place) filter (place is not null)) as places from person_family_members where name <> '' and gender is not null and birth_year is not null group by translate(name, '{_FOLDS[0]}', '{_FOLDS[1]}'), birth_year, gender) where n_volumes >= 2",
    "person_band_tier": "select person_id, name, min(member_id) as canonical_id, count(*) as n from person_family_members where name is not null group by person_id, name having count(distinct source_volume[1]) >= 2 and coalesce(max(birth_year) - min(birth_year), 0) <= 3",
    "decade_tier": "select a.member_id as id_a, b.member_id as id_b from person_family_members a join person_family_members b on a.name = b.name and b.birth_year = a.birth_year + 10 and a.person_id = b.person_id and a.source_volume[1] <> b.source_volume[1]",
    "merge_last_non_null": "select person_id, name, " + ", ".join(f"arg_max({c}, member_id) filter ({c} is not null) as {c}" for c in ("relation", "birth_year", "place")) + ", arg_max(name_latin, member_id) filter (name_latin is not null and gender is not distinct from first_gender) as name_latin from (select *, first_value(gender) over (partition by person_id, name order by member_id) as first_gender from person_family_members where name is not null) group by person_id, name",
    "subset_elimination": "with r as (select row_id, person_id, organization_id, list_filter([case when job_title not in ('', 'NULL') then 'job_title=' || job_title end, case when start_year is not null then 'start_year=' || start_year end, case when place_name not in ('', 'NULL') then 'place_name=' || place_name end], lambda x: x is not null) as d from person_career where organization_id is not null) select row_id from r where not exists (select 1 from r o where o.person_id is not distinct from r.person_id and o.organization_id = r.organization_id and len(o.d) > len(r.d) and list_has_all(o.d, r.d))",
    "fuzzy_name_pairs": "with n as (select distinct name_en as name from organizations where name_en <> '') select a.name as name_a, b.name as name_b, round_even(jaro_winkler_similarity(a.name, b.name), 3) as similarity from n a join n b on a.name < b.name where jaro_winkler_similarity(a.name, b.name) >= 0.9",
    "variant_grouping": f"select folded, arg_max(form, (cast(form = folded as int), n, form)) as canonical, count(*) as n_forms, cast(sum(n) as bigint) as n_rows from (select translate(hobby, '{_FOLDS[0]}', '{_FOLDS[1]}') as folded, hobby as form, count(*) as n from person_hobbies where hobby is not null group by 1, 2) group by folded",
    "org_surrogate_ids": "select name, 'O' || row_number() over (order by name) as organization_id from (select c.organization as name from (select unnest(career) as c from biographies_extracted) union select e.institution from (select unnest(education) as e from biographies_extracted)) where name is not null",
    "first_seen_ids": "select place_name, 'L' || row_number() over (order by f, place_name) as id from (select place_name, min(row_id) as f from person_career where place_name is not null group by 1)",
    "suffix_merge": f"with r as (select organization_id as id, translate(name, '{_FOLDS[0]}', '{_FOLDS[1]}') as norm from {_ORGS}), b as (select id, case when regexp_matches(norm, '.株式會社$') then left(norm, -4) when regexp_matches(norm, '.株式会社$') then left(norm, -4) when regexp_matches(norm, '.株式$') then left(norm, -2) when regexp_matches(norm, '.株$') then left(norm, -1) end as base from r) select b.id as old_id, min(h.new_id) as new_id from b join (select norm, min(id) as new_id from r group by norm) h on h.norm = b.base where b.id <> h.new_id group by b.id",
    "audit_year_rules": "select cast(row_id as varchar) as subject_id, 'null_future_career_year' as change_type, 'start_year' as field, cast(start_year as varchar) as old_value, cast(null as varchar) as new_value, 'year after publication' as reason from person_career where start_year > list_max(list_transform(source_volume, lambda v: case v when '1927' then 1927 when '1935' then 1935 when '1943A' then 1943 when '1943E' then 1943 end))",
    "audit_conflict_pairs": "select cast(member_id as varchar) as subject_id, 'null_spouse' as change_type, 'relation' as field, relation as old_value, cast(null as varchar) as new_value, 'wife and husband' as reason from (select *, bool_or(relation = '妻') over (partition by person_id) and bool_or(relation = '夫') over (partition by person_id) as pair, case when person_id in (select person_id from person_career) then 'm' else 'f' end as subject from person_family_members) where pair and ((subject = 'm' and relation = '夫') or (subject = 'f' and relation = '妻'))",
    "null_stale_refs": "select case when h.location_id is null then o.location_id end as location_id, count(*) as n from (select distinct organization_id, location_id from organizations) o left join (select distinct location_id from locations where latitude is null and province is null) h using (location_id) group by 1",
    "org_location_mode": f"""with c as (select {key_sql('organization_id')} as org, {key_sql('location_id')} as loc, row_id from person_career), l as (select distinct {key_sql('location_id')} as loc, latitude, longitude from locations where {_USABLE}),
p as (select distinct org, latitude, longitude from c join l using (loc) where org is not null), s as (select a.org, max({_HAV}) as spread_km from p a join p b using (org) group by a.org),
m as (select org, arg_max(loc, (n, -f)) as loc from (select org, loc, count(*) as n, min(row_id) as f from c where org is not null and loc is not null group by 1, 2) group by org)
select m.org, m.loc, round(s.spread_km, 6) as spread_km from m join s using (org) where s.spread_km <= 200""",
    "normalise_answers": "select bio_id, cast(pos as int) as pos, case when not coalesce(w, false) then inst end as institution, case when coalesce(w, false) and nullif(raw, '') is null then inst else raw end as year_raw, case when y between 1850 and 1943 then y end as year_graduated from (select bio_id, pos, e.institution as inst, e.year_raw as raw, e.year_graduated as y, regexp_matches(e.institution, '^(明|大|昭|同)[一二三四五六七八九十〇\\d・]+$') as w from (select bio_id, unnest(education) as e, generate_subscripts(education, 1) - 1 as pos from biographies_extracted))",
    "phantom_relatives": "select count(*) as n, 'phantom relative' as what from person_family_members where coalesce(nullif(name, ''), cast(birth_year as varchar), nullif(place, '')) is null union all select count(*), 'false job' from person_career where (job_title in ("
    + ", ".join(f"'{x}'" for x in C.RELATION_EXACT) + r") or regexp_matches(job_title, '^.{1,10}[の之]?妻$') or regexp_matches(job_title, '^(昭和?|大正?|明治?)[一二三四五六七八九十〇\d]{1,4}年?$')) and job_title not in (" + ", ".join(f"'{x}'" for x in C.LEGITIMATE_JOBS) + ")",
}
SQL["dedup_fold_provenance"] = (
    "with r as (select person_id, job_title, organization_id, start_year, row_id, location_id, source_volume, source_page from person_career),"
    " v as (select person_id, job_title, organization_id, start_year, list(x order by p) as source_volume from (select person_id, job_title, organization_id, start_year, x, min((row_id, i)) as p from (select *, unnest(source_volume) as x, generate_subscripts(source_volume, 1) as i from r) group by all) group by all),"
    " g as (select person_id, job_title, organization_id, start_year, list(x order by p) as source_page from (select person_id, job_title, organization_id, start_year, x, min((row_id, i)) as p from (select *, unnest(source_page) as x, generate_subscripts(source_page, 1) as i from r) group by all) group by all),"
    " a as (select person_id, job_title, organization_id, start_year, arg_min(location_id, row_id) filter (location_id is not null and row_id = f) as location_id, count(*) as n_rows from (select *, min(row_id) over (partition by person_id, job_title, organization_id, start_year) as f from r) group by all)"
    " select a.person_id, a.job_title, a.organization_id, a.start_year, a.location_id, coalesce(v.source_volume, []) as source_volume, coalesce(g.source_page, []) as source_page, a.n_rows from a"
    " left join v on (v.person_id, v.job_title, v.organization_id, v.start_year) is not distinct from (a.person_id, a.job_title, a.organization_id, a.start_year)"
    " left join g on (g.person_id, g.job_title, g.organization_id, g.start_year) is not distinct from (a.person_id, a.job_title, a.organization_id, a.start_year)"
)
