"""Small operators of the survey on the biographical tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meibo.functions import classify as C
from meibo.functions import era as E
from meibo.functions import similarity as M
from meibo.functions import text as X
from meibo.functions.keys import id_key
from meibo.operators import catalogue as K
from meibo.operators import cleaning as L
from meibo.operators import ordered as O
from meibo.operators import places as P
from meibo.operators import quality as Q
from meibo.operators import resolve as R
from meibo.operators import stats as S
from meibo.plans.problems import key_sql
from meibo.session import shared_dir
from meibo.sources import readers, sinks
from meibo.sources.tables import table


def exclusive_roles(spark: SparkSession, d: str) -> DataFrame:
    """Relatives of a person that has both a father and an adoptive father, roles taken here to exclude each other."""
    m = table(spark, d, "person_family_members").where("person_id is not null")
    return O.exclusive_pair_conflicts(m, ["person_id"], "relation", "父", "養父").where("conflict").select("member_id", "relation")


def early_events(spark: SparkSession, d: str) -> DataFrame:
    """Audit of jobs before sixteen and degrees before fourteen years after birth."""
    b = table(spark, d, "biographies_extracted")
    jobs = b.select("bio_id", "birth_year", F.explode("career").alias("c")).select("bio_id", "birth_year", F.col("c.start_year").alias("year"))
    degrees = b.select("bio_id", "birth_year", F.explode("education").alias("c")).select("bio_id", "birth_year", F.col("c.year_graduated").alias("year"))
    _, a = Q.rule_null(jobs, Q.too_young(F.col("year"), F.col("birth_year"), 16), "year", "bio_id", "null_year", "job too early")
    _, e = Q.rule_null(degrees, Q.too_young(F.col("year"), F.col("birth_year"), 14), "year", "bio_id", "null_year", "degree too early")
    return a.unionByName(e).select("subject_id", "old_value", "reason")


def suspicious_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that are of another kind than their table: relations as organisations, organisations as places, false titles."""
    n = table(spark, d, "organizations").select("name").unionByName(table(spark, d, "locations").select("name")).unionByName(table(spark, d, "person_career").select(F.col("job_title").alias("name"))).where("name is not null").distinct()
    return n.select("name", C.is_relation_org(F.col("name")).alias("relation"), C.is_org_place(F.col("name")).alias("organisation"), C.is_false_job(F.col("name")).alias("false_job"))


def null_org_places(spark: SparkSession, d: str) -> DataFrame:
    """Organisations that lose their location as its name is an organisation's."""
    o = table(spark, d, "organizations").select("row_id", id_key("location_id").alias("location_id"))
    l = table(spark, d, "locations").select(id_key("location_id").alias("location_id"), "name")
    return L.null_org_places(o, l, C.is_org_place(F.col("name")))


def girls_school_rule(spark: SparkSession, d: str) -> DataFrame:
    """School records of male relatives at girls' schools, which are deleted."""
    e = table(spark, d, "person_family_education").select("row_id", "person_id", "relation_id", id_key("organization_id").alias("org"))
    sex = table(spark, d, "person_family_members").where("relation_id is not null").groupBy("person_id", "relation_id").agg(F.max("gender").alias("gender"))
    names = table(spark, d, "organizations").select(id_key("organization_id").alias("org"), "name").groupBy("org").agg(F.max("name").alias("school"))
    full = e.join(sex, ["person_id", "relation_id"], "left").join(names, "org", "left")
    return Q.males_at_girls_schools(full, F.col("gender"), X.fold_col("school"))[1].select("row_id", "school")


def deictic_organisations(spark: SparkSession, d: str) -> DataFrame:
    """Organisations of extracted careers, null where the name only refers to one named before."""
    c = table(spark, d, "biographies_extracted").select("bio_id", F.posexplode("career").alias("pos", "c")).select("bio_id", "pos", F.col("c.organization").alias("organization"))
    return Q.null_where(c, F.col("organization").isin(*Q.DEICTIC_ORGS), ["organization"])


def phantom_cascade(spark: SparkSession, d: str) -> DataFrame:
    """School records left once those of relatives without name, year and place are gone with them."""
    m = table(spark, d, "person_family_members")
    gone = Q.phantom_rows(m, ["name", "birth_year", "place"])
    kept = Q.without_children(table(spark, d, "person_family_education"), gone, ["person_id", "relation_id"])
    return kept.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))


def subject_genders(spark: SparkSession, d: str) -> DataFrame:
    """The sex of each person by the spouses among the relatives."""
    m = table(spark, d, "person_family_members").where("person_id is not null")
    has = lambda p: F.coalesce(F.max(F.col("relation").rlike(p).cast("int")), F.lit(0)) > 0
    g = m.groupBy("person_id").agg(has("妻").alias("wife"), has("夫$").alias("husband"))
    return g.select("person_id", C.subject_gender(F.col("wife"), F.col("husband"), F.lit(False), F.lit(False), F.lit(None).cast("string")).alias("gender"))


def text_projections(spark: SparkSession, d: str) -> DataFrame:
    """Places, titles, ranks and labels cut out of career rows."""
    c = table(spark, d, "person_career")
    return c.select(
        "row_id", X.cjk_only("place_name").alias("han"), X.place_from_org("place_name").alias("region"), F.array_join(X.rank_tokens(F.concat_ws(" ", "job_title", "place_name")), "/").alias("ranks"),
        X.suffix_title(F.substring("job_title", -1, 1), "place_name").alias("title"), X.display_place("place_name", "location_id", F.lit("")).alias("shown"),
        X.page_number(F.element_at("source_page", 1)).alias("page"), X.split_last(F.concat_ws("_", F.array_join("source_volume", "+"), "person_id")).alias("id"),
    ).select("row_id", "han", "region", "ranks", "title", "shown", "page", F.col("id.head").alias("head"), F.col("id.tail").alias("tail"))


def era_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Raw years of extracted careers by the era they name."""
    c = table(spark, d, "biographies_extracted").select(F.explode("career").alias("c")).select(E.era_name(F.col("c.start_year_raw")).alias("era"))
    return c.groupBy("era").agg(F.count(F.lit(1)).alias("n"))


def activity_years(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of each person by the year they sort by: their own, else the latest volume's if current."""
    c = table(spark, d, "person_career").withColumn("volume_year", E.volume_year(F.col("source_volume")))
    c = c.withColumn("year", L.activity_order("start_year", "is_current", "volume_year"))
    w = Window.partitionBy("person_id").orderBy(F.col("year").desc_nulls_last(), "row_id")
    return c.select("row_id", "year", F.row_number().over(w).alias("place"))


def page_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a page from right to left, then downwards."""
    s = table(spark, d, "segmented_output").select("segment_id", "volume", "source_page", F.get("segment_x_range", F.lit(0)).alias("x"), F.get("bbox_header", F.lit(1)).alias("y"))
    order = L.reading_order([], "x", "y")
    return s.select("segment_id", F.row_number().over(Window.partitionBy("volume", "source_page").orderBy(*order, "segment_id")).alias("place"))


def path_sort_keys(spark: SparkSession, d: str) -> DataFrame:
    """The numbers in each image's path, by which scans sort."""
    s = table(spark, d, "segmented_output").select("source_image").distinct()
    return s.select("source_image", F.array_join(O.path_numbers(F.col("source_image")), "/").alias("numbers"))


def year_density(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of starting years per group of occupations."""
    c = table(spark, d, "person_career").where("hisco_major is not null and start_year between 1800 and 1950")
    grid = spark.range(1800, 1951).select(F.col("id").cast("int").alias("year"))
    return L.density(c, "hisco_major", "start_year", grid, "year").select("hisco_major", "year", F.round("density", 8).alias("density"))


def restricted_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Persons with a job in one of three locations, and how many all have without a choice."""
    c = table(spark, d, "person_career").select("person_id", id_key("location_id").alias("location_id"))
    chosen = c.where(K.place_restriction(F.col("location_id"), ["L3", "L12", "L40"])).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    every = c.where(K.place_restriction(F.col("location_id"), None)).groupBy("person_id").agg(F.count(F.lit(1)).alias("n_all"))
    return every.join(chosen, "person_id", "left").select("person_id", "n_all", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def relatives_per_person(spark: SparkSession, d: str) -> DataFrame:
    """Persons by their number of relatives, those with none included."""
    n = S.zero_filled(table(spark, d, "person_career").where("person_id is not null"), table(spark, d, "person_family_members"), "person_id")
    return n.groupBy("n").agg(F.count(F.lit(1)).alias("n_persons"))


def types_per_point(spark: SparkSession, d: str) -> DataFrame:
    """Distinct industries of the organisations at each place, by rounded coordinates."""
    l = table(spark, d, "locations").where("latitude is not null and longitude is not null").select(id_key("location_id").alias("loc"), F.round("latitude", 0).alias("lat"), F.round("longitude", 0).alias("lon")).distinct()
    o = table(spark, d, "organizations").select(id_key("location_id").alias("loc"), "isic_section").where("isic_section is not null")
    return o.join(l, "loc").groupBy("lat", "lon").agg(F.count_distinct("isic_section").alias("n"))


def whole_runs(spark: SparkSession, d: str) -> DataFrame:
    """Persons whose volumes are exactly the two of 1943: a filter at its default is one of equal sets."""
    v = table(spark, d, "person_career").where("person_id is not null").select("person_id", F.explode("source_volume").alias("v")).groupBy("person_id").agg(F.collect_set("v").alias("s"))
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return v.where(same(F.col("s"), F.array(F.lit("1943A"), F.lit("1943E")))).select("person_id")


def surname_splits(spark: SparkSession, d: str) -> DataFrame:
    """Relatives' names that begin with a surname of the extracted persons."""
    people = table(spark, d, "biographies_extracted").select(F.substring("name", 1, 2).alias("surname")).where("length(surname) = 2").distinct()
    return L.family_names(table(spark, d, "person_family_members"), "name", people, "surname")


def contained_names(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of hobbies of a person of which one holds the other."""
    h = table(spark, d, "person_hobbies").where("hobby is not null and person_id is not null").select("person_id", "hobby").distinct()
    return h.join(h.withColumnRenamed("hobby", "other"), "person_id").where((F.col("hobby") < F.col("other")) & M.either_contains(F.col("hobby"), F.col("other")))


def json_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as JSON lines and read again, with a missing second file."""
    path = f"{shared_dir(spark)}/meibo/lines-{uuid.uuid4().hex}"
    schema = "segment_id BIGINT, header_ocr STRING, body_text STRING, segment_x_range ARRAY<INT>"
    sinks.write_json_lines(table(spark, d, "segmented_output").select("segment_id", "header_ocr", "body_text", "segment_x_range"), path)
    back = readers.json_lines(spark, path, schema).unionByName(readers.json_lines(spark, path + "-missing", schema))
    return back.select("segment_id", "header_ocr", "body_text", F.get("segment_x_range", F.lit(0)).alias("x"))


def append_twice(spark: SparkSession, d: str) -> DataFrame:
    """An append log that gets the organisations in two overlapping batches: every key once."""
    path = f"{shared_dir(spark)}/meibo/log-{uuid.uuid4().hex}"
    o = table(spark, d, "organizations").select("row_id", "name")
    first = sinks.append_new(o.where("row_id % 3 <> 0"), path, ["row_id"])
    second = sinks.append_new(o, path, ["row_id"])
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_keys")).withColumns({"first": F.lit(first).cast("bigint"), "second": F.lit(second).cast("bigint")})


def subset_absorption(spark: SparkSession, d: str) -> DataFrame:
    """Career rows that add something to the others of their person and organisation, with the volumes of those they absorb."""
    c = table(spark, d, "person_career").where("organization_id is not null").select("row_id", "person_id", "organization_id", "job_title", "start_year", "place_name", "source_volume")
    out = R.absorb_subsets(c, ["person_id", "organization_id"], ["job_title", "start_year", "place_name"], "row_id", ["source_volume"])
    return out.select("row_id", F.array_join(F.array_sort("source_volume"), "+").alias("volumes"))


def city_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Organisations without location with that of the place they are named after."""
    o = table(spark, d, "organizations").select("row_id", "name", id_key("location_id").alias("location_id"))
    cities = table(spark, d, "locations").where("name is not null").groupBy("name").agg(F.min(id_key("location_id")).alias("location_id"))
    return L.assign_city(o, "name", "location_id", cities).select("row_id", "location_id")


def repaired_labels(spark: SparkSession, d: str) -> DataFrame:
    """English names of organisations with what translation gets wrong of old names set right."""
    o = table(spark, d, "organizations").select("name", "name_en").distinct()
    return o.select("name", "name_en", L.repaired_label(F.col("name"), F.col("name_en")).alias("label"))


_R = "|".join([*C.RELATION_ENDINGS])
_JOBS = ", ".join(f"'{x}'" for x in C.RELATION_EXACT)
_FINE = ", ".join(f"'{x}'" for x in C.LEGITIMATE_JOBS)
_FOLDED = lambda c: f"translate({c}, '{''.join(X.GROUPING)}', '{''.join(X.GROUPING.values())}')"
_CAREER = "(select bio_id, birth_year, unnest(career) as c, unnest(range(len(career))) as pos from biographies_extracted)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        exclusive_roles, early_events, suspicious_names, null_org_places, girls_school_rule, deictic_organisations, phantom_cascade, subject_genders, text_projections, era_prefixes, activity_years,
        page_reading_order, path_sort_keys, year_density, restricted_jobs, relatives_per_person, types_per_point, whole_runs, surname_splits, contained_names, json_lines_round_trip, append_twice, subset_absorption, city_assignment, repaired_labels,
    )
}
SQL: dict[str, str] = {
    "exclusive_roles": "select member_id, relation from person_family_members m where relation in ('父', '養父') and person_id in (select person_id from person_family_members where relation = '父') and person_id in (select person_id from person_family_members where relation = '養父')",
    "early_events": f"select cast(bio_id as varchar) as subject_id, cast(c.start_year as varchar) as old_value, 'job too early' as reason from {_CAREER} where c.start_year < birth_year + 16 union all select cast(bio_id as varchar), cast(c.year_graduated as varchar), 'degree too early' from (select bio_id, birth_year, unnest(education) as c from biographies_extracted) where c.year_graduated < birth_year + 14",
    "suspicious_names": f"""select distinct name, regexp_matches(name, '(?:{_R})$') as relation, regexp_matches(name, '{"|".join(C.ORG_TOKENS)}') as organisation,
  (name in ({_JOBS}) or regexp_matches(name, '^.{{1,10}}[の之]?妻$') or regexp_matches(name, '^(?:昭和?|大正?|明治?)[一二三四五六七八九十〇\\d]{{1,4}}年?$')) and name not in ({_FINE}) as false_job
from (select name from organizations union select name from locations union select job_title from person_career) where name is not null""",
    "null_org_places": f"select row_id, case when {key_sql('location_id')} in (select {key_sql('location_id')} from locations where regexp_matches(name, '{'|'.join(C.ORG_TOKENS)}') and {key_sql('location_id')} is not null) then null else {key_sql('location_id')} end as location_id from organizations",
    "girls_school_rule": f"""with s as (select person_id, relation_id, max(gender) as gender from person_family_members where relation_id is not null group by all), n as (select {key_sql('organization_id')} as org, max(name) as school from organizations group by 1)
select e.row_id, school from person_family_education e join s using (person_id, relation_id) join n on n.org = {key_sql('e.organization_id')} where lower(gender) = 'm' and regexp_matches({_FOLDED('school')}, '{Q.GIRLS_SCHOOLS}')""",
    "deictic_organisations": f"select bio_id, cast(pos as int) as pos, case when c.organization in ({', '.join(repr(x) for x in Q.DEICTIC_ORGS)}) then null else c.organization end as organization from {_CAREER}",
    "phantom_cascade": "select person_id, count(*) as n from person_family_education e where not exists (select 1 from person_family_members m where coalesce(m.name, '') = '' and m.birth_year is null and coalesce(m.place, '') = '' and m.person_id = e.person_id and m.relation_id = e.relation_id) group by person_id",
    "subject_genders": "select person_id, case when w and not h then 'm' when h and not w then 'f' else 'x' end as gender from (select person_id, coalesce(bool_or(regexp_matches(relation, '妻')), false) as w, coalesce(bool_or(regexp_matches(relation, '夫$')), false) as h from person_family_members where person_id is not null group by person_id)",
    "text_projections": r"""select row_id, regexp_replace(place_name, '[^一-鿿]', '', 'g') as han, coalesce(nullif(regexp_extract(place_name, '^(.+?州)', 1), ''), nullif(regexp_extract(place_name, '^(.+?地方)', 1), '')) as region,
  array_to_string(list_filter(list_transform(regexp_split_to_array(concat_ws(' ', job_title, place_name), '[\s　]+'), lambda w: regexp_replace(w, '[^一-鿿]', '', 'g')), lambda w: length(w) between 2 and 6), '/') as ranks,
  case when right(job_title, 1) in ('長', '員', '官', '監', '佐') and regexp_extract(place_name, '([一-鿿])[^一-鿿]*$', 1) <> '' then regexp_extract(place_name, '([一-鿿])[^一-鿿]*$', 1) || right(job_title, 1) else right(job_title, 1) end as title,
  concat_ws(', ', nullif(place_name, ''), nullif(location_id, '')) as shown, try_cast(regexp_replace(source_page[1], '\D', '', 'g') as int) as page,
  regexp_extract(concat_ws('_', array_to_string(source_volume, '+'), person_id), '^(.*)_([^_]+)$', 1) as head, regexp_extract(concat_ws('_', array_to_string(source_volume, '+'), person_id), '^(.*)_([^_]+)$', 2) as tail from person_career""",
    "era_prefixes": f"select nullif(regexp_extract(c.start_year_raw, '{E.ERA_YEAR}', 1), '') as era, count(*) as n from {_CAREER} group by 1",
    "activity_years": "with c as (select row_id, person_id, coalesce(start_year, case when is_current then list_max(list_transform(source_volume, lambda v: case v when '1927' then 1927 when '1935' then 1935 when '1943A' then 1943 when '1943E' then 1943 end)) end) as year from person_career) select row_id, year, cast(row_number() over (partition by person_id order by year desc nulls last, row_id) as int) as place from c",
    "page_reading_order": "select segment_id, cast(row_number() over (partition by volume, source_page order by segment_x_range[1] desc nulls last, bbox_header[2] nulls first, segment_id) as int) as place from segmented_output",
    "path_sort_keys": r"select distinct source_image, array_to_string(list_transform(regexp_extract_all(source_image, '\d+'), lambda x: cast(cast(x as bigint) as varchar)), '/') as numbers from segmented_output",
    "year_density": """with c as (select hisco_major, start_year as v, count(*) as n from person_career where hisco_major is not null and start_year between 1800 and 1950 group by all), t as (select hisco_major, sum(n) as t from c group by 1),
g as (select unnest(range(1800, 1951)) as year) select c.hisco_major, cast(g.year as int) as year, round(sum(n * exp(-power(g.year - v, 2) / 2)) / (any_value(t.t) * 2.5066282746310002), 8) as density from c join g on abs(g.year - v) <= 4 join t using (hisco_major) group by c.hisco_major, g.year""",
    "restricted_jobs": f"select person_id, count(*) as n_all, count(*) filter ({key_sql('location_id')} in ('L3', 'L12', 'L40')) as n from person_career where person_id is not null group by person_id",
    "relatives_per_person": "select n, count(*) as n_persons from (select p.person_id, count(m.person_id) as n from (select distinct person_id from person_career where person_id is not null) p left join person_family_members m using (person_id) group by 1) group by n",
    "types_per_point": f"select lat, lon, count(distinct isic_section) as n from (select {key_sql('location_id')} as loc, isic_section from organizations where isic_section is not null) join (select distinct {key_sql('location_id')} as loc, round(latitude, 0) as lat, round(longitude, 0) as lon from locations where latitude is not null and longitude is not null) using (loc) group by lat, lon",
    "whole_runs": "select person_id from (select person_id, list_sort(list_distinct(flatten(list(source_volume)))) as s from person_career where person_id is not null group by person_id) where s = ['1943A', '1943E']",
    "surname_splits": "with s as (select distinct left(name, 2) as surname from biographies_extracted where length(name) >= 2) select distinct name, left(name, 2) as family, substr(name, 3) as given from person_family_members where length(name) > 2 and left(name, 2) in (select surname from s)",
    "contained_names": "with h as (select distinct person_id, hobby from person_hobbies where hobby is not null and person_id is not null) select a.person_id, a.hobby, b.hobby as other from h a join h b on a.person_id = b.person_id and a.hobby < b.hobby where contains(a.hobby, b.hobby) or contains(b.hobby, a.hobby)",
    "json_lines_round_trip": "select segment_id, header_ocr, body_text, segment_x_range[1] as x from segmented_output",
    "append_twice": "select count(*) as n_rows, count(distinct row_id) as n_keys, count(*) filter (row_id % 3 <> 0) as first, count(*) filter (row_id % 3 = 0) as second from organizations",
    "subset_absorption": """with recursive r as (select row_id, person_id, organization_id, source_volume, list_filter([case when job_title not in ('', 'NULL') then 'job_title=' || job_title end, case when start_year is not null then 'start_year=' || start_year end, case when place_name not in ('', 'NULL') then 'place_name=' || place_name end], lambda x: x is not null) as d from person_career where organization_id is not null),
up as (select r.row_id, min(o.row_id) as above from r join r o on o.person_id is not distinct from r.person_id and o.organization_id = r.organization_id and len(o.d) > len(r.d) and list_has_all(o.d, r.d) group by r.row_id),
w(row_id, top) as (select row_id, above from up union select w.row_id, up.above from w join up on up.row_id = w.top),
ends as (select row_id, top from w where top not in (select row_id from up) union all select row_id, row_id from r where row_id not in (select row_id from up))
select top as row_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(source_volume, []))))), '+') as volumes from ends join r using (row_id) group by top""",
    "city_assignment": f"""with c as (select name, min({key_sql('location_id')}) as loc from locations where name is not null group by name),
o as (select row_id, name, {key_sql('location_id')} as loc from organizations),
open as (select distinct name from o where loc is null and name is not null),
p as (select open.name, arg_max(c.loc, length(c.name)) as loc, arg_max(c.name, length(c.name)) as city from open join c on case when open.name like '%支店' and not contains(open.name, '各') then ends_with(left(open.name, length(open.name) - 2), c.name) else starts_with(open.name, c.name) and length(open.name) > length(c.name) and not regexp_matches(open.name, '各|卒$|同店|同社|同校|同省|同局|同廳') end where length(c.name) >= 2 group by open.name),
q as (select * from p where (name like '%支店' and not contains(name, '各')) or not regexp_matches(substr(name, length(city) + 1), '長男|長女|次男|次女|三男|養子|妻|後裔'))
select row_id, coalesce(o.loc, q.loc) as location_id from o left join q using (name)""",
    "repaired_labels": r"""select distinct name, name_en, case when name = '高女' then 'Girls'' High School' when contains(name, '高女') and contains(name_en, 'Takano') then null
  when name like '本縣%' then regexp_replace(name_en, '(?i)^(?:Honken|Hon-ken|Honshu|Honten|Honma|Honjo|Hon )\s*', 'Prefectural ', 'g') when name like '本府%' then regexp_replace(name_en, '(?i)^(?:Honfu|Hon-fu|Honfuro|Honjo|Honmachi|Honmura|Honno|Honshu|Hon )\s*', 'Prefectural ', 'g') else name_en end as label from organizations""".replace("\\\\", "\\"),
}
