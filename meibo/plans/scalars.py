"""Group a: scans, scalar functions, filters.  Each query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.functions import classify as C
from meibo.functions import era as E
from meibo.functions import text as X
from meibo.operators.spatial import has_position, haversine_km
from meibo.sources.tables import table

BIRTH, EVENT = (1820, 1940), (1850, 1943)


def scan_valid_records(spark: SparkSession, d: str) -> DataFrame:
    """Validated biographies, filter and columns pushed into the scan."""
    b = table(spark, d, "biographies_extracted").where(F.col("validation") == "Passed")
    return b.select("bio_id", "volume", "name", F.size("career").cast("bigint").alias("n_jobs"))


def clean_text_fields(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned names of relatives: brackets and Latin out, kinship noise cut off, kinship endings to null."""
    m = table(spark, d, "person_family_members").where("name is not null")
    return m.select("member_id", X.clean_name("name").alias("clean"), X.strip_kinship("name").alias("cut"), X.null_kinship_name("name").alias("kept"), X.clean_org("place").alias("place"))


def term_cascade_extract(spark: SparkSession, d: str) -> DataFrame:
    """The kinship word of each relation as typed."""
    m = table(spark, d, "person_family_members").where("relation is not null and relation <> ''")
    return m.groupBy("relation", X.kinship_of("relation").alias("kinship")).agg(F.count(F.lit(1)).alias("n"))


def fold_characters(spark: SparkSession, d: str) -> DataFrame:
    """Organisation names with older characters folded."""
    o = table(spark, d, "organizations").select("organization_id", X.fold_col("name").alias("folded")).distinct()
    return o


def digits_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Digits of a dirty field as number and as telephone number."""
    e = table(spark, d, "events")
    return e.select("event_id", F.regexp_replace("props", r"(?U)\D", "").try_cast("int").alias("k"), X.clean_phone("props").alias("phone"))


def _dates(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "biographies_extracted")
    return b.select("bio_id", F.posexplode("career").alias("pos", "c")).select("bio_id", "pos", F.col("c.start_year_raw").alias("raw"), F.col("c.start_year").alias("given"))


def kanji_numeral_parse(spark: SparkSession, d: str) -> DataFrame:
    """The year within the era of every raw date."""
    return _dates(spark, d).where("raw is not null").groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", E.era_number(F.col("raw")).alias("year_in_era"), "n")


def era_to_year(spark: SparkSession, d: str) -> DataFrame:
    """Western years of raw era dates."""
    return _dates(spark, d).where("raw is not null").select("bio_id", "pos", E.western_year(F.col("raw")).cast("int").alias("western"))


def year_range_validate(spark: SparkSession, d: str) -> DataFrame:
    """Career years in the plausible range, counted."""
    y = E.valid_year("start_year", *EVENT)
    return table(spark, d, "person_career").groupBy(y.alias("year")).agg(F.count(F.lit(1)).alias("n"))


def admin_levels_parse(spark: SparkSession, d: str) -> DataFrame:
    """Place names cut into administrative levels."""
    l = X.admin_levels("name")
    at = lambda k: F.get(l, F.lit(k))
    return table(spark, d, "locations").select("location_id", "name").distinct().select("location_id", at(0).alias("l1"), at(1).alias("l2"), at(2).alias("l3"))


def haversine_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each usable location from a fixed point, in kilometres."""
    l = table(spark, d, "locations").where(has_position(F.col("latitude"), F.col("longitude"))).select("location_id", "latitude", "longitude").distinct()
    return l.select("location_id", F.round(haversine_km(F.col("latitude"), F.col("longitude"), F.lit(35.68), F.lit(139.76), 6371.0), 6).alias("km"))


def keyword_markers_validation(spark: SparkSession, d: str) -> DataFrame:
    """The check of each document against the jobs recorded of its person."""
    jobs = table(spark, d, "person_career").where("person_id is not null").groupBy("person_id").agg(F.count(F.lit(1)).alias("jobs"))
    docs = table(spark, d, "documents").select("doc_id", "person_id", X.marker_hits("text").cast("int").alias("hits"))
    return docs.join(jobs, "person_id", "left").select("doc_id", "hits", X.validation_message(F.col("hits"), F.coalesce("jobs", F.lit(0)).cast("int")).alias("validation"))


def classify_relatives(spark: SparkSession, d: str) -> DataFrame:
    """Gender and display order of relatives by relation, and plausibility of their birth year."""
    m = table(spark, d, "person_family_members")
    r = F.col("relation")
    return m.select("member_id", C.relative_gender(r).alias("gender_read"), C.family_birth_year(F.col("birth_year"), F.lit(1880), r).alias("plausible"), C.is_false_job(r).alias("is_relation_word"))


def detect_domains(spark: SparkSession, d: str) -> DataFrame:
    """Linguistic domain and name parts of each biography's subject."""
    b = table(spark, d, "biographies_extracted")
    dom = C.domain_of(F.col("origin_place"), F.col("name"))
    parts = C.family_and_given(F.col("name"), dom)
    return b.select("bio_id", dom.alias("domain"), parts["family"].alias("family"), parts["given"].alias("given"))


def garbled_places(spark: SparkSession, d: str) -> DataFrame:
    """Career places that are references, numbers, era pieces, schools, relations or organisations."""
    p = table(spark, d, "person_career").where("place_name is not null").groupBy("place_name").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("place_name")
    return p.select("place_name", "n", C.is_garbled_place(c).alias("garbled"), C.is_foreign_to_place(c).alias("foreign_to_place"))


def organisation_labels(spark: SparkSession, d: str) -> DataFrame:
    """Display labels, education tiers, long vowels and generic names of organisations."""
    o = table(spark, d, "organizations").select("organization_id", "name", "name_en").distinct()
    n = F.col("name")
    return o.select("organization_id", X.label("name", "name_en").alias("label"), X.long_vowels("name_en").alias("macron"), C.education_tier(F.concat_ws(" ", "name", "name_en")).alias("tier"), C.is_generic_org(n).alias("generic"))


_ERAS = sorted(E.ERA_BASE, key=len, reverse=True)
_PAT = "(同|" + "|".join(_ERAS) + r")\s*(元|[〇一二三四五六七八九十廿卅百]+|\d+)\s*年?"
_DIG = "case {x} when '一' then 1 when '二' then 2 when '三' then 3 when '四' then 4 when '五' then 5 when '六' then 6 when '七' then 7 when '八' then 8 when '九' then 9 else 0 end"


def kanji_sql(c: str) -> str:
    """A numeral up to 99 in tens and units as DuckDB SQL (the last unit digit counts)."""
    ten = f"regexp_extract({c}, '([一二三四五六七八九]?)十', 1)"
    unit = f"right(regexp_replace({c}, '^.*十', ''), 1)"
    tens = f"case when contains({c}, '十') then case when {ten} = '' then 10 else 10 * ({_DIG.format(x=ten)}) end else 0 end"
    return f"case when {c} = '' then null when {c} = '元' then 1 when regexp_full_match({c}, '[0-9]+') then cast({c} as int) else nullif({tens} + {_DIG.format(x=unit)}, 0) end"


def era_sql(raw: str) -> tuple[str, str]:
    """(era, number) of a raw date as DuckDB SQL."""
    return f"nullif(regexp_extract({raw}, '{_PAT}', 1), '')", kanji_sql(f"regexp_extract({raw}, '{_PAT}', 2)")


def base_sql(era: str) -> str:
    """The year before an era's first as DuckDB SQL."""
    return f"case {era} " + " ".join(f"when '{k}' then {v}" for k, v in E.ERA_BASE.items()) + " end"


_CAREER = "(select bio_id, unnest(career) as c, generate_subscripts(career, 1) - 1 as pos from biographies_extracted)"
_DATES = f"(select bio_id, pos, c.start_year_raw as raw, c.start_year as given from {_CAREER})"
_E, _N = era_sql("raw")
_KIN = "case when length(relation) <= 2 then relation else coalesce(" + ", ".join(
    [f"case when ends_with(b, '{t}') then '{t}' end" for t in X.KINSHIP_LIST] + [f"case when starts_with(b, '{t}') then '{t}' end" for t in X.KINSHIP_LIST] + [f"case when contains(b, '{t}') then '{t}' end" for t in X.KINSHIP_LIST]
) + ", left(relation, 2)) end"
_LV = r"""(select *, case when list_position(bad, true) > 0 then lv[1:list_position(bad, true) - 1] else lv end as lev from (select *, list_transform(lv, lambda x: regexp_matches(x, '第\d+番|番地|丁目|通り|ストリート|No\.\s*\d|Street|号|條|路\d|巷') or length(regexp_replace(x, '[^一-鿿]', '', 'g')) > 15) as bad from (
select location_id, case when len(list_filter([l1, l2, l3, l4], lambda x: x <> '')) = 0 then [n] else list_filter([l1, l2, l3, l4], lambda x: x <> '') end as lv from (
select *, regexp_extract(r3, '^(.+?[町村])', 1) as l4 from (select *, substr(r2, length(l3) + 1) as r3 from (select *, regexp_extract(r2, '^(.+?[區区])', 1) as l3 from (select *, substr(r1, length(l2) + 1) as r2 from (
select *, case when l1 <> '' then regexp_extract(r1, '^(.+?[市郡縣県])', 1) else regexp_extract(r1, '^(.+?[市郡])', 1) end as l2 from (select *, substr(n, length(l1) + 1) as r1 from (
select *, regexp_extract(n, '^(.{2,}?[都道府県縣省])', 1) as l1 from (select distinct location_id, regexp_replace(regexp_replace(name, '[（(].*?[）)]', '', 'g'), '[\d一二三四五六七八九十百千]+$', '') as n from locations)))))))))))"""
_GARBLED = (
    "(p in (" + ", ".join(f"'{x}'" for x in C.DEICTIC_PLACES) + r") or regexp_matches(p, '^[一二三四五六七八九十〇\d]{1,4}$') or regexp_matches(p, '^[明大昭天][一二三四五六七八九十〇\d]{0,3}$')"
    " or (length(p) = 2 and regexp_matches(p, '^[明昭天]') and p not in (" + ", ".join(f"'{x}'" for x in C.ERA_SAFE_PLACES) + ")) or regexp_matches(p, '(" + "|".join(C.SCHOOL_ENDINGS) + ")$'))"
)
_FOREIGN = (
    "(regexp_matches(p, '(" + "|".join(C.RELATION_ENDINGS) + "|[の之](妻|夫|男|女|子|兄|弟|姉|妹|孫))$') or regexp_matches(p, '(" + "|".join(C.ORG_PLACE_ENDINGS) + ")$')"
    " or regexp_matches(p, '^(東北大|東大|北大|京大|阪大|帝大|九大|名大|慶大|早大)([^阪曽曾崎久門海野浦杉]|$)'))"
)
_HOP = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(35.68 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(35.68)) * pow(sin(radians(139.76 - longitude) / 2), 2))))"
_DOM = (
    f"case when regexp_matches(origin_place, '{C.ZH_REGIONS}') then 'zh' when regexp_matches(origin_place, '{C.KO_REGIONS}') then 'ko' when regexp_matches(regexp_replace(name, '\\s+', '', 'g'), '^[゠-ヿー]+$') then 'other'"
    f" when regexp_matches(regexp_replace(name, '\\s+', '', 'g'), '^[一-鿿]{{2,3}}$') and regexp_matches(regexp_replace(name, '\\s+', '', 'g'), '^[{C.ZH_SURNAMES}]') then 'zh' else 'ja' end"
)
_CUT = "case when domain = 'zh' and left(name, 2) in (" + ", ".join(f"'{s}'" for s in C.COMPOUND_SURNAMES) + ") and length(name) > 2 then 2 else 1 end"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (scan_valid_records, clean_text_fields, term_cascade_extract, fold_characters, digits_normalise, kanji_numeral_parse, era_to_year, year_range_validate, admin_levels_parse, haversine_distance, keyword_markers_validation, classify_relatives, detect_domains, garbled_places, organisation_labels)
}
SQL: dict[str, str] = {
    "scan_valid_records": "select bio_id, volume, name, cast(coalesce(len(career), -1) as bigint) as n_jobs from biographies_extracted where validation = 'Passed'",
    "clean_text_fields": "select member_id, case when length(x) > 1 then x end as clean, case when length(name) >= 4 and h <> '' then h else name end as cut, case when not (length(name) > 2 and regexp_matches(name, '("
    + "|".join(X.KINSHIP_ENDINGS) + ")$')) then name end as kept, case when length(pl) between 2 and 15 then pl end as place from (select member_id, name, regexp_replace(regexp_replace(regexp_replace(name, '\\(.*?\\)', '', 'g'), '（.*?）', '', 'g'), '[^一-鿿぀-ヿ]|・', '', 'g') as x, regexp_extract(name, '^(.{2,}?)("
    + "|".join(X.KINSHIP_NOISE) + ")', 1) as h, regexp_replace(place, '[\\s\\p{Z}]+', '', 'g') as pl from person_family_members where name is not null)",
    "term_cascade_extract": f"select relation, {_KIN} as kinship, count(*) as n from (select relation, case when trim(s) = '' then relation else trim(s) end as b from (select relation, regexp_replace(relation, '[（(][^）)]*[）)]', '', 'g') as s from person_family_members where relation is not null and relation <> '')) group by relation, kinship",
    "fold_characters": f"select distinct organization_id, translate(name, '{''.join(X.GROUPING)}', '{''.join(X.GROUPING.values())}') as folded from organizations",
    "digits_normalise": "select event_id, try_cast(regexp_replace(props, '\\D', '', 'g') as int) as k, case when length(regexp_replace(props, '\\D', '', 'g')) between 3 and 5 then regexp_replace(props, '\\D', '', 'g') end as phone from events",
    "kanji_numeral_parse": f"select raw, {_N} as year_in_era, count(*) as n from {_DATES} where raw is not null group by raw",
    "era_to_year": f"select bio_id, cast(pos as int) as pos, {base_sql(_E)} + {_N} as western from {_DATES} where raw is not null",
    "year_range_validate": f"select case when start_year between {EVENT[0]} and {EVENT[1]} then start_year end as year, count(*) as n from person_career group by 1",
    "admin_levels_parse": f"select location_id, lev[1] as l1, lev[2] as l2, lev[3] as l3 from {_LV}",
    "haversine_distance": f"select distinct location_id, round({_HOP}, 6) as km from locations where latitude between -90 and 90 and longitude between -180 and 180 and not (latitude = 0 and longitude = 0)",
    "keyword_markers_validation": "select doc_id, hits, case when hits > 5 and coalesce(jobs, 0) < 3 then 'Suspected skipping (' || hits || ' markers, ' || coalesce(jobs, 0) || ' jobs)' else 'Passed' end as validation from (select doc_id, person_id, cast(" + " + ".join(f"(length(text) - length(replace(text, '{m}', ''))) / {len(m)}" for m in X.CAREER_MARKERS) + " as int) as hits from documents) left join (select person_id, count(*) as jobs from person_career where person_id is not null group by person_id) using (person_id)",
    "classify_relatives": "select member_id, case when regexp_matches(r, '父|兄|弟|祖父|婿|男$') then 'm' when regexp_matches(r, '母|妻|姉|妹|祖母|女$') then 'f' else 'x' end as gender_read, case when birth_year is not null and r <> '' and ((regexp_matches(r, '[父母]') and birth_year > 1865) or (regexp_matches(r, '[女男子]') and birth_year < 1895) or (contains(r, '妻') and abs(birth_year - 1880) > 15)) then null else birth_year end as plausible, (r in ("
    + ", ".join(f"'{x}'" for x in C.RELATION_EXACT) + r") or regexp_matches(r, '^.{1,10}[の之]?妻$') or regexp_matches(r, '^(昭和?|大正?|明治?)[一二三四五六七八九十〇\d]{1,4}年?$')) and r not in (" + ", ".join(f"'{x}'" for x in C.LEGITIMATE_JOBS) + ") as is_relation_word from (select *, coalesce(relation, '') as r from person_family_members)",
    "detect_domains": f"select bio_id, domain, case when length(name) > 1 then left(name, {_CUT}) end as family, case when length(name) > 1 then substr(name, {_CUT} + 1) end as given from (select bio_id, name, {_DOM} as domain from biographies_extracted)",
    "garbled_places": f"select p as place_name, n, {_GARBLED} as garbled, {_FOREIGN} as foreign_to_place from (select place_name as p, count(*) as n from person_career where place_name is not null group by 1)",
    "organisation_labels": "select organization_id, coalesce(name_en || ' ' || name, name) as label, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name_en, 'O[uU]([^aeiouAEIOU]|$)', 'Ō\\1', 'g'), 'o[uU]([^aeiouAEIOU]|$)', 'ō\\1', 'g'), 'U[uU]([^aeiouAEIOU]|$)', 'Ū\\1', 'g'), 'u[uU]([^aeiouAEIOU]|$)', 'ū\\1', 'g') as macron, case when regexp_matches(b, '小学|小學|尋常|Elementary School|Primary School', 'i') then 1 when regexp_matches(b, '中学|中學|中等|Middle School', 'i') and not regexp_matches(b, '大学|大學', 'i') then 2 when regexp_matches(b, '高等学校|高等學校|高校|高等女|師範|予科|予備|High School|Normal School|Preparatory', 'i') and not regexp_matches(b, '大学|大學', 'i') then 3 when regexp_matches(b, '大学|大學|専門|專門|College|University', 'i') then 4 when regexp_matches(b, '大学院|研究科|Graduate', 'i') then 5 else 3 end as tier, length(name) <= 4 and regexp_matches(name, '[省部局院廳庁]$') as generic from (select distinct organization_id, name, name_en, concat_ws(' ', name, name_en) as b from organizations)",
}
