"""Label maps, gates, filters and samples of the catalogue, with SQL written from the surveyed rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.functions import classify as C
from meibo.functions import similarity as M
from meibo.functions import text as X
from meibo.functions.keys import id_key
from meibo.operators import catalogue as K
from meibo.operators import cleaning as L
from meibo.operators import resolve as R
from meibo.operators import stats as S
from meibo.plans.problems import key_sql
from meibo.sources.tables import table


def relation_display_order(spark: SparkSession, d: str) -> DataFrame:
    """The display order of every relation as typed."""
    m = table(spark, d, "person_family_members").select("relation").distinct()
    return m.select("relation", C.relation_order(F.col("relation")).alias("o")).select("relation", "o.*")


def education_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The tier of every organisation's name, in both languages."""
    o = table(spark, d, "organizations").select("name", "name_en").distinct()
    return o.select("name", "name_en", C.education_tier(F.col("name")).alias("tier"), C.education_tier(F.col("name_en")).alias("tier_en"))


def _persons(spark: SparkSession, d: str) -> DataFrame:
    """One row per person_id of the relatives' table: its first relative stands for the person."""
    m = table(spark, d, "person_family_members").where("person_id is not null")
    first = m.groupBy("person_id").agg(F.min_by(F.struct("name_latin", "birth_year", id_key("location_id").alias("location_id")), "member_id").alias("f"))
    return first.select("person_id", "f.*")


def default_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the catalogue counts before a filter is touched: persons in the default gate, their records, organisations and places."""
    jobs = table(spark, d, "person_career").select("person_id", id_key("organization_id").alias("organization_id"), id_key("location_id").alias("location_id"))
    orgs = table(spark, d, "organizations").select(id_key("organization_id").alias("organization_id"), "name", id_key("location_id").alias("location_id"))
    locs = table(spark, d, "locations").select(id_key("location_id").alias("location_id"))
    children = {"education": table(spark, d, "person_family_education"), "relatives": table(spark, d, "person_family_members"), "hobbies": table(spark, d, "person_hobbies")}
    return K.headline_counts(_persons(spark, d), children, jobs, orgs, locs, "name_latin", "birth_year")


def default_gate_persons(spark: SparkSession, d: str) -> DataFrame:
    """Persons that pass the default gate."""
    return _persons(spark, d).where(K.default_gate(F.col("name_latin"), F.col("birth_year"))).select("person_id")


def industry_filter(spark: SparkSession, d: str) -> DataFrame:
    """Persons with a job at an organisation of three sections, with the number of such jobs."""
    jobs = table(spark, d, "person_career").select("person_id", id_key("organization_id").alias("organization_id"))
    orgs = table(spark, d, "organizations").select(id_key("organization_id").alias("organization_id"), "isic_section")
    return K.industry_filter(jobs, orgs, "organization_id", "isic_section", ["K", "D", "P"]).groupBy("person_id").agg(F.count(F.lit(1)).alias("n_jobs"))


def region_filter(spark: SparkSession, d: str) -> DataFrame:
    """Locations in Korea or in the derived region, made of four provinces of the test data."""
    l = table(spark, d, "locations")
    return l.where(C.in_regions(F.col("country"), F.col("province"), ["ko", "mk"], ("Kashigun", "Kurahama", "Mizuryo", "Aozan"))).select(id_key("location_id").alias("location_id"), "country", "province").distinct()


def industry_labels(spark: SparkSession, d: str) -> DataFrame:
    """Organisations per section with the label shown for it."""
    o = table(spark, d, "organizations")
    return o.groupBy("isic_section").agg(F.count(F.lit(1)).alias("n")).withColumn("label", C.isic_label(F.col("isic_section")))


def occupation_codes(spark: SparkSession, d: str) -> DataFrame:
    """Career rows per repaired two-digit code with the label of its major group; every third code as a spreadsheet leaves it."""
    c = table(spark, d, "person_career")
    typed = F.when(F.pmod(F.col("row_id"), F.lit(3)) == 0, F.concat(F.col("hisco_code").cast("int").cast("string"), F.lit(".0"))).otherwise(F.col("hisco_code"))
    coded = c.select(C.hisco_minor(typed).alias("minor"), "hisco_major")
    return coded.groupBy("minor", "hisco_major").agg(F.count(F.lit(1)).alias("n")).withColumn("label", C.hisco_major_label(F.col("hisco_major")))


def religion_categories(spark: SparkSession, d: str) -> DataFrame:
    """The picker category of each religion of the dictionary."""
    return spark.createDataFrame(RELIGIONS, "belongs_to string, school string").select("belongs_to", "school", C.religion_category(F.col("belongs_to"), F.col("school")).alias("category"))


def volume_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """Sixty-five documents split equally over the volumes, inside a volume by source."""
    return S.volume_balanced_sample(table(spark, d, "documents"), "volume", "source", "doc_id", 65).select("doc_id", "volume", "source")


def tidy_labels(spark: SparkSession, d: str) -> DataFrame:
    """English organisation names as translations are kept: plain, in title case, null if too long."""
    o = table(spark, d, "organizations").select("name_en").distinct()
    return o.select("name_en", X.tidy_translation(F.lower("name_en"), 40).alias("tidy"), X.normalise_place("name_en").alias("place"))


def tone_marks(spark: SparkSession, d: str) -> DataFrame:
    """Names romanised with long vowels, and without marks again."""
    m = table(spark, d, "person_family_members").where("name_latin is not null").select("name_latin").distinct()
    marked = X.long_vowels(F.col("name_latin"))
    return m.select("name_latin", marked.alias("marked"), X.strip_tones(F.upper(marked)).alias("plain"), L.wrong_romanisation(F.col("name_latin")).alias("wrong"))


def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a person's relatives' names of which one is the other's variant."""
    m = table(spark, d, "person_family_members").where("name is not null and person_id is not null").select("person_id", "name").distinct()
    other = m.withColumnRenamed("name", "other")
    return m.join(other, "person_id").where((F.col("name") < F.col("other")) & M.is_variant(F.col("name"), F.col("other")))


def reference_name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """English organisation names at least 0.95 alike, scored without floor or threshold of the boost."""
    return R.fuzzy_pairs(table(spark, d, "organizations"), "organization_id", "name_en", 0.95).select("name_a", "name_b")


def verdict_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts against a score threshold as a matrix over both labels."""
    p = table(spark, d, "org_match_pairs").where("llm_confirmed is not null and similarity is not null").select("llm_confirmed", (F.col("similarity") >= 0.95).alias("high"))
    return S.confusion_pivot(p, "llm_confirmed", "high", ["false", "true"])


def reading_scores(spark: SparkSession, d: str) -> DataFrame:
    """One reading of the segments scored against the other: text and header strictly and in part, lines as a list."""
    s = table(spark, d, "segmented_output")
    pairs = s.select(
        F.col("text_content").alias("pred_text"), F.col("body_text").alias("gold_text"), F.col("header_ocr").alias("pred_header"), F.col("header_ocr").alias("gold_header"),
        F.split("text_content", "\n").alias("pred_lines"), F.split("body_text", "\n").alias("gold_lines"),
    )
    return S.field_scores(pairs, ["text", "header"], ["text"], ["lines"])


def depth_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Organisations by their depth below the topmost parent."""
    o = table(spark, d, "organizations").select(id_key("organization_id").alias("id"), id_key("parent_organization_id").alias("parent")).where("id is not null")
    one = o.groupBy("id").agg(F.max("parent").alias("parent"))
    return R.parent_depth(one, "id", "parent").groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


# Religions of the dictionary, what each belongs to and its school.
RELIGIONS = [
    ("Buddhism", "Pure Land"), ("Buddhism", "Zen"), ("Buddhism", "Nichiren"), ("Buddhism", "Shingon"), ("Buddhism", None), ("Shintō", None), ("Christianity", "Anglican"),
    ("Confucianism", None), ("Tenrikyō", None), ("Islam", "Zen"), ("", "Zen"), (None, None),
]

_FOLD = lambda c: f"translate(coalesce({c}, ''), '{''.join(X.GROUPING)}', '{''.join(X.GROUPING.values())}')"
_GATE = "length(coalesce(name_latin, '')) >= 2 and (birth_year is null or birth_year between 1845 and 1945)"
_PEOPLE = f"persons as (select person_id, arg_min(name_latin, member_id) filter (name_latin is not null) as x, first(name_latin order by member_id) as name_latin, first(birth_year order by member_id) as birth_year, first({key_sql('location_id')} order by member_id) as location_id from person_family_members where person_id is not null group by person_id), kept as (select * from persons where {_GATE})"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        relation_display_order, education_tiers, default_filter_counts, default_gate_persons, industry_filter, region_filter, industry_labels, occupation_codes, religion_categories,
        volume_balanced_sample, tidy_labels, tone_marks, name_variants, reference_name_pairs, verdict_pivot, reading_scores, depth_distribution,
    )
}
SQL: dict[str, str] = {
    "relation_display_order": """select distinct relation,
  case when regexp_matches(relation, '祖先|先祖|遠祖|元祖|高祖|玄祖|曾祖|祖父|祖母|先代|先々') then 0 when regexp_matches(relation, '^祖$') then 0 when regexp_matches(relation, '伯父|伯母|叔父|叔母|舅|姑父|姑母|姑') then 2
    when regexp_matches(relation, '父|母') then 1 when regexp_matches(relation, '妻|夫$|夫人|夫君|婿|嫁') then 4 when regexp_matches(relation, '従兄|従弟|従姉|従妹|從兄|從弟|從姉|從妹') then 6
    when regexp_matches(relation, '兄|姉|弟|妹') then 3 when regexp_matches(relation, '子|男|女|嗣|娘') then 5 when regexp_matches(relation, '甥|姪') then 7 when regexp_matches(relation, '孫|曾孫|玄孫') then 8 else 9 end as order1,
  case when contains(relation, '次') then 2 when contains(relation, '長') then 1 else 3 end as order2,
  case when contains(relation, '五') then 5 when contains(relation, '四') then 4 when contains(relation, '三') then 3 when contains(relation, '二') then 2 when contains(relation, '一') then 1 else 6 end as order3
from person_family_members""",
    "education_tiers": "select distinct name, name_en, " + ", ".join(
        f"""case when regexp_matches({c}, '小学|小學|尋常|Elementary School|Primary School', 'i') then 1 when regexp_matches({c}, '中学|中學|中等|Middle School', 'i') and not regexp_matches({c}, '大学|大學', 'i') then 2
  when regexp_matches({c}, '高等学校|高等學校|高校|高等女|師範|予科|予備|High School|Normal School|Preparatory', 'i') and not regexp_matches({c}, '大学|大學', 'i') then 3 when regexp_matches({c}, '大学|大學|専門|專門|College|University', 'i') then 4
  when regexp_matches({c}, '大学院|研究科|Graduate', 'i') then 5 else 3 end as {a}""" for c, a in (("name", "tier"), ("name_en", "tier_en"))
    ) + " from organizations",
    "default_filter_counts": f"""with {_PEOPLE},
j as (select person_id, {key_sql('organization_id')} as org, {key_sql('location_id')} as loc from person_career where person_id in (select person_id from kept)),
o as (select {key_sql('location_id')} as loc from organizations where trim(coalesce(name, '')) <> '' and {key_sql('organization_id')} in (select org from j where org is not null)),
named as (select location_id as loc from kept union select loc from j union select loc from o)
select 'persons' as metric, count(*) as value from persons union all select 'persons shown', count(*) from kept union all select 'jobs', count(*) from j
union all select 'education', count(*) from person_family_education where person_id in (select person_id from kept)
union all select 'relatives', count(*) from person_family_members where person_id in (select person_id from kept)
union all select 'hobbies', count(*) from person_hobbies where person_id in (select person_id from kept)
union all select 'organisations linked', count(*) from o
union all select 'locations referenced', count(*) from locations where {key_sql('location_id')} in (select loc from named where loc is not null)
union all select 'excluded: name', count(*) from persons where length(coalesce(name_latin, '')) < 2
union all select 'excluded: birth year', count(*) from persons where birth_year < 1845 or birth_year > 1945""",
    "default_gate_persons": f"with {_PEOPLE} select person_id from kept",
    "industry_filter": f"select person_id, count(*) as n_jobs from person_career where {key_sql('organization_id')} in (select {key_sql('organization_id')} from organizations where isic_section in ('K', 'D', 'P')) group by person_id",
    "region_filter": f"select distinct {key_sql('location_id')} as location_id, country, province from locations where country = 'ko' or province in ('Kashigun', 'Kurahama', 'Mizuryo', 'Aozan')",
    "industry_labels": "select isic_section, count(*) as n, case isic_section " + " ".join(f"when '{k}' then '{v}'" for k, v in {**C.ISIC_LABELS, **C.ISIC_SHORT}.items()) + " end as label from organizations group by isic_section",
    "occupation_codes": "select coalesce(hisco_code, '') as minor, hisco_major, count(*) as n, case when hisco_major in ('0', '1') then 'Professional/Technical' when hisco_major = '2' then 'Administrative/Managerial' when hisco_major = '3' then 'Clerical' when hisco_major = '4' then 'Sales' when hisco_major = '5' then 'Service' when hisco_major = '6' then 'Agricultural/Forestry/Fishing' when hisco_major in ('7', '8', '9') then 'Production/Transport' end as label from person_career group by all",
    "religion_categories": "select *, case when belongs_to is null or belongs_to = '' then null when belongs_to = 'Buddhism' and school = 'Pure Land' then 'pureland' when belongs_to = 'Buddhism' and school = 'Zen' then 'zen' when belongs_to = 'Buddhism' and school = 'Nichiren' then 'nichiren' when belongs_to = 'Buddhism' then 'buddhism' when belongs_to = 'Shintō' then 'shinto' when belongs_to = 'Christianity' then 'christianity' when belongs_to = 'Confucianism' then 'confucianism' when belongs_to = 'Tenrikyō' then 'tenrikyo' else 'other' end as category from (values "
    + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in r) + ")" for r in RELIGIONS) + ") t(belongs_to, school)",
    "volume_balanced_sample": """with e as (select volume, source, count(*) as size from documents group by all),
v as (select volume, sum(size) as total, count(*) over () as k, row_number() over (order by volume nulls last) as i from e group by volume),
q as (select e.volume, e.source, size, least(65 // k + case when i <= 65 % k then 1 else 0 end, total) as q, total from e join v on e.volume is not distinct from v.volume),
p as (select d.doc_id, d.volume, d.source, q.q, q.size, q.total, row_number() over (partition by d.volume, d.source order by md5('42:' || d.doc_id), d.doc_id) as rn from documents d join q on d.volume is not distinct from q.volume and d.source is not distinct from q.source),
s as (select *, row_number() over (partition by volume order by md5('42/n:' || doc_id), doc_id) as rv from p where q > 0 and rn <= least(greatest(round_even(cast(q as double) * size / total, 0), 1), size)),
a as (select doc_id, volume, source from s where rv <= q),
t as (select doc_id, volume, source, row_number() over (order by md5('42/top:' || doc_id), doc_id) as rt from documents where doc_id not in (select doc_id from a))
select * from a union all select doc_id, volume, source from t where rt <= 65 - (select count(*) from a)""",
    "tidy_labels": r"""with x as (select distinct name_en, trim(regexp_replace(regexp_replace(lower(name_en), '[^\x20-\x7E]', '', 'g'), '\s+', ' ', 'g')) as t from organizations)
select name_en, case when t <> '' and length(t) <= 40 then case when regexp_matches(t[1], '[A-Z]') then t else array_to_string(list_transform(range(1, length(t) + 1), lambda i: case when i > 1 and regexp_matches(t[i - 1], '^\p{L}$') then lower(t[i]) else upper(t[i]) end), '') end end as tidy,
  trim(regexp_replace(regexp_replace(name_en, '(?i)\s*\((Prefecture|City|Ward|District|County|Borough|Town|Village)\)$', ''), '(?i)\s+(Prefecture|City|Ward|District|County|Borough|Town|Village)$', '')) as place from x""",
    "name_variants": "with m as (select distinct person_id, name from person_family_members where name is not null and person_id is not null) select a.person_id, a.name, b.name as other from m a join m b on a.person_id = b.person_id and a.name < b.name where starts_with(a.name, b.name) or starts_with(b.name, a.name) or (length(a.name) = length(b.name) and length(a.name) >= 2 and left(a.name, length(a.name) - 1) = left(b.name, length(b.name) - 1))",
    "verdict_pivot": "select cast(llm_confirmed as varchar) as gold, count(*) filter (similarity < 0.95) as pred_false, count(*) filter (similarity >= 0.95) as pred_true from org_match_pairs where llm_confirmed is not null and similarity is not null group by 1",
    "reading_scores": f"""with s as (select {_FOLD('text_content')} as p, {_FOLD('body_text')} as g, text_content is not null or body_text is not null as known, header_ocr,
  coalesce(string_split(text_content, chr(10)), []) as pl, coalesce(string_split(body_text, chr(10)), []) as gl,
  list_filter(coalesce(string_split({_FOLD('text_content')}, chr(10)), []), lambda x: trim(x) <> '') as pi, list_filter(coalesce(string_split({_FOLD('body_text')}, chr(10)), []), lambda x: trim(x) <> '') as gi from segmented_output)
select 'text' as field, count(*) filter (known) as total, count(*) filter (known and p = g) as strict, count(*) filter (known and (p = g or (p <> '' and g <> '' and (contains(p, g) or contains(g, p))))) as partial, 0::bigint as pred_items, 0::bigint as gold_items, 0::bigint as pred_matched, 0::bigint as gold_matched from s
union all select 'header', count(header_ocr), count(header_ocr), count(header_ocr), 0, 0, 0, 0 from s
union all select 'lines', count(*) filter (len(pl) > 0 or len(gl) > 0), count(*) filter ((len(pl) > 0 or len(gl) > 0) and len(pl) = len(gl)), count(*) filter ((len(pl) > 0 or len(gl) > 0) and len(pl) = len(gl)), cast(sum(len(pi)) as bigint), cast(sum(len(gi)) as bigint),
  cast(sum(len(list_filter(pi, lambda x: len(list_filter(gi, lambda y: contains(x, y) or contains(y, x))) > 0)) ) as bigint), cast(sum(len(list_filter(gi, lambda y: len(list_filter(pi, lambda x: contains(x, y) or contains(y, x))) > 0))) as bigint) from s""",
    "depth_distribution": f"""with recursive o as (select {key_sql('organization_id')} as id, max({key_sql('parent_organization_id')}) as parent from organizations group by 1 having id is not null),
w(id, up, depth) as (select id, case when parent <> id then parent end, case when parent <> id then 1 else 0 end from o union all select w.id, case when o.parent <> o.id then o.parent end, w.depth + 1 from w join o on o.id = w.up where o.parent <> o.id and w.depth < 64)
select depth, count(*) as n from (select id, max(depth) as depth from w group by id) group by depth""",
}
