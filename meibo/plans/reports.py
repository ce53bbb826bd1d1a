"""Groups f to h: catalogue, statistics, samples, scores, networks, enrichment, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.functions import era as E
from meibo.functions.keys import id_key
from meibo.functions.similarity import error_rate
from meibo.operators import catalogue as K
from meibo.operators import network as N
from meibo.operators import ordered as O
from meibo.operators import stats as S
from meibo.operators.enrich import enrich, rule_provider
from meibo.operators.places import commonest
from meibo.plans.problems import key_sql
from meibo.sources.tables import table
from meibo.streaming.incremental import windowed_counts


def catalogue_filter(spark: SparkSession, d: str) -> DataFrame:
    """Persons kept by occupation group, keywords, place and birth gate, as the catalogue's filters combine."""
    c = table(spark, d, "person_career")
    jobs = c.where(K.hisco_filter(F.col("hisco_major"), ["7", "other"]) | K.keyword_filter("engineer attorney", [F.col("job_title_en")]))
    b = table(spark, d, "person_family_members").where(K.birth_gate(F.col("birth_year")) & K.set_filter(F.col("gender"), ["F", "M"])).select("person_id").distinct()
    kept = jobs.join(b, "person_id", "left_semi")
    return kept.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_jobs"), F.max("start_year").alias("last_year"))


def catalogue_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Job titles that hold every keyword as a whole word, literally."""
    c = table(spark, d, "person_career").where("job_title_en is not null")
    return c.where(K.keyword_filter("section chief", [F.col("job_title_en")], every=True)).groupBy("job_title_en").agg(F.count(F.lit(1)).alias("n"))


def rollup_parent_counts(spark: SparkSession, d: str) -> DataFrame:
    """Persons per organisation, with those of the direct children."""
    c = table(spark, d, "person_career").select(id_key("organization_id").alias("organization_id"), "person_id").where("organization_id is not null")
    counts = K.distinct_per(c, ["organization_id"], "person_id", "n")
    o = table(spark, d, "organizations").select(id_key("organization_id").alias("organization_id"), id_key("parent_organization_id").alias("parent"))
    return K.rollup_counts(counts, o, "organization_id", "parent", "n")


def overview_report(spark: SparkSession, d: str) -> DataFrame:
    """Known values per field of the career table."""
    return S.coverage(table(spark, d, "person_career"), ["job_title", "start_year", "is_current", "place_name", "organization_id", "location_id", "hisco_code"])


def volume_report(spark: SparkSession, d: str) -> DataFrame:
    """Career rows per volume and occupation group, per volume, and in all, in one pass."""
    return S.by_volume_and_total(table(spark, d, "person_career"), "source_volume", "hisco_major")


def demographics_report(spark: SparkSession, d: str) -> DataFrame:
    """Mean, spread and range of birth years by sex of the relatives."""
    m = table(spark, d, "person_family_members")
    return m.groupBy("gender").agg(F.count("birth_year").alias("n"), F.round(F.avg("birth_year"), 6).alias("mean"), F.round(F.stddev_samp("birth_year"), 6).alias("sd"), F.min("birth_year").alias("first"), F.max("birth_year").alias("last"))


def birth_deciles(spark: SparkSession, d: str) -> DataFrame:
    """Deciles of birth years, floor nearest rank."""
    return S.deciles(table(spark, d, "person_family_members"), "birth_year")


def jobs_per_person(spark: SparkSession, d: str) -> DataFrame:
    """How many persons of the family table have how many career rows, none included."""
    p, c = table(spark, d, "person_family_members"), table(spark, d, "person_career")
    return S.zero_filled(p, c, "person_id").groupBy("n").agg(F.count(F.lit(1)).alias("n_persons"))


def top_k_titles(spark: SparkSession, d: str) -> DataFrame:
    """The ten commonest job titles, ties by first appearance."""
    return K.top_k(table(spark, d, "person_career"), "job_title", 10, "row_id")


def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    """Share of each occupation group in all career rows."""
    c = table(spark, d, "person_career").groupBy("hisco_major").agg(F.count(F.lit(1)).alias("n"))
    return S.share_of_total(c, "n").select("hisco_major", "n", F.round("share", 6).alias("share"))


def two_stage_top(spark: SparkSession, d: str) -> DataFrame:
    """Rows per occupation group with its commonest title."""
    c = table(spark, d, "person_career").where("hisco_major is not null")
    n = c.groupBy("hisco_major").agg(F.count(F.lit(1)).alias("n"))
    return n.join(commonest(c, "hisco_major", "job_title", "row_id"), "hisco_major")


def year_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Distinct persons per career year."""
    c = table(spark, d, "person_career").select("person_id", E.valid_year("start_year", 1850, 1943).alias("year")).where("year is not null").distinct()
    return c.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def coordinate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Persons and job rows per rounded point."""
    c = table(spark, d, "person_career").select("person_id", id_key("location_id").alias("loc")).where("loc is not null")
    l = table(spark, d, "locations").where("latitude is not null and longitude is not null").select(id_key("location_id").alias("loc"), F.bround("latitude", 1).alias("lat"), F.bround("longitude", 1).alias("lon")).distinct()
    return c.join(l, "loc").groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("person_id").alias("n_persons"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred documents in proportion to their sources."""
    return S.stratified_sample(table(spark, d, "documents"), "source", "doc_id", 100).select("doc_id", "source")


def tertile_sample(spark: SparkSession, d: str) -> DataFrame:
    """Sixty-one documents from the thirds by length."""
    return S.tertile_sample(table(spark, d, "documents"), "n_chars", "doc_id", 61).select("doc_id", "tertile")


def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty confirmed and twenty rejected verdicts."""
    return S.balanced_sample(table(spark, d, "org_match_pairs"), "llm_confirmed", "pair_id", 20).select("pair_id", "llm_confirmed")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "org_match_pairs").where("llm_confirmed is not null and similarity is not null")
    return p.select("llm_confirmed", (F.col("similarity") >= 0.95).alias("by_score"), (F.col("similarity") >= 0.93).alias("by_low"), "similarity")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts against a score threshold."""
    return S.confusion(_judged(spark, d), "llm_confirmed", "by_score")


def cohens_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of verdict and threshold beyond chance."""
    k = S.cohens_kappa(_judged(spark, d), "llm_confirmed", "by_score")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Two thresholds compared on the same verdicts."""
    j = _judged(spark, d)
    m = S.mcnemar(j, F.col("by_score") == F.col("llm_confirmed"), F.col("by_low") == F.col("llm_confirmed"))
    return m.select("only_a", "only_b", F.round("chi2", 6).alias("chi2"), F.round("p", 6).alias("p"))


def binary_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, F1 and accuracy of a score threshold."""
    b = S.binary_scores(_judged(spark, d), F.col("llm_confirmed"), F.col("by_score"))
    return b.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def similarity_by_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Mean similarity of confirmed and rejected pairs."""
    return _judged(spark, d).groupBy("llm_confirmed").agg(F.round(F.avg("similarity"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def list_match_prf(spark: SparkSession, d: str) -> DataFrame:
    """Best-match precision, recall and F1 of the two sides of all judged pairs, per verdict."""
    p = table(spark, d, "org_match_pairs").where("similarity is not null")
    m = S.list_match(p.withColumn("verdict", F.coalesce(F.col("llm_confirmed").cast("string"), F.lit("open"))), "verdict", "organization_id_a", "organization_id_b", "similarity")
    return m.select("verdict", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def cer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Character error rate of one reading of a segment against the other, per volume."""
    s = table(spark, d, "segmented_output").where("body_text <> '' and text_content <> ''")
    return s.groupBy("volume").agg(F.round(F.avg(error_rate("text_content", "body_text")), 6).alias("cer"), F.count(F.lit(1)).alias("n"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "person_career").select("person_id", id_key("organization_id").alias("org"))
    return N.bipartite_edges(c, "person_id", "org")


def network_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links of persons and organisations with their weight."""
    return _edges(spark, d)


def network_degree(spark: SparkSession, d: str) -> DataFrame:
    """Degree of every person and organisation."""
    return N.degrees(_edges(spark, d))


def _kin(spark: SparkSession, d: str) -> DataFrame:
    """A sparser network: persons and the places of their relatives."""
    m = table(spark, d, "person_family_members").where("place is not null and birth_year is not null")
    return m.select(F.col("person_id").alias("src"), F.concat_ws("|", "place", F.col("birth_year").cast("string")).alias("dst")).distinct()


def network_components(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the connected components of persons and their relatives' place and birth year."""
    return N.components(_kin(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def network_centrality(spark: SparkSession, d: str) -> DataFrame:
    """Centralities in the network of regions, nations and customers' segments."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    e = n.select(F.col("r_name").alias("src"), F.col("n_name").alias("dst")).unionByName(c.select(F.col("n_name").alias("src"), F.col("c_mktsegment").alias("dst"))).distinct()
    return N.centralities(e)


_RULES = [("school", "P"), ("hospital", "Q"), ("bank", "K"), ("insurance", "K"), ("railway", "H"), ("office", "O")]


def cached_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """A class for every distinct romanised name from the offline rule provider."""
    o = table(spark, d, "organizations").select("organization_id", F.lower("name_en").alias("en")).where("en is not null").distinct()
    return enrich(o, "en", rule_provider(_RULES), "cls").select("organization_id", "en", "cls")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type: event-time windows, an extension."""
    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day", "1 hour")


def person_detail(spark: SparkSession, d: str) -> DataFrame:
    """The people table: latest job with organisation's name, number of jobs and relatives."""
    c = table(spark, d, "person_career").select("person_id", "row_id", "job_title", "start_year", "is_current", id_key("organization_id").alias("org"))
    last = O.latest(c, ["person_id"], O.latest_job_order("start_year", "is_current", "row_id")).select("person_id", "job_title", "org")
    names = table(spark, d, "organizations").groupBy(id_key("organization_id").alias("org")).agg(F.min("name").alias("org_name"))
    jobs = c.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_jobs"))
    kin = table(spark, d, "person_family_members").groupBy("person_id").agg(F.count(F.lit(1)).alias("n_relatives"))
    return last.join(names, "org", "left").join(jobs, "person_id").join(kin, "person_id", "left").select("person_id", "job_title", "org_name", "n_jobs", F.coalesce("n_relatives", F.lit(0)).cast("bigint").alias("n_relatives"))


def _digest(key: str, seed: str = "42") -> str:
    return f"md5('{seed}:' || {key})"



_J = "(select llm_confirmed, similarity >= 0.95 as by_score, similarity >= 0.93 as by_low, similarity from org_match_pairs where llm_confirmed is not null and similarity is not null)"
_C = f"(select person_id, {key_sql('organization_id')} as org, row_id, job_title, start_year, is_current from person_career)"
_EDGE = f"(select person_id as src, org as dst, count(*) as weight from {_C} where person_id is not null and org is not null group by all)"
_COV = ["job_title", "start_year", "is_current", "place_name", "organization_id", "location_id", "hisco_code"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        catalogue_filter, catalogue_keywords, rollup_parent_counts, overview_report, volume_report, demographics_report, birth_deciles, jobs_per_person, top_k_titles, share_of_total, two_stage_top, year_histogram, coordinate_counts,
        stratified_sample, tertile_sample, balanced_sample, confusion_matrix, cohens_kappa, mcnemar, binary_scores, similarity_by_verdict, list_match_prf, cer_scores, network_edges, network_degree, network_components,
        network_centrality, cached_enrichment, event_windows, person_detail,
    )
}
SQL: dict[str, str] = {
    "network_components": """with recursive k as (select distinct person_id as src, place || '|' || cast(birth_year as varchar) as dst from person_family_members where place is not null and birth_year is not null and person_id is not null),
e as (select src as u, dst as v from k union select dst, src from k), reach(node, root) as (select distinct u, u from e union select e.v, r.root from reach r join e on e.u = r.node)
select component, count(*) as size from (select node, min(root) as component from reach group by node) group by component""",
    "catalogue_filter": "select person_id, count(*) as n_jobs, max(start_year) as last_year from person_career where (hisco_major in ('7', '8', '9', 'other') or regexp_matches(job_title_en, '(?i)\\bengineer\\b') or regexp_matches(job_title_en, '(?i)\\battorney\\b')) and person_id in (select person_id from person_family_members where (birth_year is null or birth_year between 1845 and 1945) and lower(gender) in ('f', 'm')) group by person_id",
    "catalogue_keywords": "select job_title_en, count(*) as n from person_career where regexp_matches(job_title_en, '(?i)\\bsection\\b') and regexp_matches(job_title_en, '(?i)\\bchief\\b') group by 1",
    "rollup_parent_counts": f"with n as (select org, count(distinct person_id) as n from {_C} where org is not null group by org), k as (select p, sum(n.n) as kids from (select distinct {key_sql('organization_id')} as org, {key_sql('parent_organization_id')} as p from organizations) join n using (org) where p is not null group by p) select n.org as organization_id, cast(n.n + coalesce(kids, 0) as bigint) as n from n left join k on k.p = n.org",
    "overview_report": " union all ".join(f"select '{c}' as field, count({c}) as n_known, count(*) as n_rows from person_career" for c in _COV),
    "volume_report": "select volume, hisco_major, count(*) as n, cast(grouping(volume, hisco_major) as int) as level from (select unnest(source_volume) as volume, hisco_major from person_career) group by grouping sets ((volume, hisco_major), (volume), ())",
    "demographics_report": "select gender, count(birth_year) as n, round(avg(birth_year), 6) as mean, round(stddev_samp(birth_year), 6) as sd, min(birth_year) as first, max(birth_year) as last from person_family_members group by gender",
    "birth_deciles": "with v as (select list_sort(list(birth_year)) as l, count(*) as n from person_family_members where birth_year is not null) select cast(k as int) as decile, l[case when floor(n * k / 10) < 1 then n else cast(floor(n * k / 10) as bigint) end] as value from v, range(1, 10) t(k)",
    "jobs_per_person": "select n, count(*) as n_persons from (select p.person_id, count(c.row_id) as n from (select distinct person_id from person_family_members) p left join person_career c using (person_id) group by 1) group by n",
    "top_k_titles": "select job_title, n from (select job_title, count(*) as n, min(row_id) as f from person_career where job_title is not null group by 1) order by n desc, f, job_title limit 10",
    "share_of_total": "select hisco_major, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from person_career group by 1",
    "two_stage_top": "with c as (select hisco_major, job_title, count(*) as n, min(row_id) as f from person_career where hisco_major is not null group by 1, 2) select hisco_major, cast(sum(n) as bigint) as n, arg_max(job_title, (n, -f)) filter (job_title is not null) as job_title from c group by 1",
    "year_histogram": "select start_year as year, count(distinct person_id) as n from person_career where start_year between 1850 and 1943 group by 1",
    "coordinate_counts": f"select lat, lon, count(*) as n, count(distinct person_id) as n_persons from (select person_id, {key_sql('location_id')} as loc from person_career) join (select distinct {key_sql('location_id')} as loc, round_even(latitude, 1) as lat, round_even(longitude, 1) as lon from locations where latitude is not null and longitude is not null) using (loc) group by 1, 2",
    "stratified_sample": f"with t as (select count(*) as n from documents), q as (select source, cast(least(greatest(round_even(100.0 * count(*) / (select n from t), 0), 1), count(*)) as bigint) as quota from documents group by 1) select doc_id, source from (select doc_id, source, row_number() over (partition by source order by {_digest('doc_id')}, doc_id) as rn from documents) join q using (source) where rn <= quota order by {_digest('doc_id', '42/n')}, doc_id limit 100",
    "tertile_sample": f"with p as (select doc_id, cast(least(floor((row_number() over (order by n_chars, doc_id) - 1) / (count(*) over () // 3)), 2) as int) as tertile from documents where n_chars is not null) select doc_id, tertile from (select *, row_number() over (partition by tertile order by {_digest('doc_id')}, doc_id) as rn from p) where rn <= 20 + case when tertile < 1 then 1 else 0 end",
    "balanced_sample": f"select pair_id, llm_confirmed from (select *, row_number() over (partition by llm_confirmed order by {_digest('pair_id')}, pair_id) as rn from org_match_pairs where llm_confirmed is not null) where rn <= 20",
    "confusion_matrix": f"select llm_confirmed as gold, by_score as pred, count(*) as n from {_J} group by 1, 2",
    "cohens_kappa": f"with m as (select llm_confirmed as g, by_score as p, count(*) as n from {_J} group by 1, 2), t as (select sum(n) as n, sum(n) filter (g = p) as same from m), e as (select sum(a.s * b.s) as s from (select g, sum(n) as s from m group by 1) a join (select p, sum(n) as s from m group by 1) b on a.g = b.p) select cast(n as bigint) as n, round(same / n, 6) as observed, round(s / (n * n), 6) as expected, round((same / n - s / (n * n)) / (1 - s / (n * n)), 6) as kappa from t, e",
    "mcnemar": f"with m as (select a as only_a, b as only_b, cast(pow(abs(a - b) - 1, 2) as double) / nullif(a + b, 0) as chi2 from (select count(*) filter (by_score = llm_confirmed and by_low <> llm_confirmed) as a, count(*) filter (by_low = llm_confirmed and by_score <> llm_confirmed) as b from {_J})), x as (select *, sqrt(chi2 / 2) as z, 1 / (1 + 0.3275911 * sqrt(chi2 / 2)) as t from m) select only_a, only_b, round(chi2, 6) as chi2, round((0.254829592 * t - 0.284496736 * pow(t, 2) + 1.421413741 * pow(t, 3) - 1.453152027 * pow(t, 4) + 1.061405429 * pow(t, 5)) * exp(-z * z), 6) as p from x",
    "binary_scores": f"select tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy from (select *, tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r from (select count(*) filter (llm_confirmed and by_score) as tp, count(*) filter (not llm_confirmed and by_score) as fp, count(*) filter (llm_confirmed and not by_score) as fn, count(*) filter (not llm_confirmed and not by_score) as tn from {_J}))",
    "similarity_by_verdict": f"select llm_confirmed, round(avg(similarity), 6) as mean, count(*) as n from {_J} group by 1",
    "list_match_prf": "with s as (select coalesce(cast(llm_confirmed as varchar), 'open') as verdict, * from org_match_pairs where similarity is not null), a as (select verdict, avg(m) as precision from (select verdict, organization_id_a, max(similarity) as m from s group by 1, 2) group by 1), b as (select verdict, avg(m) as recall from (select verdict, organization_id_b, max(similarity) as m from s group by 1, 2) group by 1) select verdict, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / (precision + recall), 6) as f1 from a join b using (verdict)",
    "network_edges": f"select * from {_EDGE}",
    "network_degree": f"select node, count(*) as degree from (select src as node from {_EDGE} union all select dst from {_EDGE}) group by 1",
    "cached_enrichment": "select distinct organization_id, lower(name_en) as en, case " + " ".join(f"when contains(lower(name_en), '{k}') then '{v}'" for k, v in _RULES) + " else '' end as cls from organizations where name_en is not null",
    "event_windows": "select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by 1, 2",
    "person_detail": f"with l as (select *, row_number() over (partition by person_id order by (start_year is null), start_year desc nulls last, coalesce(is_current, false) desc, row_id) as rn, count(*) over (partition by person_id) as n_jobs from {_C}), o as (select {key_sql('organization_id')} as org, min(name) as org_name from organizations group by 1) select l.person_id, job_title, org_name, n_jobs, coalesce(k.n, 0) as n_relatives from l left join o using (org) left join (select person_id, count(*) as n from person_family_members group by 1) k on k.person_id = l.person_id where rn = 1",
}
