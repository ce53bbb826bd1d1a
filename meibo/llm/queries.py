"""Queries of problems 4 to 10 over the biographical tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.functions.keys import id_key
from meibo.llm.groups import consolidate, name_groups
from meibo.llm.mapping import map_values
from meibo.llm.mixing import mix, share_report
from meibo.llm.names import name_groups as alike_names, name_links
from meibo.llm.ocr import noise_found, repaired
from meibo.llm.packing import fill_report, pack
from meibo.llm.residue import keep_clean, residue
from meibo.llm.tokens import token_lengths
from meibo.plans.problems import key_sql
from meibo.session import materialize
from meibo.sources.tables import table


def confirmed_links(pairs: DataFrame) -> DataFrame:
    """(a, b): pairs whose latest non-null verdict, in either order, is true; a later pair_id breaks ties of time."""
    p = pairs.select(id_key("organization_id_a").alias("x"), id_key("organization_id_b").alias("y"), "llm_confirmed", "checked_at", "pair_id")
    p = p.where(F.col("llm_confirmed").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != F.col("y")))
    last = p.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max_by("llm_confirmed", F.struct("checked_at", "pair_id")).alias("ok"))
    return last.where("ok").select("a", "b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every linked organisation with its group's smallest id."""
    members = materialize(consolidate(confirmed_links(table(spark, d, "org_match_pairs")), "a", "b"), "members")
    number = F.try_to_number(F.regexp_extract("member", r"^O(\d+)$", 1), F.lit("9" * 30))
    named = name_groups(members, F.struct(number.isNull().alias("odd"), number.alias("n"), F.col("member").alias("id")))
    return named.select(F.col("member").alias("organization_id"), "group_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Which field of which segment holds which kind of noise."""
    return noise_found(table(spark, d, "segmented_output"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The repaired continuous text of every body text, text content and entry header."""
    return repaired(table(spark, d, "segmented_output"))


def _typed_values(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "person_career").select(F.lit("job_title_en").alias("field_name"), F.col("job_title_en").alias("raw_value"))
    hobbies = table(spark, d, "person_hobbies").select(F.lit("hobby").alias("field_name"), F.col("hobby").alias("raw_value"))
    relations = table(spark, d, "person_family_members").select(F.lit("relation").alias("field_name"), F.col("relation").alias("raw_value"))
    return jobs.unionByName(hobbies).unionByName(relations)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct typed value with the entry it stands for, 0 if none."""
    return map_values(_typed_values(spark, d), table(spark, d, "canonical_terms"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that stand for no entry, with the number of rows that hold them."""
    typed = _typed_values(spark, d)
    none = map_values(typed, table(spark, d, "canonical_terms")).where("term_id = 0").select("field_name", "raw_value")
    counts = typed.groupBy("field_name", "raw_value").agg(F.count(F.lit(1)).alias("n_rows"))
    return none.join(counts, ["field_name", "raw_value"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of ids of one organisation, and of rows of one relative of a person."""
    orgs = table(spark, d, "organizations").withColumn("organization_id", id_key("organization_id"))
    return name_links(orgs, table(spark, d, "person_family_members"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every named organisation and relative with its group and the number of spellings its own were found alike to."""
    orgs = table(spark, d, "organizations").withColumn("organization_id", id_key("organization_id"))
    return alike_names(orgs, table(spark, d, "person_family_members"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(token_lengths(table(spark, d, "documents"), keep=("source",)), "token-lengths")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of every kind; only those above the capacity are cut."""
    return pack(_sizes(spark, d), table(spark, d, "pack_settings"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and the share of room left, per kind."""
    settings = table(spark, d, "pack_settings")
    return fill_report(pack(_sizes(spark, d), settings), settings)


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: documents assigned, containers above the capacity, documents cut or assigned in part without need."""
    sizes, settings = _sizes(spark, d), table(spark, d, "pack_settings")
    packed = materialize(pack(sizes, settings), "packed")
    full = packed.groupBy("container_kind", "container_id").agg(F.sum("piece_tokens").alias("n")).join(F.broadcast(settings), "container_kind")
    over = full.groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("over_capacity"))
    docs = packed.groupBy("container_kind", "doc_id").agg(F.sum("piece_tokens").alias("n"), F.count(F.lit(1)).alias("pieces")).join(sizes.select("doc_id", "n_tokens"), "doc_id").join(F.broadcast(settings), "container_kind")
    whole = (F.col("n") == F.col("n_tokens")) & ((F.col("pieces") == 1) | (F.col("n_tokens") > F.col("capacity_tokens")))
    per = docs.groupBy("container_kind", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(~whole).alias("not_whole"))
    return per.join(over, "container_kind").select("container_kind", "capacity_tokens", "n_documents", "over_capacity", "not_whole")


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the targets: its documents, and those used too often, under another source or twice in the mix."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    used = mix(sizes, targets).select("doc_id", F.col("source").alias("_source"), "copies")
    seen = used.join(sizes.select("doc_id", "source"), "doc_id").join(F.broadcast(targets), "source")
    wrong = seen.groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("above_repeats"), F.count_if(F.col("_source") != F.col("source")).alias("other_source"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("used_twice"))
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents")).join(F.broadcast(targets), "source")
    return per.join(wrong, "source", "left").fillna(0).select("source", "target_share", "max_repeats", "n_documents", "above_repeats", "other_source", "used_twice")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with their copies."""
    return mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source in the mix."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    return share_report(mix(sizes, targets), sizes, targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold template residue, filler, an error message or a script notice."""
    return residue(table(spark, d, "documents")).select("doc_id").distinct()


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents kept in the corpus."""
    docs = table(spark, d, "documents")
    return keep_clean(docs.select("doc_id", "lang", "source", "n_chars"), residue(docs))


_LINKS = f"""latest as (select least(x, y) as a, greatest(x, y) as b, arg_max(llm_confirmed, (checked_at, pair_id)) as ok from (
  select {key_sql('organization_id_a')} as x, {key_sql('organization_id_b')} as y, llm_confirmed, checked_at, pair_id from org_match_pairs)
  where llm_confirmed is not null and x <> y group by 1, 2),
e as (select a as u, b as v from latest where ok union all select b, a from latest where ok)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p4_found, p5_found, p5_repaired, p6_found, p6_unmatched, p7_found, p7_groups, p8_containers, p8_report, p8_invariants, p9_mix, p9_shares, p9_invariants, p10_found, p10_clean)
}
SQL: dict[str, str] = {
    "p8_invariants": "select container_kind, capacity_tokens, (select count(distinct doc_id) from documents) as n_documents, 0::bigint as over_capacity, 0::bigint as not_whole from pack_settings",
    "p9_invariants": "select source, target_share, max_repeats, count(*) as n_documents, 0::bigint as above_repeats, 0::bigint as other_source, 0::bigint as used_twice from documents join mix_targets using (source) group by all",
    "p4_found": f"""with recursive {_LINKS},
reach(id, root) as (select distinct u, u from e union select e.v, r.root from reach r join e on e.u = r.id)
select id as organization_id, arg_min(root, cast(substr(root, 2) as bigint)) as group_id from reach group by id""",
}
