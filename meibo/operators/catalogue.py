"""Faceted catalogue queries: keyword, category and place filters, counts and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# HISCO major groups that a choice stands for besides itself.
HISCO_ALSO = {"0": ["0", "1"], "7": ["7", "8", "9"]}


def keyword_filter(words: str, columns: Sequence[Column], every: bool = False, whole: bool = True, regex: bool = False) -> Column:
    """True where the words occur: any word (or every one), in any column, as whole words or anywhere.

    Case is ignored.  Words are taken literally unless ``regex``; no words are always true.
    """
    tests = []
    for w in words.split():
        body = w if regex else r"\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E"
        pattern = rf"(?iU)\b{body}\b" if whole else f"(?iU){body}"
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(c.rlike(pattern), F.lit(False)) for c in columns]))
    if not tests:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)


def category_filter(value: Column, chosen: Sequence[str], known: Sequence[str]) -> Column:
    """True for a chosen category; the choice "other" takes null and unknown values."""
    hit = F.coalesce(value.isin(*chosen), F.lit(False)) if chosen else F.lit(False)
    return hit | (value.isNull() | ~value.isin(*known)) if "other" in chosen else hit


def hisco_filter(major: Column, chosen: Sequence[str]) -> Column:
    """True for the chosen occupation groups, some of which stand for several."""
    codes = [c for x in chosen for c in HISCO_ALSO.get(x, [x])]
    return F.coalesce(major.isin(*codes), F.lit(False))


def set_filter(value: Column, chosen: Sequence[str]) -> Column:
    """True for one of the chosen values, whatever their case."""
    return F.coalesce(F.lower(value).isin(*[c.lower() for c in chosen]), F.lit(False))


def place_restriction(location: Column, chosen: Sequence[str] | None) -> Column:
    """True for the chosen locations; without a choice every row passes, with or without location."""
    return F.lit(True) if chosen is None else F.coalesce(location.isin(*chosen), F.lit(False))


def industry_filter(jobs: DataFrame, organisations: DataFrame, key: str, section: str, chosen: Sequence[str] | None) -> DataFrame:
    """Jobs at organisations of the chosen sections of economic activity; without a choice all, also those without one."""
    if chosen is None:
        return jobs
    kept = organisations.where(F.col(section).isin(*chosen)).select(key).distinct()
    return jobs.join(kept, key, "left_semi")


def headline_counts(persons: DataFrame, children: dict[str, DataFrame], jobs: DataFrame, organisations: DataFrame, locations: DataFrame, latin: str, year: str, least: int = 1845, most: int = 1945) -> DataFrame:
    """(metric, value): what is shown before any filter is touched.

    ``persons`` (person_id, location_id, the two gate columns), ``children`` by name and ``jobs`` hold person_id; organisations
    count if a shown job names them and they have a name, locations if a shown person, job or organisation does.
    """
    shown = persons.where(default_gate(F.col(latin), F.col(year), least, most))
    ids = shown.select("person_id").distinct()
    own = jobs.join(ids, "person_id", "left_semi")
    orgs = organisations.where(F.trim(F.coalesce("name", F.lit(""))) != "").join(own.select("organization_id").where("organization_id is not null").distinct(), "organization_id", "left_semi")
    named = shown.select("location_id").unionByName(own.select("location_id")).unionByName(orgs.select("location_id")).where("location_id is not null").distinct()
    count = lambda metric, df: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), "value")
    rows = [("persons", persons), ("persons shown", shown), ("jobs", own), *((k, df.join(ids, "person_id", "left_semi")) for k, df in children.items())]
    rows += [("organisations linked", orgs), ("locations referenced", locations.join(named, "location_id", "left_semi"))]
    rows += [("excluded: name", persons.where(F.length(F.coalesce(latin, F.lit(""))) < 2)), ("excluded: birth year", persons.where(~birth_gate(F.col(year), least, most)))]
    out = count(*rows[0])
    for r in rows[1:]:
        out = out.unionByName(count(*r))
    return out


def id_filter(text: str) -> tuple[str, str] | None:
    """(kind, id) of a typed id such as P12, O7 or L3."""
    kinds = {"P": "person", "O": "organization", "L": "location"}
    return (kinds[text[0]], text) if text[:1] in kinds and text[1:].isalnum() and any(c.isdigit() for c in text) else None


def birth_gate(year: Column, least: int = 1845, most: int = 1945) -> Column:
    """True for a year in the range or none."""
    return year.isNull() | year.between(least, most)


def default_gate(latin: Column, year: Column, least: int = 1845, most: int = 1945) -> Column:
    """True for the persons shown at first: a romanised family name of two letters or more, a birth year in the range or none."""
    return (F.length(F.coalesce(latin, F.lit(""))) >= 2) & birth_gate(year, least, most)


def any_known(columns: Sequence[Column]) -> Column:
    """True where one of the columns is not null."""
    return F.coalesce(*[c.cast("string") for c in columns]).isNotNull()


def rollup_counts(counts: DataFrame, links: DataFrame, key: str, parent: str, n: str) -> DataFrame:
    """Counts with those of the direct children added, for parents that have a count of their own."""
    kids = links.where(F.col(parent).isNotNull()).select(F.col(key), F.col(parent)).distinct().join(counts, key).groupBy(F.col(parent).alias(key)).agg(F.sum(n).alias("_kids"))
    return counts.join(kids, key, "left").select(key, (F.col(n) + F.coalesce("_kids", F.lit(0))).cast("bigint").alias(n))


def distinct_per(df: DataFrame, key: Sequence[str], what: str, name: str) -> DataFrame:
    """Distinct values per key."""
    return df.groupBy(*key).agg(F.count_distinct(what).alias(name))


def top_k(df: DataFrame, key: str, k: int, first: str) -> DataFrame:
    """The k commonest values; ties go to the one seen first, then to the smaller."""
    c = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("_f"))
    return c.orderBy(F.col("n").desc(), "_f", key).limit(k).select(key, "n")
