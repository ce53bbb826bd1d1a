"""Data-quality rules with an audit trail: every rule gives the cleaned rows and one audit row per change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUDIT = ("subject_id", "change_type", "field", "old_value", "new_value", "reason")
# Pairs of relations of which a person has one only.
CONFLICT_PAIRS = (("長男", "一男"), ("長女", "一女"))


def audit_rows(changed: DataFrame, subject: str, change: str, field: str, old: Column, new: Column, reason: str) -> DataFrame:
    """Audit records of changed rows; old and new values are kept as text."""
    return changed.select(
        F.col(subject).cast("string").alias("subject_id"), F.lit(change).alias("change_type"), F.lit(field).alias("field"),
        old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), F.lit(reason).alias("reason"),
    )


def null_where(df: DataFrame, bad: Column, columns: Sequence[str]) -> DataFrame:
    """The columns set to null in rows where ``bad`` is true."""
    return df.withColumns({c: F.when(~F.coalesce(bad, F.lit(False)), F.col(c)) for c in columns})


def rule_null(df: DataFrame, bad: Column, column: str, subject: str, change: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(cleaned, audit) of a rule that empties one column."""
    hit = F.coalesce(bad, F.lit(False)) & F.col(column).isNotNull()
    audit = audit_rows(df.where(hit), subject, change, column, F.col(column), F.lit(None).cast("string"), reason)
    return null_where(df, hit, [column]), audit


def rule_drop(df: DataFrame, bad: Column, subject: str, change: str, field: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(kept, audit) of a rule that deletes rows."""
    hit = F.coalesce(bad, F.lit(False))
    return df.where(~hit), audit_rows(df.where(hit), subject, change, field, F.col(field), F.lit(None).cast("string"), reason)


def year_after(year: Column, limit: Column) -> Column:
    """True for a year later than the limit."""
    return year > limit


def too_young(year: Column, birth: Column, age: int) -> Column:
    """True for an event before the given age."""
    return year < birth + age


def spouse_conflicts(df: DataFrame, person: str, relation: str, gender: str) -> DataFrame:
    """``conflict``: True for the spouse relation that contradicts the person's gender, where both 妻 and 夫 occur."""
    w = Window.partitionBy(person)
    both = (F.max((F.col(relation) == "妻").cast("int")).over(w) + F.max((F.col(relation) == "夫").cast("int")).over(w)) == 2
    wrong = ((F.col(gender) == "m") & (F.col(relation) == "夫")) | ((F.col(gender) == "f") & (F.col(relation) == "妻"))
    return df.withColumn("conflict", F.coalesce(both & wrong, F.lit(False)))


def stale_refs(df: DataFrame, column: str, hollow: DataFrame, key: str) -> DataFrame:
    """References to hollow records set to null."""
    marks = hollow.select(F.col(key).alias(column), F.lit(True).alias("_hollow")).distinct()
    return df.join(marks, column, "left").withColumn(column, F.when(F.col("_hollow").isNull(), F.col(column))).drop("_hollow")


def phantom_rows(df: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Rows in which all identity columns are null or empty."""
    return df.where(F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in identity]).isNull())


# Words that refer to an organisation named before; names of schools for girls.
DEICTIC_ORGS = "本省 現社 本縣 地方 本府 本店 現地".split()
GIRLS_SCHOOLS = "高女|女學校|女学校|女子.*學校|女子.*学校|女子専門|女子師範"


def without_children(children: DataFrame, dropped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows of dropped parents left out; null keys belong to no parent."""
    return children.join(dropped.select(*keys).distinct(), list(keys), "left_anti")


def males_at_girls_schools(education: DataFrame, gender: Column, school: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): school records of men at schools for girls are deleted."""
    hit = F.coalesce((F.lower(gender) == "m") & school.rlike(GIRLS_SCHOOLS), F.lit(False))
    return education.where(~hit), education.where(hit)


def origin_domain(domain: Column, origin_country: Column, career_countries: Column) -> Column:
    """The domain by the country of origin, else by the only country of all jobs, else as it was."""
    one = F.when(F.size(F.array_distinct(F.array_compact(career_countries))) == 1, F.element_at(F.array_distinct(F.array_compact(career_countries)), 1))
    return F.coalesce(origin_country, one, domain)
