from datetime import datetime as dt

from pyspark.sql import functions as F

from meibo.functions.keys import hot_keys, id_key, skew_lookup
from meibo.operators.orphans import orphan_references, orphan_report, parent_intervals, references

PARENTS = "organization_id string, loaded_at timestamp, deleted_at timestamp, name string"
REFS = "row_id long, organization_id string, loaded_at timestamp, source_volume array<string>, _key string, status string"


def test_id_key_forms(spark):
    forms = ["O7", "o7", " O7\t", "Ｏ００７", "O007", "　O7　", "", "  ", "NULL", "null", None, "O0"]
    got = [r.k for r in spark.createDataFrame([(x,) for x in forms], "x string").select(id_key("x").alias("k")).collect()]
    assert got == ["O7"] * 6 + [None] * 5 + ["O0"]


def parents(spark):
    return spark.createDataFrame(
        [("O1", dt(2024, 1, 1), None, "a"), ("O1", dt(2024, 1, 1), None, "a"), ("o2", dt(2024, 1, 1), dt(2024, 2, 1), "b"), ("O3", dt(2024, 6, 1), None, "c"), ("O4", dt(2024, 1, 1), dt(2024, 2, 1), "d"), ("O4", dt(2024, 3, 1), None, "d"), (None, dt(2024, 1, 1), None, "e"), ("O9", None, None, "f")],
        PARENTS,
    )


def test_missing_late_deleted(spark):
    at = dt(2024, 2, 15)
    rows = [(1, "O1", at), (2, "O2", at), (3, "Ｏ３", at), (4, "O4", at), (5, "O5", at), (6, "", at), (7, None, at), (8, "O1", None), (9, "O9", at), (5, "O5", at), (10, "O2", dt(2024, 2, 1)), (11, "O4", dt(2024, 3, 1))]
    # clashing extra columns do no harm
    refs = spark.createDataFrame([(i, o, t, ["1927"], "x", "y") for i, o, t in rows], REFS)
    out = orphan_references(references(refs, "t", "row_id", "organization_id"), parent_intervals(parents(spark), "organization_id"))
    got = sorted((r.row_id, r.status) for r in out.collect())
    assert got == [(2, "deleted"), (3, "late"), (4, "deleted"), (5, "missing"), (5, "missing"), (8, "late"), (9, "missing"), (10, "deleted")]
    assert {(r.status, r.n_orphans) for r in orphan_report(out).collect()} == {("deleted", 3), ("late", 2), ("missing", 3)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], REFS)
    assert orphan_references(references(none, "t", "row_id", "organization_id"), parent_intervals(parents(spark), "organization_id")).count() == 0
    refs = spark.createDataFrame([(1, "O1", dt(2024, 1, 1), None, None, None)], REFS)
    out = orphan_references(references(refs, "t", "row_id", "organization_id"), parent_intervals(spark.createDataFrame([], PARENTS), "organization_id"))
    assert [r.status for r in out.collect()] == ["missing"]


def test_hot_key_is_spread_and_keeps_every_row(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
    small = big.select("k").distinct().withColumn("v", F.length("k"))
    assert hot_keys(big, "k", least=100) == ["hot"]
    got = skew_lookup(big, small, "k", least=100)
    assert got.count() == 3000 and got.where("v is null").count() == 0
