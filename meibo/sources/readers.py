"""Scans of the pipeline's files: JSON lines, segment files, gazetteers, boundaries, gold samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meibo.operators.ordered import path_numbers

SEGMENT = "type STRING, segment_index INT, header_ocr STRING, segment_x_range ARRAY<INT>, body_text STRING, source_image STRING, bbox_header ARRAY<INT>"
BIOGRAPHY = (
    "entry_index BIGINT, source_image STRING, source_page STRING, header_ocr STRING, validation STRING, extraction STRUCT<name: STRING, rank: STRING, place: STRING, phone_number: STRING, tax_amount: STRING, political_party: STRING, "
    "birth_year: INT, birth_year_raw: STRING, origin_place: STRING, hobbies: ARRAY<STRING>, religion: STRING, education: ARRAY<STRUCT<institution: STRING, major_of_study: STRING, year_graduated: INT, year_raw: STRING>>, "
    "career: ARRAY<STRUCT<job_title: STRING, organization: STRING, start_year: INT, start_year_raw: STRING, place_name: STRING, current: BOOLEAN>>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path (or a glob) names a file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """A typed table without rows."""
    return spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str, schema: str, skip_meta: bool = False) -> DataFrame:
    """A JSON Lines table; a missing file gives the typed empty table, header records are skipped on request."""
    if not exists(spark, path):
        return empty(spark, schema)
    if not skip_meta:
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema + ", _meta BOOLEAN").json(path).where(F.col("_meta").isNull()).drop("_meta")


def valid_records(biographies: DataFrame) -> DataFrame:
    """Biographies that passed validation and hold an extraction; the filter goes into the scan."""
    return biographies.where((F.col("validation") == "Passed") & F.col("extraction").isNotNull())


def volume_records(spark: SparkSession, pattern: str, schema: str = BIOGRAPHY) -> DataFrame:
    """All volumes' valid records, the volume taken from the file's name (``biographies_extracted_<volume>.jsonl``)."""
    if not exists(spark, pattern):
        return empty(spark, schema + ", volume STRING")
    df = spark.read.schema(schema).json(pattern)
    return valid_records(df).withColumn("volume", F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"_([^_]+)\.jsonl$", 1), F.lit("")))


def segments(spark: SparkSession, root: str) -> DataFrame:
    """Segments of all pages in scan order; corrupt files give no rows.  ``file_order`` is the list of integers in the path."""
    schema = SEGMENT + ", _corrupt_record STRING"
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*segmented_output.json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(root)
    path = F.col("_metadata.file_path")
    read = df.select("*", path_numbers(path).alias("file_order"), F.element_at(F.split(path, "/"), -2).alias("source_page"))
    return read.where(F.col("_corrupt_record").isNull() & F.col("type").isNotNull()).drop("_corrupt_record")


def geonames(spark: SparkSession, path: str, overrides: DataFrame | None = None, synthetic: DataFrame | None = None) -> DataFrame:
    """(name, geonameid, latitude, longitude, code, country): the CJK alternate names of places and divisions.

    ``overrides`` (geonameid, latitude, longitude) replaces coordinates; ``synthetic`` adds names the file lacks.
    """
    cols = ", ".join(f"c{i} STRING" for i in range(8))
    raw = spark.read.schema(cols).option("sep", "\t").option("quote", "").csv(path).withColumn("country", F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Z]{2})", 1))
    kept = raw.where(F.col("c7").isNotNull() & F.col("c6").isin("A", "P"))
    names = kept.select(F.explode(F.split(F.concat_ws(",", "c1", "c3"), ",")).alias("name"), F.col("c0").try_cast("bigint").alias("geonameid"), F.col("c4").try_cast("double").alias("latitude"), F.col("c5").try_cast("double").alias("longitude"), F.col("c7").alias("code"), "country")
    names = names.where(F.col("name").rlike("^[一-鿿ケヶ]+$") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).distinct()
    if overrides is not None:
        o = overrides.select("geonameid", F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"))
        names = names.join(o, "geonameid", "left").withColumns({"latitude": F.coalesce("_la", "latitude"), "longitude": F.coalesce("_lo", "longitude")}).drop("_la", "_lo")
    if synthetic is not None:
        names = names.unionByName(synthetic.join(names.select("name").distinct(), "name", "left_anti"))
    return names


def placenames(gazetteer: DataFrame) -> DataFrame:
    """The distinct Han names of two to four characters."""
    return gazetteer.where(F.col("name").rlike("^[一-鿿]{2,4}$")).select("name").distinct()


def mcgd(spark: SparkSession, path: str, codes: tuple[str, ...] = ("A", "C", "P", "PP")) -> DataFrame:
    """(name, latitude, longitude, province, locid) of the historical gazetteer; rows without coordinates are left out."""
    df = spark.read.option("header", True).csv(path)
    out = df.where(F.col("Code").isin(*codes)).select(F.col("Name").alias("name"), F.col("LAT").try_cast("double").alias("latitude"), F.col("LONG").try_cast("double").alias("longitude"), F.col("Prov_Zh").alias("province"), F.col("LocID").alias("locid"))
    return out.where("latitude is not null and longitude is not null")


def boundaries(spark: SparkSession, path: str, name_property: str, country: str) -> DataFrame:
    """(region_id, province, country, rings): the polygons of a GeoJSON file, ring by ring."""
    schema = f"features ARRAY<STRUCT<properties: STRUCT<`{name_property}`: STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("i", "f"))
    poly = F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    multi = F.flatten(F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"))
    rings = F.transform(F.when(F.col("f.geometry.type") == "MultiPolygon", multi).otherwise(poly), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return f.select(F.concat(F.lit(country + "-"), F.col("i").cast("string")).alias("region_id"), F.col(f"f.properties.`{name_property}`").alias("province"), F.lit(country).alias("country"), rings.alias("rings"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(old_id, new_id) of a file of manual merges."""
    df = json_lines(spark, path, "canonical_id STRING, merged_ids ARRAY<STRING>")
    return df.select(F.explode("merged_ids").alias("old_id"), F.col("canonical_id").alias("new_id"))


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """A gold sample: a byte-order mark is stripped, and a header of the form Column1..N gives way to the first row."""
    raw = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    head = [(x or "").lstrip("﻿") for x in (raw.first() or [])]
    plain = raw.withColumn("_c0", F.ltrim(F.regexp_replace("_c0", "^﻿", "")))
    first = plain.columns
    drop = [tuple(head)]
    if head and all(h == f"Column{i}" for i, h in enumerate(head, 1)):
        rows = plain.limit(2).collect()
        head = [x or f"c{i}" for i, x in enumerate(rows[1])] if len(rows) > 1 else head
        drop.append(tuple(rows[1]) if len(rows) > 1 else ())
    named = plain.toDF(*head)
    for d in drop:
        if len(d) == len(head):
            hit = F.lit(True)
            for c, v in zip(head, d):
                hit = hit & F.col(f"`{c}`").eqNullSafe(F.lit(v))
            named = named.where(~hit)
    return named if first else plain


def dictionary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small CSV dictionary; a missing file gives the typed empty table."""
    return spark.read.schema(schema).option("header", True).csv(path) if exists(spark, path) else empty(spark, schema)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists."""
    return next((p for p in paths if exists(spark, p)), None)
