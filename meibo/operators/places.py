"""Prefix joins, hierarchies of names, geocoding choices and geometric assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meibo.functions.text import prefixes
from meibo.operators.spatial import haversine_km

# Rank of a gazetteer feature (smaller is better), default 5.
FEATURE_PRIORITY = {"ADM1": 0, "ADM2": 1, "ADM3": 2, "PPLC": 3, "PPL": 4, "PPLA": 3, "PPLA2": 3}


def longest_prefix_join(texts: DataFrame, text: str, dictionary: DataFrame, entry: str, least: int = 2, proper: bool = False, rest: int = 0) -> DataFrame:
    """``texts`` distinct on ``text`` with ``_entry``, the longest dictionary entry they begin with.

    All prefixes meet the dictionary in one equi-join; the longest wins.  Texts without any are left out.
    """
    words = dictionary.select(F.col(entry).alias("_entry")).where(F.length("_entry") >= least).distinct()
    cut = prefixes(text, least)
    if proper or rest:
        cut = F.filter(cut, lambda p: F.length(p) <= F.length(F.col(text)) - max(rest, 1))
    each = texts.select(text).where(F.col(text).isNotNull()).distinct().select(text, F.explode(cut).alias("_entry"))
    return each.join(words, "_entry").groupBy(text).agg(F.max_by("_entry", F.length("_entry")).alias("_entry"))


def name_hierarchy(orgs: DataFrame, id_col: str, name: str, skip: Sequence[str] = (), places: DataFrame | None = None) -> DataFrame:
    """(child_id, parent_id, child_name, parent_name): each name's longest proper prefix that is a name itself, with two characters or more left.

    No parent is a name whose Chinese characters are in ``skip`` or are the name of one of ``places`` (column ``name``).
    """
    cjk = F.regexp_replace(name, "[^\u4e00-\u9fff]", "")
    parents = orgs.where(~cjk.isin(*skip)) if skip else orgs
    if places is not None:
        known = places.select(F.col("name").alias("_place")).where(F.col("_place").isNotNull()).distinct()
        parents = parents.withColumn("_place", cjk).join(known, "_place", "left_anti").drop("_place")
    hit = longest_prefix_join(orgs.where(F.length(name) >= 4), name, parents, name, 2, proper=True, rest=2)
    holder = orgs.groupBy(F.col(name).alias("_entry")).agg(F.min(id_col).alias("parent_id"))
    kids = orgs.select(F.col(id_col).alias("child_id"), name).distinct()
    return hit.join(holder, "_entry").join(kids, name).select("child_id", "parent_id", F.col(name).alias("child_name"), F.col("_entry").alias("parent_name"))


def feature_score(code: Column, country: Column, preferred: Column, has_origin: Column) -> Column:
    """Rank of a gazetteer candidate: its feature, less 1.5 in the preferred country, less 0.1 at home."""
    pairs = [x for k, v in FEATURE_PRIORITY.items() for x in (F.lit(k), F.lit(float(v)))]
    base = F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(5.0))
    return base - F.when(country == preferred, 1.5).when(has_origin & (country == "JP"), 0.1).otherwise(0.0)


def geocode(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(place, geonameid, latitude, longitude): the longest prefix in the gazetteer, there the best-ranked candidate.

    ``places`` has place and origin; the smallest origin of a place decides, so results never depend on row order.
    A place with a Japanese administrative pattern takes Japanese candidates only.
    """
    p = places.where(F.col("place").isNotNull()).groupBy("place").agg(F.min("origin").alias("origin"))
    preferred = F.when(F.col("origin").rlike("臺灣|台灣|台北"), "TW").when(F.col("origin").rlike("朝鮮|韓"), "KR").when(F.col("origin").rlike("中國|中国|上海|北京|南京|廣東"), "CN")
    japanese = F.col("place").rlike("郡.{1,10}(?:町|村)|[區区]|丁目|番地|番町")
    each = p.select("place", "origin", preferred.alias("_cc"), japanese.alias("_jp"), F.explode(prefixes(F.regexp_replace("place", "[^一-鿿ケヶ]", ""), 2)).alias("name"))
    met = each.join(gazetteer, "name").where(~F.col("_jp") | (F.col("country") == "JP"))
    score = feature_score(F.col("code"), F.col("country"), F.col("_cc"), F.coalesce(F.col("origin") != "", F.lit(False)))
    best = F.struct(F.length("name").alias("l"), (-score).alias("s"), (-F.col("geonameid")).alias("g"))
    return met.groupBy("place").agg(F.max_by(F.struct("geonameid", "latitude", "longitude"), best).alias("h")).select("place", "h.*")


def located_by(own: Column, fallback: Column) -> Column:
    """A row's own location, else that of the organisation it names."""
    return F.coalesce(own, fallback)


def organisation_spread(points: DataFrame, org: str, lat: str, lon: str, cell: float = 1.0) -> DataFrame:
    """(org, spread_km): the diameter of an organisation's distinct places, exactly.

    Places fold to grid cells with a centre and a radius.  Two cells bound the distances between their places from
    below and above; only places of cell pairs that can still hold the farthest two are compared one by one, so
    an organisation with a third of all rows does not compare all its places.
    """
    p = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(org).isNotNull()).select(F.col(org).alias("k"), F.col(lat).alias("la"), F.col(lon).alias("lo")).distinct()
    p = p.withColumn("c", F.struct(F.floor(F.col("la") / cell).alias("i"), F.floor(F.col("lo") / cell).alias("j")))
    far = lambda a, b, c, d: haversine_km(F.col(a), F.col(b), F.col(c), F.col(d), 6371.0)
    centres = p.groupBy("k", "c").agg(F.avg("la").alias("ma"), F.avg("lo").alias("mo"))
    cells = p.join(centres, ["k", "c"]).groupBy("k", "c").agg(F.first("ma").alias("ma"), F.first("mo").alias("mo"), F.max(far("la", "lo", "ma", "mo")).alias("r"))
    other = cells.select("k", F.col("c").alias("c2"), F.col("ma").alias("ma2"), F.col("mo").alias("mo2"), F.col("r").alias("r2"))
    mid = far("ma", "mo", "ma2", "mo2")
    pairs = cells.join(other, "k").where(F.col("c") <= F.col("c2")).select("k", "c", "c2", (mid - F.col("r") - F.col("r2")).alias("low"), (mid + F.col("r") + F.col("r2")).alias("high"))
    floor = pairs.groupBy("k").agg(F.max("low").alias("floor"))
    open_pairs = pairs.join(floor, "k").where(F.col("high") >= F.col("floor") - 1e-6).select("k", "c", "c2")
    q = p.select("k", F.col("la").alias("lb"), F.col("lo").alias("ob"), F.col("c").alias("c2"))
    met = open_pairs.join(p, ["k", "c"]).join(q, ["k", "c2"])
    return met.groupBy(F.col("k").alias(org)).agg(F.max(far("la", "lo", "lb", "ob")).alias("spread_km"))


def commonest(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the commonest value of each key, of equal ones the one seen first."""
    c = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_f"))
    return c.groupBy(key).agg(F.max_by(value, F.struct("_n", (-F.col("_f")).alias("f"))).alias(value))


def first_region(points: DataFrame, hits: DataFrame, region_order: str = "region_id") -> DataFrame:
    """(_pid, region_id): of the regions a point lies in, the first."""
    return hits.groupBy("_pid").agg(F.min(region_order).alias("region_id"))


def box_area(box: Column) -> Column:
    """The area of a box (x1, y1, x2, y2); 0 if it is turned inside out."""
    return F.greatest(box[2] - box[0], F.lit(0)) * F.greatest(box[3] - box[1], F.lit(0))


def box_overlap(a: Column, b: Column) -> Column:
    """The common area of two boxes."""
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))


def box_centre(box: Column) -> Column:
    """(x, y) of a box's centre."""
    return F.struct(((box[0] + box[2]) / 2).alias("x"), ((box[1] + box[3]) / 2).alias("y"))


def contained_in(points: DataFrame, boxes: DataFrame, within: str, px: str, py: str, box: str, order: str, item: str) -> DataFrame:
    """(within, item, order): each point's first box that holds it, compared on one page only."""
    joined = points.join(boxes, within).where(F.col(px).between(F.col(box)[0], F.col(box)[2]) & F.col(py).between(F.col(box)[1], F.col(box)[3]))
    return joined.groupBy(within, item).agg(F.min(order).alias(order))


def assign_symbols(symbols: DataFrame, boxes: DataFrame, within: str, symbol: str, box: str, region: str) -> DataFrame:
    """Each symbol's region: over half of it in a header box, else over half in a body box, else its centre in one.

    ``boxes`` has (within, region, stage, region_box) with stage 0 for headers and 1 for bodies.
    """
    met = symbols.join(boxes, within)
    share = F.try_divide(box_overlap(F.col(box), F.col("region_box")), box_area(F.col(box)))
    c = box_centre(F.col(box))
    inside = c["x"].between(F.col("region_box")[0], F.col("region_box")[2]) & c["y"].between(F.col("region_box")[1], F.col("region_box")[3])
    rank = F.when((F.col("stage") == 0) & (share > 0.5), 0).when((F.col("stage") == 1) & (share > 0.5), 1).when(inside, 2)
    return met.withColumn("_r", rank).where("_r is not null").groupBy(within, symbol).agg(F.min_by(region, F.struct("_r", (-share).alias("s"), region)).alias(region))


def nearest(left: DataFrame, right: DataFrame, within: str, a: str, b: str, item: str, choice: str) -> DataFrame:
    """Each item's nearest value of the other side on the same page; ties to the smaller choice."""
    met = left.join(right, within)
    return met.groupBy(within, item).agg(F.min_by(choice, F.struct(F.abs(F.col(a) - F.col(b)).alias("d"), F.col(choice).alias("c"))).alias(choice))


def grid_key(lat: Column, lon: Column, digits: int = 1) -> Column:
    """Coordinates rounded half to even, as one key."""
    return F.struct(F.bround(lat, digits).alias("lat"), F.bround(lon, digits).alias("lon"))


def ranked_within(df: DataFrame, within: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with ``rank`` within their group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
