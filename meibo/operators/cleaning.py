"""Rule tables for cleaning: label repair, location fixes, branch offices, city assignment, family-name repair, answer picking."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.functions.classify import is_university_name
from meibo.functions.jsonfix import BROKEN, NOTHING, parse_answer
from meibo.functions.text import cjk_only
from meibo.operators.places import longest_prefix_join

# Cities whose name leads an organisation's name, and prefixes of colonial cities.
COLONIAL_PREFIXES = "大連 新京 京城 臺北 臺中 臺南 臺灣 撫順 四平 鞍山 奉天 哈爾".split()


def apply_rules(value: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A label with the regex replacements applied in order."""
    for pattern, new in rules:
        value = F.regexp_replace(value, pattern, new)
    return value


def set_where(df: DataFrame, hit: Column, values: dict[str, object]) -> DataFrame:
    """The given columns set to fixed values (or null) in rows where ``hit`` is true."""
    ok = F.coalesce(hit, F.lit(False))
    return df.withColumns({c: F.when(ok, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def misplaced_particles(locations: DataFrame, name: str = "name", country: str = "country", home: str = "ja") -> DataFrame:
    """Locations with ケ or ヶ found abroad lose their coordinates, unless a colonial city leads the name."""
    colonial = F.coalesce(cjk_only(name).rlike("^(?:" + "|".join(COLONIAL_PREFIXES) + ")"), F.lit(False))
    bad = F.col(name).rlike("[ケヶ]") & ~F.coalesce(F.col(country) == home, F.lit(False)) & ~colonial & F.col("latitude").isNotNull()
    return set_where(locations, bad, {"latitude": None, "longitude": None, "geonameid": None, "province": None, country: None})


def branch_offices(careers: DataFrame, place: str = "place_name", ends: Sequence[str] = ("支店", "支社", "出張所")) -> DataFrame:
    """Career rows whose place is a branch office give a second row with the office as the title's place emptied and ``branch`` named."""
    hit = F.coalesce(F.col(place).rlike("(?:" + "|".join(ends) + ")$"), F.lit(False))
    kept = careers.withColumns({"branch": F.lit(None).cast("string"), place: F.when(~hit, F.col(place))})
    added = careers.where(hit).withColumns({"branch": F.col(place), place: F.lit(None).cast("string")})
    return kept.unionByName(added)


# The ending of a branch named by its city; what tells that a name is not placed by the city it begins with.
BRANCH = "支店"
EACH = "各"
NOT_PLACED = "各|卒$|同店|同社|同校|同省|同局|同廳"
PERSON_WORDS = "長男|長女|次男|次女|三男|養子|妻|後裔"


def assign_city(orgs: DataFrame, name: str, location: str, cities: DataFrame) -> DataFrame:
    """Organisations without location get that of a city (``cities``: name, location_id; other spellings are further rows).

    A branch takes the longest city before its ending; any other name the longest it begins with and goes on after, unless it
    speaks of every place, of one named before or of a person.
    """
    known = cities.where("name is not null").select("name", F.col("location_id").alias("_loc")).dropDuplicates(["name"])
    open_names = orgs.where(F.col(location).isNull() & F.col(name).isNotNull()).select(name).distinct()
    is_branch = F.col(name).endswith(BRANCH) & ~F.contains(F.col(name), F.lit(EACH))
    head = F.substring(name, F.lit(1), F.length(name) - len(BRANCH))
    branches = open_names.where(is_branch).withColumn("_turned", F.reverse(head))
    ends = longest_prefix_join(branches, "_turned", known.select(F.reverse("name").alias("_city")), "_city").withColumn("_city", F.reverse("_entry")).select("_turned", "_city")
    of_branches = branches.join(ends, "_turned").select(name, "_city")
    begun = longest_prefix_join(open_names.where(~is_branch & ~F.col(name).rlike(NOT_PLACED)), name, known, "name", proper=True).select(name, F.col("_entry").alias("_city"))
    begun = begun.where(~F.substring(name, F.length("_city") + 1, F.length(name)).rlike(PERSON_WORDS))
    placed = of_branches.unionByName(begun).join(known.withColumnRenamed("name", "_city"), "_city").select(name, "_loc")
    return orgs.join(placed, name, "left").withColumn(location, F.coalesce(location, "_loc")).drop("_loc")


# Historical places that gazetteers lack, with coordinates, province and country; beginnings of their names and the
# provinces in which a place of that name may stand (None: none known).
HISTORICAL_PLACES = [
    ("興安西省", 44.00, 118.50, "Inner Mongolia", "zh"), ("興安北省", 49.22, 119.73, "Inner Mongolia", "zh"), ("興安東省", 48.00, 122.74, "Inner Mongolia", "zh"), ("興安南省", 46.07, 122.07, "Inner Mongolia", "zh"),
    ("興安總省", 46.00, 121.00, "Inner Mongolia", "zh"), ("厚和", 40.84, 111.75, "Suiyuan", "zh"), ("三江省", 46.80, 130.37, "Heilongjiang", "zh"), ("青島", 36.06, 120.38, "Shandong", "zh"), ("間島省", 42.88, 129.47, "Jilin", "zh"),
    ("安東省", 40.12, 124.39, "Liaoning", "zh"), ("安東縣", 40.12, 124.39, "Liaoning", "zh"), ("安東県", 40.12, 124.39, "Liaoning", "zh"), ("山海關", 40.00, 119.77, "Hebei", "zh"),
]
HISTORICAL_PROVINCES = {
    "興安": ("Inner Mongolia", "Heilongjiang", "Jilin", "Liaoning", None), "厚和": ("Inner Mongolia", "Suiyuan", "Chahaer", None), "三江省": ("Heilongjiang", None), "青島": ("Shandong", None),
    "間島": ("Jilin", None), "安東省": ("Liaoning", None), "安東縣": ("Liaoning", None), "安東県": ("Liaoning", None), "山海關": ("Hebei", None),
}
# Names too vague to be placed, anywhere in a name unless a street follows, and at its beginning only.
VAGUE_PLACES = {"蒙古": ("Inner Mongolia", "Chahaer", "Suiyuan", "Mongolia", None), "蒙疆": ("Inner Mongolia", "Chahaer", "Suiyuan", None), "綏遠": ("Inner Mongolia", "Suiyuan", None)}
VAGUE_BEGINNINGS = {"安東": ("Liaoning", "Gyeongsangbuk-do", "Gyeongsangbuk-do\t", "Mie", "Changhua", None)}
STREET_AFTER = "[路通]"
PLACED_COLUMNS = "geonameid latitude longitude province country admin1 admin1_en admin2 admin2_en admin3 admin3_en admin1_norm name_en".split()


def _elsewhere(province: Column, right: Sequence[str | None]) -> Column:
    known = [p for p in right if p is not None]
    return F.when(province.isNull(), F.lit(None not in right)).otherwise(~province.isin(*known))


def historical_locations(locations: DataFrame, name: str = "name") -> DataFrame:
    """Locations that a gazetteer put into a wrong region, by the tables above: known places are moved, vague ones lose their position.

    Only records with a ``geonameid`` are looked at.  The longest known place in the name counts.
    """
    n, province = F.col(name), F.col("province")
    looked = F.col("geonameid").isNotNull() & n.isNotNull()
    by_length = sorted(HISTORICAL_PLACES, key=lambda p: len(p[0]), reverse=True)
    place = F.coalesce(*[F.when(F.contains(n, F.lit(p[0])), F.lit(p[0])) for p in by_length])
    right = {p[0]: HISTORICAL_PROVINCES[max((k for k in HISTORICAL_PROVINCES if k in p[0]), key=len)] for p in HISTORICAL_PLACES}
    moved, values = F.lit(False), {c: F.lit(None) for c in ("latitude", "longitude", "province", "country")}
    for known, lat, lon, prov, country in HISTORICAL_PLACES:
        here = looked & F.coalesce(place == known, F.lit(False)) & _elsewhere(province, right[known])
        moved = moved | here
        values = {c: F.when(here, F.lit(v)).otherwise(values[c]) for c, v in zip(values, (lat, lon, prov, country))}
    vague = F.lit(False)
    for word, places in VAGUE_PLACES.items():
        first = F.instr(n, word)
        street = F.substring(n, first + len(word), F.lit(1)).rlike(STREET_AFTER)
        vague = vague | ((first > 0) & ~street & _elsewhere(province, places))
    for word, places in VAGUE_BEGINNINGS.items():
        vague = vague | (n.startswith(word) & _elsewhere(province, places))
    vague = looked & ~moved & vague
    out = locations.withColumns({"_moved": moved, "_vague": vague, **{f"_{c}": v for c, v in values.items()}})
    for c in (x for x in PLACED_COLUMNS if x in locations.columns):
        kept = F.when(F.col("_vague"), F.lit(None)).otherwise(F.col(c))
        new = F.when(F.col("_moved"), F.col(f"_{c}") if c in values else F.lit(None) if c == "geonameid" else F.col(c)).otherwise(kept)
        out = out.withColumn(c, new.cast(locations.schema[c].dataType))
    return out.select(*locations.columns)


def university_locations(locations: DataFrame, name: str = "name") -> DataFrame:
    """Locations named by a university's short name and what follows it, which are no places, lose their position."""
    hit = F.coalesce(is_university_name(F.col(name)), F.lit(False))
    return set_where(locations, hit, {c: None for c in [*PLACED_COLUMNS, "mcgd_locid"] if c in locations.columns})


# Labels repaired: the original has the first pattern and not the second, the label's match of the third becomes the fourth.
LABEL_REPAIRS = [
    ("^本縣", None, r"(?i)^(?:Honken|Hon-ken|Honshu|Honten|Honma|Honjo|Hon )\s*", "Prefectural "),
    ("^本府", None, r"(?i)^(?:Honfu|Hon-fu|Honfuro|Honjo|Honmachi|Honmura|Honno|Honshu|Hon )\s*", "Prefectural "),
    ("新京", "新京[極阪]", r"(?i)Shinkei|Shinky[oōou]?|Shinkin|Changchun|Mukden|Harbin|New (?:Capital|Beijing|Kyoto|Tokyo|Changchun)", "Hsinking"),
]
GIRLS_HIGH_SCHOOL, GIRLS_LABEL, GIRLS_MISREAD = "高女", "Girls' High School", "Takano"


def repaired_label(original: Column, label: Column, repairs: Sequence[tuple[str, str | None, str, str]] = LABEL_REPAIRS) -> Column:
    """An English label with what translation gets wrong of abbreviations and old names set right; null where a misreading can't be."""
    out = label
    for having, but, wrong, right in repairs:
        ok = original.rlike(having) & (~original.rlike(but) if but else F.lit(True))
        out = F.when(F.coalesce(ok, F.lit(False)), F.regexp_replace(out, wrong, right)).otherwise(out)
    misread = F.contains(original, F.lit(GIRLS_HIGH_SCHOOL)) & F.contains(out, F.lit(GIRLS_MISREAD))
    return F.when(original == GIRLS_HIGH_SCHOOL, F.lit(GIRLS_LABEL)).when(~F.coalesce(misread, F.lit(False)), out)


def null_org_places(orgs: DataFrame, locations: DataFrame, is_org: Column, key: str = "location_id") -> DataFrame:
    """Organisations located at a place that is an organisation's name lose the location."""
    bad = locations.where(is_org).select(F.col(key).alias("_bad")).distinct()
    return orgs.join(bad, F.col(key) == F.col("_bad"), "left").withColumn(key, F.when(F.col("_bad").isNull(), F.col(key))).drop("_bad")


def family_names(relatives: DataFrame, name: str, surnames: DataFrame, surname: str) -> DataFrame:
    """(name, family, given) of relatives' names that begin with a known surname of two to four characters and go on."""
    hit = longest_prefix_join(relatives, name, surnames.where(F.length(surname).between(2, 4)), surname, proper=True)
    return hit.select(name, F.col("_entry").alias("family"), F.expr(f"substring({name}, length(_entry) + 1)").alias("given"))


# Fixed value: letters that only pinyin has, not the romanisation of Japanese.
PINYIN_ONLY = r"(?i)(?:zh|(?<![aeiouns])x[aeiou]|(?<![aeiou])q[iuü]|(?<![aeiou])c[aeiou](?!h))"


def wrong_romanisation(latin: Column) -> Column:
    """True for a romanised Japanese name that holds syllables only pinyin has."""
    return F.coalesce(latin.rlike(PINYIN_ONLY), F.lit(False))


def pick_answer(text: str | None, name: str | None) -> dict | None:
    """The object of an answer that is about ``name``: the exact one, one that contains it, one half alike or more, else the first."""
    value = parse_answer(text)
    if value is BROKEN or value is NOTHING:
        return None
    items = [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
    if not items:
        return None
    names = [x.get("name") if isinstance(x.get("name"), str) else "" for x in items]
    if name:
        for test in (lambda n: n == name, lambda n: bool(n) and (n in name or name in n)):
            hit = next((x for x, n in zip(items, names) if test(n)), None)
            if hit:
                return hit
        score, best = max(((difflib.SequenceMatcher(None, n, name).ratio(), -k) for k, n in enumerate(names)), default=(0, 0))
        if score >= 0.5:
            return items[-best]
    return items[0]


def compact_answers(df: DataFrame, key: str, answer: str, name: str | None = None) -> DataFrame:
    """(key, answer): each answer's picked object as compact JSON, null without any."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [pick_answer(a, n if isinstance(n, str) else None) for a, n in zip(pdf["a"], pdf["n"])]
            yield pd.DataFrame({key: pdf["k"], "answer": [None if g is None else json.dumps(g, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for g in got]})

    src = df.select(F.col(key).alias("k"), F.col(answer).alias("a"), (F.col(name) if name else F.lit(None).cast("string")).alias("n"))
    return src.mapInPandas(run, f"{key} {kind}, answer string")


def activity_order(year: str, current: str, volume_year: str) -> Column:
    """Year by which dated and current entries sort: the start year, else the volume's year if current."""
    return F.coalesce(F.col(year), F.when(F.col(current), F.col(volume_year)))


def reading_order(within: Sequence[str], x: str, y: str) -> list[Column]:
    """Vertical script: columns from right to left, each from top to bottom."""
    return [*[F.col(w) for w in within], F.col(x).desc(), F.col(y).asc()]


def density(points: DataFrame, key: str, value: str, grid: DataFrame, at: str, bandwidth: float = 1.0) -> DataFrame:
    """(key, at, density): Gaussian kernel density of a value on a grid of integers, over counts of rounded values within four bandwidths."""
    counts = points.where(F.col(value).isNotNull()).groupBy(key, F.round(value).cast("int").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    reach = int(4 * bandwidth)
    near = counts.withColumn(at, F.explode(F.sequence(F.col("_v") - reach, F.col("_v") + reach))).join(grid.select(at).distinct(), at, "left_semi")
    z = (F.col(at) - F.col("_v")) / bandwidth
    total = counts.groupBy(key).agg(F.sum("_n").alias("_t"))
    return near.groupBy(key, at).agg(F.sum(F.col("_n") * F.exp(-z * z / 2)).alias("_s")).join(total, key).select(key, at, (F.col("_s") / (F.col("_t") * bandwidth * 2.5066282746310002)).alias("density"))
