import pytest
from pyspark.sql import functions as F

from meibo.operators import cleaning as L


def test_rules_and_fixes(spark):
    df = spark.createDataFrame([("本郷ヶ丘", "ko", 1.0, 2.0, 3, "p"), ("京城ヶ丘", "ko", 1.0, 2.0, 3, "p"), ("自由ヶ丘", "ja", 1.0, 2.0, 3, "p"), (None, None, None, None, None, None)], "name string, country string, latitude double, longitude double, geonameid long, province string")
    assert {(r.name, r.latitude) for r in L.misplaced_particles(df).collect()} == {("本郷ヶ丘", None), ("京城ヶ丘", 1.0), ("自由ヶ丘", 1.0), (None, None)}
    assert df.select(L.apply_rules(F.lit("Honken Prefecture"), [("Honken", "this"), (" Pref.*", "")]).alias("x")).first().x == "this"
    c = spark.createDataFrame([("a", "京都支店"), ("b", "京都"), ("c", None)], "k string, place_name string")
    assert sorted((r.k, r.place_name or "", r.branch or "") for r in L.branch_offices(c).collect()) == [("a", "", ""), ("a", "", "京都支店"), ("b", "京都", ""), ("c", "", "")]


def test_cities_and_names(spark):
    cities = spark.createDataFrame([("大阪", "L1"), ("大阪府", "L2")], "name string, location_id string")
    orgs = spark.createDataFrame([("大阪府廳", None), ("大阪商船", None), ("京都府廳", None), ("大阪毎日", "L9")], "name string, loc string")
    assert {(r.name, r.loc) for r in L.assign_city(orgs, "name", "loc", cities).collect()} == {("大阪府廳", "L2"), ("大阪商船", "L1"), ("京都府廳", None), ("大阪毎日", "L9")}
    rel = spark.createDataFrame([("山田太郎",), ("山田",), (None,)], "n string")
    assert [tuple(r) for r in L.family_names(rel, "n", spark.createDataFrame([("山田",)], "s string"), "s").collect()] == [("山田太郎", "山田", "太郎")]
    assert [r.x for r in spark.createDataFrame([("Zhang",), ("Tanaka",), (None,)], "n string").select(L.wrong_romanisation(F.col("n")).alias("x")).collect()] == [True, False, False]
    locs = spark.createDataFrame([("L1", "x銀行"), ("L2", "x町")], "location_id string, name string")
    o = spark.createDataFrame([("o", "L1"), ("p", "L2"), ("q", None)], "k string, location_id string")
    assert {(r.k, r.location_id) for r in L.null_org_places(o, locs, F.col("name").contains("銀行")).collect()} == {("o", None), ("p", "L2"), ("q", None)}


def test_answers(spark):
    text = '[{"name": "山田太郎", "x": 1}, {"name": "山田花子"}]'
    assert L.pick_answer(text, "山田花子")["name"] == "山田花子" and L.pick_answer(text, "太郎")["x"] == 1 and L.pick_answer(text, "zz")["x"] == 1
    assert L.pick_answer("[{", "x") is None and L.pick_answer("[1]", "x") is None and L.pick_answer(None, None) is None
    df = spark.createDataFrame([(1, "```json\n" + text + "\n```", "山田花子"), (2, None, None)], "k long, a string, n string")
    assert {(r.k, r.answer) for r in L.compact_answers(df, "k", "a", "n").collect()} == {(1, '{"name":"山田花子"}'), (2, None)}


def test_density(spark):
    p = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", None)], "k string, v double")
    g = spark.range(-3, 5).select(F.col("id").cast("int").alias("at"))
    got = {r.at: r.density for r in L.density(p, "k", "v", g, "at").collect()}
    assert got[0] == pytest.approx((1 + 2.718281828 ** -0.5) / (2 * 2.5066282746), rel=1e-6) and sum(got.values()) == pytest.approx(1, abs=0.01)


def test_historical_places(spark):
    rows = [
        ("興安南省王爺廟", 1, 35.0, 135.0, "Kyoto", "ja"), ("興安南省", 2, 35.0, 135.0, "Jilin", "zh"), ("青島市", 3, 34.0, 131.0, None, None), ("蒙古聯合", 4, 1.0, 1.0, "Kyoto", "ja"), ("蒙古路", 5, 1.0, 1.0, "Kyoto", "ja"),
        ("安東", 6, 1.0, 1.0, "Kyoto", "ja"), ("東安東", 7, 1.0, 1.0, "Kyoto", "ja"), ("安東省城", 8, 1.0, 1.0, "Kyoto", "ja"), ("厚和", None, 1.0, 1.0, "Kyoto", "ja"), (None, 9, 1.0, 1.0, "Kyoto", "ja"), ("東大法科", 10, 1.0, 1.0, "Tokyo", "ja"), ("東大阪", 11, 1.0, 1.0, "Osaka", "ja"),
    ]
    df = spark.createDataFrame(rows, "name string, geonameid long, latitude double, longitude double, province string, country string")
    got = {r.name: (r.geonameid, r.latitude, r.province) for r in L.historical_locations(df).collect()}
    assert got["興安南省王爺廟"] == (None, 46.07, "Inner Mongolia") and got["興安南省"] == (2, 35.0, "Jilin") and got["青島市"] == (3, 34.0, None)
    assert got["蒙古聯合"] == (None, None, None) and got["蒙古路"][0] == 5 and got["安東"] == (None, None, None) and got["東安東"][0] == 7
    assert got["安東省城"] == (None, 40.12, "Liaoning") and got["厚和"] == (None, 1.0, "Kyoto") and got[None][0] == 9
    uni = {r.name: r.latitude for r in L.university_locations(df).collect()}
    assert uni["東大法科"] is None and uni["東大阪"] == 1.0 and uni[None] == 1.0


def test_branches_and_labels(spark):
    cities = spark.createDataFrame([("大阪", "L1"), ("京都", "L2"), ("東京", "L3")], "name string, location_id string")
    names = ["三井銀行大阪支店", "大阪", "大阪各支店", "大阪高商卒", "大阪同社", "東京長男", "京都帝大", None]
    orgs = spark.createDataFrame([(n, None) for n in names], "name string, loc string")
    assert {r.name: r.loc for r in L.assign_city(orgs, "name", "loc", cities).collect()} == dict(zip(names, ["L1", None, None, None, None, None, "L2", None]))
    assert L.assign_city(orgs.limit(0), "name", "loc", cities).count() == 0
    one = lambda o, x: spark.range(1).select(L.repaired_label(F.lit(o), F.lit(x)).alias("y")).first().y
    assert one("本縣農會", "Honken Agricultural Society") == "Prefectural Agricultural Society" and one("高女", None) == "Girls' High School" and one("神戸高女", "Takano Kobe") is None
    assert one("新京銀行", "Changchun Bank") == "Hsinking Bank" and one("新京極", "Shinkyo") == "Shinkyo" and one(None, "x") == "x" and one("銀行", None) is None
