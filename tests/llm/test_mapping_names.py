import pytest

from meibo.llm.mapping import map_values, value_forms
from meibo.llm.names import SIMILAR, english_core, given_name, japanese_core, meeting_cores, name_groups, name_links, organisation_groups, relative_groups, soft_similarity, soft_words, surprise, turned_core

TERMS = [
    ("job_title_en", 1, "section chief", "section chief", "課長", None), ("job_title_en", 2, "engineer", "engineer", "技師", None), ("job_title_en", 3, "public prosecutor", "public prosecutor", "檢事", None), ("job_title_en", 4, "bank governor", "bank governor", "頭取", None), ("job_title_en", 5, "judge", "judge", "判事", None),
    ("hobby", 11, "碁", "go", "碁", "イゴ"), ("hobby", 12, "讀書", "reading", "讀書", "ドクショ"), ("hobby", 13, "弓術", "archery", "弓術", "キュウジュツ"), ("hobby", 14, "尺八", "bamboo flute", "尺八", "シャクハチ"), ("hobby", 15, "音樂", "music", "音樂", "オンガク"),
    ("relation", 21, "長男", "eldest son", "長男", "ちやうなん"), ("relation", 22, "弟", "younger brother", "弟", "おとうと"), ("relation", 23, "二女", "second daughter", "二女", "じぢよ"), ("relation", 24, "妻", "wife", "妻", "つま"),
]
WANT = {
    "job_title_en": {"section chief": 1, "Chief, Section": 1, "the SECTIONCHIEF (acting)": 1, "sect. chief, ret'd": 1, "sectin chief": 1, "eng1neer": 2, "ENGR.": 2, "Prosecutor / public": 3, "former bank gov'r in Kirisaka": 4, "juoge": 5, "jugde (1905)": 5, "comb stringer": 0, "Sect. Chiefs": 1, "fan restringer": 0, "see above": 0, "": 0, "   ": 0, "?": 0, "x" * 5000: 0},
    "hobby": {"碁": 11, "囲碁（初段）": 11, "GO": 11, "いご": 11, "読　書": 12, "ﾄﾞｸｼｮ": 12, "reaading": 12, "讀書等": 12, "弓道": 13, "尺八吹奏 三年": 14, "尺八 二年": 14, "趣味は音楽": 15, "蟲の音比べ": 0, "石集め": 0, "none": 0},
    "relation": {"故長男": 21, "先代光彦の長男": 21, "ELDEST-SON": 21, "實弟": 22, "門弟": 0, "2女": 23, "第二女": 23, "second daghter": 23, "妻殿": 24, "[妻]": 24, "つま": 24, "友人": 0},
}


def test_values_find_their_entries(spark):
    rows = [(f, v, "x") for f, m in WANT.items() for v in m] * 2 + [("hobby", None, "x")]
    terms = spark.createDataFrame([(*t, "x") for t in TERMS], "field_name string, term_id long, term string, term_en string, term_ja string, reading string, form string")
    got = {(r.field_name, r.raw_value): r.term_id for r in map_values(spark.createDataFrame(rows, "field_name string, raw_value string, term_id string"), terms).collect()}
    assert got == {(f, v): t for f, m in WANT.items() for v, t in m.items()}
    none = map_values(spark.createDataFrame(rows[:3], "field_name string, raw_value string, x string"), terms.limit(0)).collect()
    assert {r.term_id for r in none} == {0}
    assert map_values(spark.createDataFrame([], "field_name string, raw_value string"), terms).count() == 0
    assert value_forms("job_title_en", "Chief, section")[0][1] == "sectionchief"


@pytest.mark.parametrize(("name", "core"), [("株式會社南樫戸水產", ("南樫戸水産", "")), ("(元)南 樫戸・水産（株）", ("南樫戸水産", "")), ("南樫戸水産合資會社第二工場", ("南樫戸水産", "第二工場")), ("南樫戸病院支店", ("南樫戸病院", "支店")), ("郵便局(鍵橋口)", ("鍵橋口郵便局", ""))])
def test_japanese_core(name, core):
    assert japanese_core(name) == core


def test_english_core():
    assert english_core("Trading, South Akane-todai Co., Ltd.") == english_core("SOUTH AKANETODAI TRADING K.K.") == ("south akanetodai trading", "")
    assert given_name("故ノブ子（龜）") == ("native", [(0, "ノブ子"), (1, "ノブ")])
    n = {"south": 400, "north": 400, "akanetodai": 2, "akanetdai": 1, "trading": 300, "tradnig": 1}
    soft = lambda a, b: soft_words(a.split(), [n[x] for x in a.split()], b.split(), [n[x] for x in b.split()], 5000)
    assert soft("south akanetodai trading", "south akanetdai trading") > 0.88 > soft("south akanetodai trading", "north akanetodai trading")
    assert soft("akanetodai trading", "south akanetodai trading") < 0.88 and soft_words([], [], [], [], 10) == 1.0


PLACES = "山田 三菱 大阪 中島 高森 白浜 富岡 清水 松本 石垣 長野 福井 古川 新橋 桜井 竹内 今村 小倉 野村 平塚".split()
KINDS = "洋服店 銀行 造船 高等女学校 税務署 製糸 水産 呉服店 鉄道 人形座".split()


def corpus(n: int = 150) -> list[tuple[str, str | None, str | None]]:
    """Ids of several spellings: every place with every kind, as full, and some abbreviated or misread."""
    rows = [(f"O{i}", p + k, None) for i, (p, k) in enumerate((p, k) for p in PLACES for k in KINDS)]
    rows += [(f"O{1000 + i}", "株式會社" + p + k, None) for i, (p, k) in enumerate((p, k) for p in PLACES for k in KINDS)]
    odd = ["銀" * 4000, "行" * 4000, "山田洋服", "三菱造舩", "大坂銀行", "中島税", "白浜高女", "人形座・富岡", "石垣水産（株）", "(元)長野鉄道", "福井税務署支店", "福井税務署(株)支店", "山田呉服", "", "  ", None, "x" * 3000]
    return rows + [(f"O{2000 + i}", name, None) for i, name in enumerate(odd)]


def test_organisations_link_by_what_a_character_tells(spark):
    df = spark.createDataFrame([(*r, "x") for r in corpus()], "organization_id string, name string, name_en string, core string")
    names = {r[0]: r[1] for r in corpus()}
    groups = {}
    for r in organisation_groups(df).collect():
        groups.setdefault(r["group"], set()).add(names[r.organization_id])
    found = {n: g for g in groups.values() for n in g}
    want = {"山田洋服": "山田洋服店", "三菱造舩": "三菱造船", "大坂銀行": "大阪銀行", "中島税": "中島税務署", "白浜高女": "白浜高等女学校", "人形座・富岡": "富岡人形座", "石垣水産（株）": "石垣水産", "(元)長野鉄道": "長野鉄道", "福井税務署支店": "福井税務署(株)支店"}
    assert {k: found.get(k) is not None and v in found[k] for k, v in want.items()} == dict.fromkeys(want, True)
    assert "福井税務署" not in found["福井税務署支店"] and len({id(found[p + k]) for p in PLACES for k in KINDS}) == len(PLACES) * len(KINDS)


def test_prefix_join_against_brute_force(spark):
    rows = {japanese_core(n)[0]: turned_core(n) for _, n, _ in corpus() if n and n.strip() and len(n) < 100}
    cores = sorted(rows)
    df = spark.createDataFrame([(c, c, "", rows[c]) for c in cores], "cls string, core string, branch string, turned string")
    bits = {r.cls: (list(r.fwd), list(r.bwd)) for r in surprise(df).collect()}
    assert all(len(f) == len(b) == len(c) for c, (f, b) in bits.items())
    alike = {(a, b) for i, a in enumerate(cores) for b in cores[i + 1 :] if soft_similarity(a, *bits[a], b, *bits[b]) >= SIMILAR}
    met = {tuple(sorted((r.id_l, r.id_r))) for r in meeting_cores(df).collect()}
    assert alike and len(alike & met) >= 0.9 * len(alike)


def test_organisations_link_by_spelling_and_translation(spark):
    rows = [
        ("O1", "株式會社南樫戸水産", "South Kashito Fisheries Co., Ltd."), ("O2", "南樫戸水產㈱", None), ("O3", "SOUTH KASHITO FISHERIES COMPANY", None), ("O4", "南樫戸水産株式會社支店", None), ("O5", "南樫尾水産", "South Kashio Fisheries"),
        ("O6", "南樫戸製糖", None), ("O7", None, None), ("O8", "", ""), ("O2", "南樫戸水產㈱", None), ("O11", "南樫戸水産（株）支店", None), (None, "南樫戸水産", None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "organization_id string, name string, name_en string, core string")
    groups = {}
    for r in organisation_groups(df).collect():
        groups.setdefault(r["group"], set()).add(r.organization_id)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset({"O1", "O2", "O3"}), frozenset({"O4", "O11"})}
    assert {x for g in groups.values() for x in g} == {"O1", "O2", "O3", "O4", "O5", "O6", "O11"}
    assert organisation_groups(df.limit(0)).count() == 0


def test_relatives_link_by_reading(spark):
    rows = [
        (1, "P1", "ノブ", "Nobu"), (2, "P1", "おノブ", None), (3, "P1", "のぶ子", None), (4, "P1", "ﾉﾌﾞ", None), (5, "P1", "上谷 ノブ", None), (6, "P1", "忠平", "Tadahei"), (7, "P1", "TADAHEI", None), (8, "P1", "患乎", None), (9, "P1", "忠雄", "Tadao"), (10, "P1", None, "Nobu"), (11, "P1", "", None),
        (12, "P2", "ノブ", None), (13, "P2", "ノブ", None), (14, None, "ノブ", None), (15, "P2", "曾乃子", "Sono"), (16, "P2", "ソノ", "Sono"), (17, "P3", "x" * 3000, None),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "member_id long, person_id string, name string, name_latin string, k string, block string")
    groups = {}
    for r in relative_groups(df).collect():
        groups.setdefault((r.person_id, r["group"]), set()).add(r.member_id)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset({1, 2, 3, 4, 5}), frozenset({6, 7, 8}), frozenset({12, 13}), frozenset({15, 16})}
    orgs = spark.createDataFrame([], "organization_id string, name string, name_en string")
    pairs = {(r.key_a, r.key_b) for r in name_links(orgs, df).collect()}
    assert ("12", "13") in pairs and ("6", "7") in pairs and len(pairs) == 10 + 3 + 1 + 1
    assert relative_groups(df.limit(0)).count() == 0
    whole = {(r.kind, r.key): r["group"] for r in name_groups(orgs, df).collect()}
    assert whole["relative", "1"] == whole["relative", "3"] != whole["relative", "6"] and len(whole) == 14


def test_a_rare_misspelling_of_a_common_reading_links(spark):
    rows = [(i, f"P{i}", "SADAO", None) for i in range(60)] + [(100, "P1", "SADOA", None), (101, "P2", "SADAKO", None), (102, "P3", "SA", None)]
    df = spark.createDataFrame(rows, "member_id long, person_id string, name string, name_latin string")
    groups = {}
    for r in relative_groups(df).collect():
        groups.setdefault((r.person_id, r["group"]), []).append((r.member_id, r.n_links))
    assert {tuple(sorted(g)) for g in groups.values() if len(g) > 1} >= {((1, 1), (100, 1))} and [(3, 0)] in groups.values()
