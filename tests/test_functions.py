import difflib

import pytest
from pyspark.sql import functions as F

from meibo.functions import classify as C
from meibo.functions import era as E
from meibo.functions import similarity as S
from meibo.functions import text as X


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "year"), [("明治三十三年", 1900), ("明治三三年", 1870), ("昭三〇", None), ("大正元年", 1912), ("慶應元年", 1865), ("光緒廿一年", 1895), ("同十二年", None), ("", None), (None, None), ("大正12年", 1923)])
def test_era_years(spark, raw, year):
    assert one(spark, raw, E.western_year) == year


def test_positional_numerals(spark):
    assert one(spark, "三三", E.kanji_number) == 3 and one(spark, "三三", lambda c: E.kanji_number(c, True)) == 33
    assert one(spark, "百二十", E.kanji_number) == 120 and one(spark, "三x", E.kanji_number) is None


@pytest.mark.parametrize(("value", "fn", "want"), [
    ("養父先代定吉三女", X.kinship_of, "三女"), ("養父x", X.kinship_of, "養父"), ("ab", X.kinship_of, "ab"), ("高木金之助三女", X.null_kinship_name, None), ("電2801", X.clean_phone, "2801"), ("12", X.clean_phone, None), ("123456", X.clean_phone, None),
    ("x", X.clean_org, None), ("あ" * 16, X.clean_org, None), ("花子長女太郎", X.strip_kinship, "花子"), ("山田(A) 太郎・", X.clean_name, "山田太郎"), ("山", X.clean_name, None), ("Osaka Ouji ou oui", X.long_vowels, "Osaka Ōji ō oui"), ("a_b_c", lambda c: X.split_last(c)["tail"], "c"),
    ("滿州國", X.place_from_org, "滿州"), ("p0067", X.page_number, 67), ("東京市幸町", lambda c: F.size(X.prefixes(c)), 4), ("東京府東京市京橋區銀座町", lambda c: F.array_join(X.admin_levels(c), "/"), "東京府/東京市/京橋區/銀座町"), ("x", lambda c: X.suffix_title(F.lit("長"), F.lit("財務局")), "局長"),
])
def test_text(spark, value, fn, want):
    assert one(spark, value, fn) == want


def test_repeated_entry_cut(spark):
    body = "あ" * 1950 + "家庭" + "い" * 60 + "從五位" + "う" * 10
    assert one(spark, body, X.repeated_entry_cut) == body[: body.index("從五位")] and one(spark, "家庭從五位", X.repeated_entry_cut) == "家庭從五位"


def test_jaro():
    assert S.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert S.jaro("ABCDEFGH", "BCADEFGH") == pytest.approx(0.9375) and S.jaro("ABCDEFGH", "BCADEFGH", floor=True) == pytest.approx(0.9583, abs=1e-4)
    assert S.jaro_winkler("ABCXYZQW", "ABCPLMNO") == pytest.approx(0.7083, abs=1e-4) and S.jaro_winkler("ABCXYZQW", "ABCPLMNO", boost_above=0.7) == pytest.approx(0.5833, abs=1e-4)
    assert S.jaro("", "a") == 0 and S.ratio("abcd", "bcde") == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()
    assert S.character_scores("abc", "abd")[2] == pytest.approx(2 / 3)


def test_classification(spark):
    assert one(spark, "妻", C.relative_gender) == "f" and one(spark, None, C.relative_gender) == "x"
    assert one(spark, 1873, lambda c: C.family_birth_year(c, F.lit(1869), F.lit("母")), "int") is None and one(spark, 1871, lambda c: C.family_birth_year(c, F.lit(1869), F.lit("妻")), "int") == 1871
    assert one(spark, "長男", C.is_false_job) and not one(spark, "弟子", C.is_false_job) and not one(spark, None, C.is_false_job)
    assert one(spark, "同村", C.is_garbled_place) and one(spark, "明三", C.is_garbled_place) and not one(spark, "明石", C.is_garbled_place)
    assert one(spark, "東大法科卒", C.is_foreign_to_place) and not one(spark, "東大阪", C.is_foreign_to_place)
    assert one(spark, "王五", lambda c: C.domain_of(F.lit(None).cast("string"), c)) == "zh" and one(spark, "x", lambda c: C.domain_of(F.lit("京城府"), c)) == "ko"
    assert tuple(one(spark, "司馬光", lambda c: C.family_and_given(c, F.lit("zh")))) == ("司馬", "光")


def test_labels_follow_the_survey(spark):
    one = lambda *cols: spark.range(1).select(*cols).first()
    L = F.lit
    r = one(*[C.relation_order(L(x)).alias(f"r{k}") for k, x in enumerate(("養祖父", "叔父", "從兄", "次男", "五男長", "孫", None))])
    assert [tuple(x) for x in r] == [(0, 3, 6), (2, 3, 6), (6, 3, 6), (5, 2, 6), (5, 1, 5), (8, 3, 6), (9, 3, 6)]
    assert list(one(*[C.education_tier(L(x)).alias(f"t{k}") for k, x in enumerate(("東京帝國大學", "小學校", "大阪中學", "高等女學校", "x school", None, "Graduate School"))])) == [4, 1, 2, 3, 3, 3, 5]
    assert list(one(*[C.hisco_minor(L(x)).alias(f"h{k}") for k, x in enumerate(("4", "4.0", "04120", " 55 ", "", None, "x.y"))])) == ["04", "04", "04", "55", "", "", "x.y"]
    long = "a" * 51
    assert list(one(*[X.tidy_translation(L(x)).alias(f"x{k}") for k, x in enumerate(("o'neil  bank", "Tōkyō bank", long, "銀行"))])) == ["O'Neil Bank", "Tky bank", None, None]
    assert list(one(*[X.normalise_place(L(x)).alias(f"p{k}") for k, x in enumerate(("Tokyo (Prefecture)", "Kobe City", "Otoku-ken"))])) == ["Tokyo", "Kobe", "Otoku-ken"]
    assert one(X.strip_tones(L("ŌsakaǙÁé")))[0] == "OsakaÜAe"
    assert list(one(*[S.is_variant(L(a), L(b)).alias(f"v{k}") for k, (a, b) in enumerate((("太郎", "太朗"), ("太郎", "次郎"), ("太", "太郎"), ("一", "二")))])) == [True, False, True, False]
    assert C.in_regions(L("zh"), L("Jilin"), []) is not None and one(C.in_regions(L("zh"), L("Jilin"), ["mk", "ja"]), C.in_regions(L("zh"), L("Gansu"), ["mk"]))[0:2] == (True, False)


def test_broken_answers_are_completed_on_request():
    import json

    from meibo.functions.jsonfix import NOTHING, completed_answer, last_object, only_keys

    whole = {"name": "a", "career": [{"job": "x", "year": 1900}, {"job": "y"}], "n": [1, [2, 3]]}
    text = json.dumps(whole)
    for n in range(1, len(text) + 1):
        got = completed_answer("Answer: " + text[:n])
        assert isinstance(got, dict) and set(got) <= set(whole)
    assert completed_answer(text[: text.index('"y"')]) == {"name": "a", "career": [{"job": "x", "year": 1900}, {}]} and completed_answer(text) == whole
    assert completed_answer("none") is NOTHING and completed_answer("") is NOTHING and completed_answer(None) is NOTHING
    assert last_object('{"a": 1} no, rather {"a": 2} {"b') == {"a": 2} and last_object("x") is None
    assert only_keys({"a": 1, "b": 2}, frozenset("a")) == {"a": 1} and only_keys([1], frozenset()) == [1]


def test_pairs_are_verified_in_batches(spark, tmp_path):
    from meibo.operators.enrich import numbered_answers, verify_pairs, yes_no_provider

    assert numbered_answers("1. YES\n3. no\n9. YES\nx", 3) == ["YES", None, "no"] and numbered_answers(None, 1) == [None]

    def ask(prompt):
        if "boom" in prompt:
            raise RuntimeError
        return "\n".join(line.split(".")[0] + (". YES" if "same" in line else ". NO") for line in prompt.split("\n") if "skip" not in line)

    df = spark.createDataFrame([("a", "same", 1), ("a", "same", 2), ("b", "other", 3), ("skip", "same", 4), (None, "same", 5)], "x string, y string, i int")
    got = verify_pairs(df, "x", "y", yes_no_provider(ask), str(tmp_path / "cache"))
    assert sorted(r.i for r in got.collect()) == [1, 2, 5]
    again = verify_pairs(df, "x", "y", yes_no_provider(lambda p: "1. NO"), str(tmp_path / "cache"))
    assert sorted(r.i for r in again.collect()) == [1, 2, 5]
    assert verify_pairs(spark.createDataFrame([("boom", "same", 1)], "x string, y string, i int"), "x", "y", yes_no_provider(ask)).count() == 0
