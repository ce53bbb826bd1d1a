"""Conditional classifications as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of regions that tell a person's linguistic domain.
ZH_REGIONS = (
    "河北|山西|遼寧|吉林|黑龍江|黒龍江|江蘇|浙江|安徽|福建|江西|山東|河南|湖北|湖南|廣東|広東|廣西|広西|海南|四川|貴州|雲南|陝西|陕西|甘肅|青海|新疆|西藏|內蒙古|寧夏|"
    "直隸|直隷|直轄|奉天|熱河|察哈爾|綏遠|江南|蒙古|北京|天津|上海|重慶|南京|廣州|広州|蘇州|杭州|武漢|臺灣|台湾|滿洲|満洲|滿州|満州"
)
KO_REGIONS = "朝鮮|韓國|韓国|慶尚|全羅|忠清|平安|黃海|黄海|江原|咸鏡|京畿|京城|仁川|釜山|平壤|大邱|光州|大田"
# One-character surnames that are Chinese without doubt.
ZH_SURNAMES = (
    "王李張劉陳楊黃趙周吳徐孫馬朱胡郭何羅梁宋鄭謝韓唐馮于董蕭程曹袁鄧許傅沈曾彭呂蘇盧蔣蔡賈丁魏薛葉閻余潘杜戴夏鍾汪邱任姜范方陸鄒熊孟秦白江段雷侯龍史陶賀顧毛郝龔邵萬覃武錢嚴尹廖譚魯喬莊翁鄂岳齊沙柳奚紀賴甄"
)
COMPOUND_SURNAMES = "歐陽 司馬 上官 諸葛 公孫 令狐 夏侯 東方 尉遲 慕容 端木 皇甫 獨孤 長孫 司徒 軒轅".split()


def domain_of(origin: Column, name: Column) -> Column:
    """zh, ko, other or ja, by region of origin, then katakana, then a short Han name with a Chinese surname."""
    bare = F.regexp_replace(name, r"(?U)\s+", "")
    return (
        F.when(origin.rlike(ZH_REGIONS), "zh")
        .when(origin.rlike(KO_REGIONS), "ko")
        .when(bare.rlike("^[゠-ヿー]+$"), "other")
        .when(bare.rlike("^[一-鿿]{2,3}$") & bare.rlike(f"^[{ZH_SURNAMES}]"), "zh")
        .otherwise("ja")
    )


def family_and_given(name: Column, domain: Column) -> Column:
    """(family, given): two characters are cut 1+1, Chinese compound surnames 2+rest, all others 1+rest."""
    two = (domain == "zh") & F.substring(name, 1, 2).isin(*COMPOUND_SURNAMES) & (F.length(name) > 2)
    n = F.when(two, 2).otherwise(1)
    ok = F.length(name) > 1
    return F.struct(F.when(ok, F.substring(name, F.lit(1), n)).alias("family"), F.when(ok, F.substring(name, n + 1, F.length(name))).alias("given"))


def relative_gender(relation: Column) -> Column:
    """m, f or x by the relation's words."""
    r = F.coalesce(relation, F.lit(""))
    return F.when(r.rlike("父|兄|弟|祖父|婿|男$"), "m").when(r.rlike("母|妻|姉|妹|祖母|女$"), "f").otherwise("x")


def subject_gender(has_wife: Column, has_husband: Column, has_rank: Column, womens_school: Column, prior: Column) -> Column:
    """m, f or x: spouses decide, then a rank, then a girls' school, then a male first name."""
    return (
        F.when(has_wife & ~has_husband, "m").when(has_husband & ~has_wife, "f").when(has_rank, "m").when(womens_school, "f").when(prior == "m", "m").otherwise("x")
    )


def family_birth_year(year: Column, subject: Column, relation: Column, gap: int = 15, spouse_gap: int = 15) -> Column:
    """A relative's birth year, null where it contradicts the subject's: parents older, children younger, spouses near."""
    known = year.isNotNull() & subject.isNotNull() & (F.coalesce(relation, F.lit("")) != "")
    bad = (
        (relation.rlike("[父母]") & (year > subject - gap))
        | (relation.rlike("[女男子]") & (year < subject + gap))
        | (relation.rlike("妻") & (F.abs(year - subject) > spouse_gap))
    )
    return F.when(~(known & bad), year)


# Fixed values: (display order, pattern) of relations; the first that fits counts, nothing fits 9.
RELATION_ORDERS = [
    (0, "祖先|先祖|遠祖|元祖|高祖|玄祖|曾祖|祖父|祖母|先代|先々"),
    (0, "^祖$"),
    (2, "伯父|伯母|叔父|叔母|舅|姑父|姑母|姑"),
    (1, "父|母"),
    (4, "妻|夫$|夫人|夫君|婿|嫁"),
    (6, "従兄|従弟|従姉|従妹|從兄|從弟|從姉|從妹"),
    (3, "兄|姉|弟|妹"),
    (5, "子|男|女|嗣|娘"),
    (7, "甥|姪"),
    (8, "孫|曾孫|玄孫"),
]
# Fixed values: (tier, pattern, pattern that excludes it) of schools by name; nothing fits 3.
EDUCATION_TIERS = [
    (1, "小学|小學|尋常|Elementary School|Primary School", None),
    (2, "中学|中學|中等|Middle School", "大学|大學"),
    (3, "高等学校|高等學校|高校|高等女|師範|予科|予備|High School|Normal School|Preparatory", "大学|大學"),
    (4, "大学|大學|専門|專門|College|University", None),
    (5, "大学院|研究科|Graduate", None),
]
# Picker category of a religion by what it belongs to and its school.
RELIGION_CATEGORIES = [
    ("Buddhism", "Pure Land", "pureland"), ("Buddhism", "Zen", "zen"), ("Buddhism", "Nichiren", "nichiren"), ("Buddhism", None, "buddhism"),
    ("Shintō", None, "shinto"), ("Christianity", None, "christianity"), ("Confucianism", None, "confucianism"), ("Tenrikyō", None, "tenrikyo"),
]
# Sections of economic activity and the short names shown for some.
ISIC_LABELS = {
    "A": "Agriculture, forestry and fishing", "B": "Mining and quarrying", "C": "Manufacturing", "D": "Electricity, gas, steam and air conditioning supply",
    "E": "Water supply; sewerage, waste management and remediation activities", "F": "Construction", "G": "Wholesale and retail trade; repair of motor vehicles and motorcycles",
    "H": "Transportation and storage", "I": "Accommodation and food service activities", "J": "Information and communication", "K": "Financial and insurance activities",
    "L": "Real estate activities", "M": "Professional, scientific and technical activities", "N": "Administrative and support service activities",
    "O": "Public administration and defence; compulsory social security", "P": "Education", "Q": "Human health and social work activities",
    "R": "Arts, entertainment and recreation", "S": "Other service activities", "T": "Activities of households as employers", "U": "Activities of extraterritorial organizations and bodies",
}
ISIC_SHORT = {
    "D": "Electricity, gas, steam and AC", "E": "Water and waste management", "G": "Wholesale and retail trade", "I": "Accommodation and food", "K": "Financial and insurance",
    "L": "Real estate", "M": "Professional, scientific, technical", "N": "Administrative and support", "O": "Public administration and defence", "Q": "Health and social work",
    "S": "Other services", "T": "Households as employers", "U": "Extraterritorial organizations",
}
# Major groups of occupations by first digit.
HISCO_MAJORS = {
    "0": "Professional/Technical", "1": "Professional/Technical", "2": "Administrative/Managerial", "3": "Clerical", "4": "Sales",
    "5": "Service", "6": "Agricultural/Forestry/Fishing", "7": "Production/Transport", "8": "Production/Transport", "9": "Production/Transport",
}
# Provinces of the derived region mk.
MK_PROVINCES = ("Heilongjiang", "Jilin", "Liaoning", "Jehol")


def _holds(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def relation_order(relation: Column) -> Column:
    """Display order of a relation, as (order, order2, order3): class, then 長 and 次, then the numeral; null has none of them."""
    out = F.lit(9)
    for k, pattern in reversed(RELATION_ORDERS):
        out = F.when(_holds(relation, pattern), k).otherwise(out)
    second = F.when(_holds(relation, "次"), 2).when(_holds(relation, "長"), 1).otherwise(3)
    third = F.lit(6)
    for k, numeral in enumerate("一二三四五", 1):
        third = F.when(_holds(relation, numeral), k).otherwise(third)
    return F.struct(out.alias("order1"), second.alias("order2"), third.alias("order3"))


def education_tier(name: Column) -> Column:
    """The tier of a school by its name, 1 (primary) to 5 (graduate); unknown and null names are in the middle."""
    out = F.lit(3)
    for tier, pattern, but in reversed(EDUCATION_TIERS):
        fits = _holds(name, f"(?i){pattern}")
        out = F.when(fits & ~_holds(name, but) if but else fits, tier).otherwise(out)
    return out


def religion_category(belongs_to: Column, school: Column) -> Column:
    """The category a religion is picked under; none for one that belongs to nothing."""
    out = F.lit("other")
    for whole, part, category in reversed(RELIGION_CATEGORIES):
        fits = belongs_to == whole
        out = F.when(fits & F.coalesce(school == part, F.lit(False)) if part else fits, category).otherwise(out)
    return F.when(belongs_to.isNotNull() & (belongs_to != ""), out)


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def isic_label(section: Column) -> Column:
    """The label shown for a section of economic activity: its short name if it has one."""
    return F.coalesce(_mapped(section, ISIC_SHORT), _mapped(section, ISIC_LABELS))


def hisco_minor(code: Column) -> Column:
    """An occupation code as typed, in its two-digit form: float endings cut, a lost zero set before, five digits shortened; other text stays."""
    s = F.trim(F.coalesce(code.cast("string"), F.lit("")))
    s = F.when(s.contains("."), F.coalesce(s.try_cast("double").cast("bigint").cast("string"), s)).otherwise(s)
    return F.when(s.rlike("^[0-9]+$"), F.substring(F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s), 1, 2)).otherwise(s)


def hisco_major_label(major: Column) -> Column:
    """The label of an occupation's major group."""
    return _mapped(major, HISCO_MAJORS)


def in_regions(country: Column, province: Column, chosen: list[str], mk: tuple[str, ...] = MK_PROVINCES) -> Column:
    """True for a place in one of the chosen countries, ``mk`` being the region made of four provinces; every choice at once is no restriction."""
    if set(chosen) == {"ja", "zh", "kr", "tw", "mk"} or not chosen:
        return F.lit(True)
    out = F.coalesce(country.isin(*[c for c in chosen if c != "mk"]), F.lit(False)) if set(chosen) - {"mk"} else F.lit(False)
    return out | F.coalesce(province.isin(*mk), F.lit(False)) if "mk" in chosen else out


def is_generic_org(name: Column) -> Column:
    """True for a short name of a government body that exists in many places."""
    return (F.length(name) <= 4) & name.rlike("[省部局院廳庁]$")


# Relation words, jobs that only look like relations, and era years, that tell false job titles.
RELATION_EXACT = (
    "前名 舊名 旧名 長男 二男 三男 四男 五男 六男 七男 八男 長女 二女 三女 四女 五女 六女 養子 養女 嫡男 嫡子 庶子 入夫 婿養子 養嗣子 嗣子 養妹 妻 夫 男 女 子 兄 弟 姉 妹 孫"
).split()
LEGITIMATE_JOBS = "弟子 徒弟 大夫 中大夫 農夫 人夫 樵夫 工夫 園子 菓子 高女 芸妓".split()
# References to a place named before, and endings that tell a school.
DEICTIC_PLACES = "本縣 本県 本府 本市 本郡 同縣 同県 同校 同府 同市 同町 同村 同郡 同地 同國 同国 同".split()
SCHOOL_ENDINGS = "高女卒 高女 女高師 女學 女学 高商 高工 高校 高等 大學 大学 中學 中学 小學 小学 師範 商業 工業 農業 卒".split()
ERA_SAFE_PLACES = "明石 明野 昭和 明治 天津 天理 天草 天城 天王 天竜 天神 天野 天沼 天長 天水 天山 天河 天田 天門 天香 天本".split()
RELATION_ENDINGS = "長男 二男 三男 四男 五男 六男 七男 八男 長女 二女 三女 四女 五女 六女 養子 養女 嫡男 嫡子 庶子 入夫 婿養子 養嗣子 嗣子 養妹 娘婿 後裔".split()
ORG_PLACE_ENDINGS = "領事館 鐵道 鉄道 中學 中学 造船部".split()
ORG_TOKENS = "株 製作所 工場 會社 会社 銀行 商店 合資 合名 事務所 本社 支社 出張所".split()


# A wife named by her husband and an era year, as job titles; what a short place is if it is a piece of a date; short names of universities and what makes them places.
JOB_PATTERNS = (r"^.{1,10}[の之]?妻$", r"^(?:昭和?|大正?|明治?)[一二三四五六七八九十〇\d]{1,4}年?$")
DATE_PLACES = (r"^[一二三四五六七八九十〇\d]{1,4}$", r"^[明大昭天][一二三四五六七八九十〇\d]{0,3}$")
SHORT_ERA = "^[明昭天]"
UNIVERSITIES = "東北大 東大 北大 京大 阪大 帝大 九大 名大 慶大 早大".split()
NOT_UNIVERSITIES = "阪曽曾崎久門海野浦杉"
POSSESSED = "[の之](?:妻|夫|男|女|子|兄|弟|姉|妹|孫)"


def is_false_job(title: Column) -> Column:
    """True for a job title that is a relation or an era year; null titles are not."""
    t = F.coalesce(title, F.lit(""))
    wrong = t.isin(*RELATION_EXACT) | t.rlike("|".join(JOB_PATTERNS))
    return wrong & ~t.isin(*LEGITIMATE_JOBS)


def is_garbled_place(place: Column) -> Column:
    """True for a place that is a reference, a bare number, a piece of an era date or a school."""
    p = F.coalesce(place, F.lit(""))
    short = (F.length(p) == 2) & p.rlike(SHORT_ERA) & ~p.isin(*ERA_SAFE_PLACES)
    return p.isin(*DEICTIC_PLACES) | p.rlike("|".join(DATE_PLACES)) | short | p.rlike("(?:" + "|".join(SCHOOL_ENDINGS) + ")$")


def is_university_name(name: Column) -> Column:
    """True for a name that begins with a university's short name and is no place of that beginning."""
    return name.rlike(f"^(?:{'|'.join(UNIVERSITIES)})(?![{NOT_UNIVERSITIES}])")


def is_foreign_to_place(place: Column) -> Column:
    """True for a place that ends in a relation, in an organisation, or begins with a university's short name."""
    uni = is_university_name(place)
    return place.rlike("(?:" + "|".join([*RELATION_ENDINGS, POSSESSED]) + ")$") | place.rlike("(?:" + "|".join(ORG_PLACE_ENDINGS) + ")$") | uni


def is_relation_org(name: Column) -> Column:
    """True for an organisation's name that is a relation."""
    return name.rlike("(?:" + "|".join(RELATION_ENDINGS) + ")$")


def is_org_place(name: Column) -> Column:
    """True for a location's name that holds words of organisations."""
    return name.rlike("|".join(ORG_TOKENS))
