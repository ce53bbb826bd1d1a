"""Free-entered values to a canonical list.

Every distinct value gives a few reading forms (cleaned, abbreviations written out, turned word order,
kana, the kinship word at its end ...), the list gives its spellings; both are sets of q-grams.  A prefix-filtered
set-similarity join finds each form's spellings, the Jaccard similarity is verified exactly, and the most
similar one is kept if it passes an exact check of edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meibo.functions.text import fold, is_kana, osa_distance, to_hiragana
from meibo.operators.setsim import qgrams, similar_sets
from meibo.session import materialize, spread

THRESHOLD = 0.3
LATIN, KANA, KANJI = "latin", "kana", "kanji"

# Abbreviations in titles.
ABBREVIATIONS = {
    k: v
    for k, v in (
        x.split("=")
        for x in (
            "adm=administrative admin=administrative adv=advisory agt=agent assoc=associate asst=assistant assn=association atty=attorney aud=auditor bd=board bk=bank bkpr=bookkeeper "
            "br=branch bldg=building bur=bureau capt=captain cdr=commander cmdr=commander comdr=commander chmn=chairman chm=chairman co=company coop=cooperative comm=commodity const=constable cnsl=counsel counc=council dept=department "
            "dep=deputy dir=director dr=doctor ed=editor eng=engineer engr=engineer exec=executive fact=factory fact'y=factory fwdr=forwarder gen=general genl=general gov=governor govr=governor hd=head insp=inspector "
            "jr=junior jnr=junior jun=junior lib=librarian lieut=lieutenant lt=lieutenant mbr=member mem=member mcht=merchant merch=merchant mgr=manager mng=managing mg=managing mngr=manager mktg=marketing msgr=messenger mess=messenger nav=naval "
            "off=officer ofc=office ofcr=officer offr=officer parl=parliament pharm=pharmacist phys=physician pref=prefectural pres=president prin=principal princ=principal prof=professor prop=proprietor pros=prosecutor pub=public rep=reporter reptr=reporter rptr=reporter "
            "sch=school schl=school sec=secretary secy=secretary sect=section sen=senior snr=senior sr=senior stat=statutory stn=station supt=superintendent supdt=superintendent surv=surveyor tech=technician techn=technician tchr=teacher treas=treasurer vet=veterinarian vill=village v=vice"
        ).split()
    )
}
# Other names of pastimes and relations on the list.
ALIASES = {
    "hobby": "囲碁=碁 弓道=弓術 魚釣=釣魚 魚釣り=釣魚 釣り=釣魚 釣=釣魚 活花=生花 華道=生花 茶の湯=茶道 山登り=登山 麻将=麻雀 水泳ぎ=水泳 映畫鑑賞=映画 骨董品=骨董 玉突き=玉突 撞球=玉突 テニス=庭球 硬式庭球=庭球 軟式庭球=庭球 乗馬術=乘馬 剣術=劍道 写真術=寫眞 浄瑠璃=義太夫 端艇=漕艇 ボート=漕艇 散策=散歩 盆栽いじり=盆栽 盆栽いぢり=盆栽 刀剣=刀劍鑑賞 サイクリング=自轉車 芝居=演劇 観劇=演劇 謡=謠曲 登攀=登山",
    "relation": "次男=二男 次女=二女 一男=長男 一女=長女 嫡男=長男 姊=姉 養嗣子=養子 飬子=養子 飬女=養女 飬父=養父 飬母=養母 從兄弟=從兄 従弟=從兄 娘壻=娘婿 女婿=娘婿 婿=娘婿 袓父=祖父 袓母=祖母 伯父=叔父 伯母=叔母 妻女=妻 夫人=妻 細君=妻 夫君=夫 父親=父 母親=母 嫡子=長男 孫娘=孫女",
}
# Endings after which a pastime is another one.
_OTHER_ACTIVITY = ("集め", "蒐集", "収集", "研究", "作り", "占ひ", "占い", "飼育", "磨き", "観察", "彫り", "比べ", "聴き", "造り", "拾ひ", "育て")
_BEFORE_TITLE = re.compile(r"^(?:the|an?|acting|former(?:ly)?|ex|late|now|sometime|then|retired|current(?:ly)?|deputy acting|hon(?:orary)?)[\s.\-]+", re.I)
_AFTER_TITLE = re.compile(r"(?:[\s,]+(?:ret'?d|retired|acting|emeritus|esq)\.?|\s*[(\[][^)\]]*[)\]]|\s+(?:in|at|of)\s+[A-Z][\w-]*)$")
_DIGIT = str.maketrans({"0": "o", "1": "i", "5": "s", "9": "g", "8": "b", "6": "b", "3": "e", "4": "a", "7": "t", "|": "l"})
_EMPTY = {"none", "nil", "unknown", "null", "na", "seeabove", "illegible", "blank", "ditto", "same", "various"}
_HONOUR = re.compile(r"(?:殿|君|様|氏|さん)$")
_GONE = re.compile(r"[(（\[［【]?故人[)）\]］】]?$")
_MODIFIER = re.compile(r"^(?:其ノ|其の|その|同|亡|故|実|義|御|元|先|右|又|第|前|継|庶|私生|先代|養父|実父)*$")
_NUMERAL = str.maketrans({"参": "三", "弐": "二", "伍": "五", "壱": "一", "肆": "四", "1": "一", "2": "二", "3": "三", "4": "四", "5": "五", "长": "長", "飬": "養", "袓": "祖", "姊": "姉", "壻": "婿", "児": "男"})


def _letters(s: str) -> str:
    return re.sub(r"[^a-z]", "", s)


def _written_out(word: str) -> str:
    """An abbreviation, also one in the plural, as its word; any other word as it is."""
    return _letters(ABBREVIATIONS.get(word) or (ABBREVIATIONS.get(word[:-1]) if word.endswith("s") and len(word) > 2 else None) or word)


def _latin_forms(text: str) -> list[str]:
    """Letter-only forms of an English value: as written, abbreviations written out, parts turned round."""
    t = text.strip().strip("\"'`“”‘’ .;:、。").strip()
    for _ in range(4):
        cut = _AFTER_TITLE.sub("", t).strip(" .,;\"'")
        cut = _BEFORE_TITLE.sub("", cut).strip(" .,;\"'")
        if cut == t or not cut:
            break
        t = cut
    out = []
    parts = [p for p in re.split(r"\s*[,/]\s*|\s+-\s+", t) if p]
    orders = [t] if len(parts) < 2 else [" ".join(parts[1:] + parts[:1]), t]
    for o in orders:
        words = [w for w in re.split(r"[\s_\-./,]+", o.lower().replace("’", "'").replace("`", "'")) if w]
        fixed = [w.translate(_DIGIT) if re.search(r"[a-z]", w) else w for w in words]
        plain = "".join(_letters(w) for w in fixed)
        full = "".join(_written_out(_letters(w)) for w in fixed)
        out += [full, plain]
        if any("1" in w for w in words):
            other = [w.replace("1", "l").translate(_DIGIT) if re.search(r"[a-z]", w) else w for w in words]
            out.append("".join(_letters(w) for w in other))
    more = [f[:-1] for f in out if len(f) > 4 and f.endswith("s")]
    return [f for f in dict.fromkeys(out + more) if f and f not in _EMPTY]


def _hobby_forms(t: str) -> list[str]:
    t = re.sub(r"^趣味(?:は|ハ)", "", t)
    t = re.sub(r"[(（][^)）]*[)）]$", "", t) or t.strip("()（）")
    t = re.sub(r"[初一二三四五六七八九十](?:年|段|級)$", "", t)
    t = t.strip("、。・()（）[]「」").removesuffix("等").removesuffix("など")
    out = [t]
    for n in range(len(t) - 1, 1, -1):
        if not t[n:].startswith(_OTHER_ACTIVITY) and not t.endswith(_OTHER_ACTIVITY):
            out.append(t[:n])
    return out


def _relation_forms(t: str) -> list[str]:
    t = t.strip("、。・,.()（）[]［］「」【】?？")
    t = _GONE.sub("", t).strip("()（）[]").translate(_NUMERAL)
    t = _HONOUR.sub("", t) or t
    out = [t]
    for n in range(min(len(t) - 1, 4), 0, -1):
        head, tail = t[:-n], t[-n:]
        if n >= 2 or _MODIFIER.fullmatch(head) or head.endswith(("の", "ノ")):
            out.append(tail)
    return out


def value_forms(field: str, value: str) -> list[tuple[str, str, int]]:
    """(script, form, rank): the forms under which a value is looked up; a lower rank is nearer to what was written."""
    text = fold(value)
    if re.search(r"[A-Za-z]", text) and not re.search(r"[぀-ヿ㐀-鿿]", text):
        return [(LATIN, f, k) for k, f in enumerate(_latin_forms(text))]
    t = re.sub(r"\s+", "", text)
    forms = _relation_forms(t) if field == "relation" else _hobby_forms(t)
    out = []
    for k, f in enumerate(forms):
        if not f:
            continue
        if is_kana(f):
            out.append((KANA, to_hiragana(f), k))
        else:
            out.append((KANJI, f, k))
    return list(dict.fromkeys(out))


def spellings(field: str, term: str | None, term_en: str | None, term_ja: str | None, reading: str | None) -> list[tuple[str, str]]:
    """(script, spelling) of a canonical entry, without its other names."""
    out = []
    for s in (term, term_en, term_ja):
        if s:
            text = fold(s)
            if re.fullmatch(r"[\x00-\x7f]+", text):
                out.append((LATIN, _letters(text.lower())))
            elif is_kana(re.sub(r"\s", "", text)):
                out.append((KANA, to_hiragana(re.sub(r"\s", "", text))))
            else:
                out.append((KANJI, re.sub(r"\s", "", text)))
    if reading:
        out.append((KANA, to_hiragana(re.sub(r"\s", "", fold(reading)))))
    return list(dict.fromkeys(x for x in out if x[1]))


def _canonical_forms(terms: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(field_name, term_id, script, form, weak): every spelling and other name of the list's entries."""
    other = {f: [tuple(x.split("=")) for x in text.split()] for f, text in aliases.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                own = spellings(r.field_name, r.term, r.term_en, r.term_ja, r.reading)
                rows += [(r.field_name, r.term_id, s, f, 0) for s, f in own]
                names = {f for _, f in own}
                for alias, target in other.get(r.field_name, ()):
                    if fold(target) in names:
                        a = fold(alias)
                        rows.append((r.field_name, r.term_id, KANA if is_kana(a) else KANJI, to_hiragana(a) if is_kana(a) else a, 1))
            yield pd.DataFrame(rows, columns=["field_name", "term_id", "script", "form", "weak"])

    return terms.select("field_name", F.col("term_id").cast("bigint").alias("term_id"), "term", "term_en", "term_ja", "reading").mapInPandas(run, "field_name string, term_id bigint, script string, form string, weak int")


def edits_allowed(length: int) -> int:
    """How many edits two English forms of this length may lie apart: none to three letters, then one, two from eight, three from fifteen."""
    return (length > 3) + (length > 7) + (length > 14)


def map_values(values: DataFrame, terms: DataFrame, threshold: float = THRESHOLD, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(field_name, raw_value, term_id): each distinct non-null value with its entry, 0 if none is near.

    ``values`` has field_name and raw_value; repeated rows fold into one.  An empty or blank value is
    unmatched.  The most similar spelling wins; ties go to the nearer form, the list's own spelling, the smaller term_id.  An
    empty list leaves every value unmatched.
    """
    values = values.select("field_name", "raw_value").where(F.col("raw_value").isNotNull()).distinct()

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, v, s, x, k) for f, v in zip(pdf["field_name"], pdf["raw_value"]) for s, x, k in value_forms(f, v) or [(None, None, 0)]]
            yield pd.DataFrame(rows, columns=["field_name", "raw_value", "script", "form", "rank"])

    # a value without a form keeps a row: the table holds every value, and the large tables are read once
    each = materialize(spread(values, "raw_value").mapInPandas(forms, "field_name string, raw_value string, script string, form string, rank int"), "value-forms")
    listed = materialize(_canonical_forms(terms, aliases), "list-forms")
    mark = F.concat_ws("/", "field_name", "script")
    key = F.concat_ws("/", "field_name", "script", "form")
    sets = lambda df: df.where("form is not null").select(key.alias("id"), mark.alias("mark"), "form").distinct().withColumn("tokens", qgrams("form", 2))
    pairs = similar_sets(sets(each), sets(listed), threshold, mark="mark")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["id_l"], pdf["id_r"]):
                script, x, y = a.split("/", 2)[1], a.split("/", 2)[2], b.split("/", 2)[2]
                limit = edits_allowed(max(len(x), len(y))) if script == LATIN else 0
                keep.append(x == y or limit > 0 and osa_distance(x, y, limit) <= limit)
            yield pdf.loc[keep]

    near = pairs.mapInPandas(check, "id_l string, id_r string, jaccard double")
    targets = listed.select(key.alias("id_r"), "term_id", "weak").groupBy("id_r", "term_id").agg(F.min("weak").alias("weak"))
    scored = each.withColumn("id_l", key).join(near, "id_l").join(targets, "id_r")
    best = scored.groupBy("field_name", "raw_value").agg(F.min_by("term_id", F.struct((-F.col("jaccard")).alias("j"), (F.col("script") != LATIN).alias("s"), "rank", "weak", "term_id")).alias("term_id"))
    every = each.select("field_name", "raw_value").distinct()
    return every.join(best, ["field_name", "raw_value"], "left").select("field_name", "raw_value", F.coalesce("term_id", F.lit(0).cast("bigint")).alias("term_id"))
