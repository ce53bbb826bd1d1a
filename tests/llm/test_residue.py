import pytest

from meibo.llm.residue import EXEMPLARS, ResidueIndex, Weights, keep_clean, residue, residue_kinds

BIO = "He was born at Kamonejima in the spring of 1876. Telephone: Sagibuedera 404. The year of birth is given as {sic} 1981 in the register."
CASES = {
    "placeholder": ["He is employed by {{ORGANIZATION}} as merchant.", "趣味は${hobby}なり。", "位階は【生年未入力】に記す。", "born at [insert origin place here] in 1880", "<RANK> since 1900", "（ここに氏名を記入）は", "TBD (family name) resigned", "__氏名__に生る", "電話は%(phone)s番", "XXX school XXX", "born in {{clan_crest}} since 1900", "{{" + "birth place " * 30 + "}}"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Your text here.", "ここに略歴が入ります。", "テスト投稿テスト投稿ダミーテキストです。", "本文サンプル。", "asdf asdf qwer zxcv Lorem dolor sit amet magna aliq."],
    "error": ["Status code 404. The requested page could not be found", "502 | Bad Gateway", "エラー 503：ただいまメンテナンス中です。", "伺服器發生錯誤，請稍後再試", "Error establishing a connection to the database", BIO + "\n500 Internal Server Error\nRequest id: 8f09c293"],
    "notice": ["You need to enable JavaScript to continue.", "このページの表示にはJavaScriptが必要です。", "자바스크립트를 활성화해 주세요.", "Please enable JS, then reload the page."],
    None: [BIO, "Page 404 of the directory is not found in the surviving copy, so the entry breaks off here.", "其の生年は[原文ママ]明治二十年とあり。", "位階は{上段}に記す。", "The ministry asked him to enable the peasants to continue the survey.", "某年〇〇部隊に屬し出征す。", "The place name is [illegible] in the original.", "In the play he spoke the lines from a script written by his pupil.", "用紙に氏名を記入せしむるの法を案出せり。", "", "   ", None, "一時業務を停止し、整理の後再び開く。", "The rank [junior sixth] was conferred in 1909.", "The formula f(x) = $x$ was published", "He wrote __emphasis__ in the margin", "See [[Wikipedia article]] on the subject", "&lt;cheap&gt; goods were sold", "<<the master>> taught him", "■商店■を營む"],
}


@pytest.fixture(scope="module")
def docs(spark):
    rows, i = [], 0
    for kind, texts in CASES.items():
        for t in texts:
            rows.append((i, t, kind, "x"))
            i += 1
    rows += [(1000 + k, BIO + f" He resigned in {1900 + k} and opened a shop of his own; the page, the server and the script of the text were read by a browser of books.", None, "x") for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, want string, kinds string")


def test_each_case_is_told(docs):
    want = {r.doc_id: r.want for r in docs.collect()}
    got = {r.doc_id: list(r.kinds) for r in residue(docs).collect()}
    assert {i for i, k in want.items() if k} == set(got)
    assert all(want[i] in k for i, k in got.items())
    kept = keep_clean(docs, residue(docs))
    assert kept.count() == sum(k is None for k in want.values())


def test_very_long_and_repeated_texts(spark):
    rows = [(1, BIO * 3000 + "\n404 Not Found"), (1, BIO * 3000 + "\n404 Not Found"), (2, "あ" * 200_000), (3, "x" * 200_000)]
    got = [r.doc_id for r in residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got.count(1) == 1 and 3 not in got
    assert residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert len(ResidueIndex().vocabulary()) < 5000


def test_an_exemplar_is_found_by_the_others():
    """Leave-one-out: each sentence of residue is looked up without itself."""
    found = n = 0
    for kind, texts in EXEMPLARS.items():
        if kind == "placeholder":
            continue
        for t in texts:
            others = {k: [x for x in v if x != t] for k, v in EXEMPLARS.items()}
            n += 1
            found += bool(residue_kinds(t, Weights(ResidueIndex(others), {}, 10_000)))
    assert found >= 0.6 * n
