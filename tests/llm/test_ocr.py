import pytest

from meibo.llm.ocr import header_name, latin_words, noise_found, printed_name, repaired, strip_marks, weighted_edits, word_repairs

HEAD = ["THEKIRIURADIRECTORYOFPERSONS", "東海蒼鳶紳士名鑑"]


@pytest.mark.parametrize(("text", "kinds"), [
    ("東海蒼鳶紳士名鑑\nあ", {"header"}), ("東海〓鳶紳士名鑑　ハ之部\nあ", {"header"}), ("58  T H E  K I R I U R A  D I R E C T O R Y  O F  P E R S O N S\nx", {"header", "pageno"}), ("x at  The Kiriura Directory Of Persons\ny", {"header"}),
    ("― 58 ―\nあ", {"pageno"}), ("あ。　五八頁", {"pageno"}), ("(58) After", {"pageno"}), ("in\n1915\nhe", set()), ("(59)\nx", set()), ("brewery at Kiriuramori.\nx", set()), ("", set()),
])
def test_marks(text, kinds):
    assert strip_marks(text, HEAD, 58)[1] == kinds


@pytest.mark.parametrize(("name", "kinds"), [("外口忠三郎", set()), ("Tomo0 Kanemura", {"char"}), ("63 若橋義太郎", {"pageno"}), ("Yoshikichi Kirihama63", {"pageno"}), ("若ロ重雄", {"char"}), ("片#正平", {"char"}), ("荒口重彦　六三", {"pageno"}), ("Naoji Tsukino", set()), ("キヨ", set()), ("東海蒼鳶紳士名鑑", {"header"}), ("丅口福彦(63)", {"char", "pageno"})])
def test_entry_headers(name, kinds):
    rest, met = header_name(name, HEAD, 63)
    assert met | ({"char"} if printed_name(rest).replace(" ", "") != rest.replace(" ", "").replace("　", "") else set()) == kinds


def test_edits_and_divided_words():
    assert weighted_edits("resporisible", "responsible")[1] and weighted_edits("emp1oyed", "employed")[1] and not weighted_edits("managed", "manager")[1]
    assert latin_words(["the lib-", "rary of a vice-", "president"])[1] == [("lib", "rary"), ("vice", "president")]


def segments(spark):
    good = ["He promoted printing among the villages and was employed by the library.", "His brother, the vice-president, was employed by the company of printing."]
    jp = "大正九年卒業し縣廳に勤務す。昭和三年會計課長に轉ず。"
    rows = [(i, "1927", f"p{67 + i % 9:04d}", good[i % 2], None, good[i % 2] + "\n") for i in range(200)] + [(500 + i, "1927", "p0067", jp, None, jp[:13] + "\n" + jp[13:]) for i in range(60)]
    rows += [(700 + i, "1927", f"p{67 + i:04d}", f"THE KIRIURA DIRECTORY OF PERSONS\n({58 + i})\n" + good[0], "Naoji Tsukino", None) for i in range(8)]
    rows += [
        (1, "1927", "p0067", "He was emp1oyed by the lib-\nrary of print=\ning.", "Tomo0 Tsukino", "(58)\nHis brother, the vice-\npresident, was employed by the company."),
        (2, "1927", "p0067", "大正九年率業し縣廳に勒務す。昭和三年曾計課長に轉ず。", "丅口福彦", None), (3, None, None, None, None, None), (4, "1927", "p0067", "", " ", "\n"), (1, "1927", "p0067", "same id again", None, None),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "segment_id long, volume string, source_page string, body_text string, header_ocr string, text_content string, headers string, page_shift int")


def test_noise_and_repair(spark):
    df = segments(spark)
    got = {(r.segment_id, r.text_field, r.noise_kind) for r in noise_found(df).collect()}
    few = {x for x in got if x[0] < 500}
    assert few == {(1, "body_text", "char"), (1, "body_text", "hyphen"), (1, "header_ocr", "char"), (1, "text_content", "pageno"), (2, "body_text", "char"), (2, "header_ocr", "char")}
    assert {x[2] for x in got if x[0] >= 700} == {"header", "pageno"}
    # some ids stand for several rows
    fixed = {(r.segment_id, r.text_field, r.repaired_text) for r in repaired(df).collect() if r.segment_id in (1, 2, 701)}
    assert (2, "body_text", "大正九年卒業し縣廳に勤務す。昭和三年會計課長に轉ず。") in fixed
    assert (1, "text_content", "His brother, the vice-president, was employed by the company.") in fixed
    assert [t for i, f, t in fixed if (i, f) == (701, "body_text")][0].startswith("He promoted printing")


def test_empty_table(spark):
    none = segments(spark).limit(0)
    assert noise_found(none).count() == 0 and repaired(none).count() == 0


def test_repairs_prefer_what_follows_the_same_word(spark):
    counts = spark.createDataFrame([("w", "form", 50), ("w", "farm", 50), ("w", "f0rm", 1), ("b", "the form", 50), ("b", "rice farm", 50), ("b", "the f0rm", 1)], "what string, key string, n long")
    assert {(r.read, r.word) for r in word_repairs(counts).collect()} == {("f0rm", "form")}


def name_segments(spark, heads):
    rows = [(k, "1927", "p0067", None, h, None) for k, h in enumerate(heads)]
    return spark.createDataFrame(rows, "segment_id long, volume string, source_page string, body_text string, header_ocr string, text_content string")


NAMES = ["Naoji Kirihama", "Tadao Kirihama", "土田竹平", "土田竹彦", "片井竹平"] * 20


def test_misread_names_of_the_right_shape_are_found(spark):
    df = name_segments(spark, [*NAMES, "Naoji Kirihania", "士田竹平", "片〓竹平"])
    assert {(r.segment_id, r.text_field, r.noise_kind) for r in noise_found(df).collect()} == {(100, "header_ocr", "char"), (101, "header_ocr", "char"), (102, "header_ocr", "char")}


def test_headers_are_repaired(spark):
    heads = [*NAMES, "Naoji Kirihania", "士田竹平", "片〓竹平", "Tada0 Kirihama", "片#竹平", "土 田 竹平(58)", "Naoji Kirihama 58", " "]
    df = name_segments(spark, heads)
    got = {r.segment_id: r.repaired_text for r in repaired(df).collect() if r.text_field == "header_ocr"}
    want = [*NAMES, "Naoji Kirihama", "土田竹平", "片井竹平", "Tadao Kirihama", "片井竹平", "土田竹平", "Naoji Kirihama 58", ""]
    assert got == dict(enumerate(want))


def test_short_words_meet_over_two_letter_confusions(spark):
    pairs = {"vvas": "was", "rnay": "may", "hirn": "him", "clid": "did", "farriily": "family", "iiiay": "may"}
    rows = [("w", w, 50) for w in sorted({*pairs.values(), "all"})] + [("w", r, 1) for r in pairs] + [("w", "oil", 1)]
    counts = spark.createDataFrame(rows, "what string, key string, n long")
    assert {r.read: r.word for r in word_repairs(counts).collect()} == pairs
