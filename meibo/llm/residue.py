"""Template residue, filler, error pages and script notices in document texts.

Labelled exemplars (below) are indexed by their features.  A text is read once, in passage windows (lines,
sentences, and bracketed spans).  A window of which the index knows too little to be covered, whatever
the weights, is passed over; the others are kept with the counts of the index's features.  Then the TF-IDF
weight of a window that the exemplars of a class cover decides.  Weights come from the whole corpus: a feature
common in biographies carries little, one that they never use carries much, so a biography that speaks
of a page, a server or a script is not covered.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meibo.session import materialize

PLACEHOLDER, FILLER, ERROR, NOTICE = "placeholder", "filler", "error", "notice"

# Labelled exemplars of residue.
EXEMPLARS: dict[str, list[str]] = {
    FILLER: [
        "this is sample text", "sample text goes here", "this is only sample text to fill the page", "this text is only a placeholder", "your biography goes here", "insert your biography here", "enter your text here", "insert content here", "content goes here", "content to follow", "text coming soon", "biography coming soon", "dummy text", "this paragraph is dummy text", "lorem ipsum dolor sit amet", "sed do eiusmod tempor", "ut enim ad minim veniam", "duis aute irure dolor", "これはダミーテキストです。", "これはサンプルテキストです。", "サンプルの文章です。", "ここに文章を入力してください。", "ここに略歴を入力してください。", "本文が入ります。", "本文が入る予定です。", "この文章はサンプルです。", "略歴は準備中です。", "テストテストテスト", "ダミーダミーダミー", "여기에 본문을 입력하세요.", "샘플 본문입니다.", "내용을 입력하세요", "내용 준비 중입니다.", "此處為示例文本", "請在此輸入文字", "請在此輸入內容", "示例文字示例文字", "測試文字", "這是示範文字。", "內容準備中",
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
        "ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat",
        "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur",
        "excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum",
        "sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam",
        "nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores",
        "quis veni nostr exerc ullam aliq commod irure volup vela cill fugit pariat sunt mollit morit tetuer consec quaerit anim nulla magna labore tempor",
        "sample text", "sample biography goes here", "your text here", "your text goes here", "insert text here", "text to follow", "biography to follow",
        "description coming soon", "content coming soon", "this is placeholder text for the entry", "this is placeholder text", "placeholder text",
        "this paragraph is only here to fill the page", "put the life of the person in this box", "dummy text dummy text", "this is a dummy text",
        "blah blah blah", "test test test", "asdf asdf qwer zxcv", "the quick brown fox jumps over the lazy dog", "foo bar baz", "xxx xxx xxx", "enter your content here",
        "ダミーテキストです。", "テキストテキストテキスト", "テスト投稿テスト投稿", "本文サンプル。", "サンプルテキスト", "文章が入ります。", "ここに文章が入ります。", "ここにテキストが入ります。",
        "ここに略歴が入ります。", "ここに説明文を入れてください。", "ここに本文を入力してください。", "この文章は見本です。", "字数を埋めるための文章です。", "この文章はダミーです。",
        "準備中です。", "○○○○の文章が入る予定です", "ああああああああ", "テキストを入力してください。", "あいうえおかきくけこ",
        "샘플 텍스트입니다.", "본문이 들어갈 자리입니다.", "여기에 내용을 입력하세요.", "테스트 테스트 테스트", "준비 중입니다.", "더미 텍스트입니다.", "가나다라마바사",
        "此處為示例文字。", "在此輸入內容。", "在此輸入文字", "測試測試測試", "示例文本示例文本", "內容準備中。", "暫無內容。", "此处输入文字", "正文示例。",
        "這裡是示範文字。", "這是一段佔位文字。", "內容待補。", "請在此填寫簡介。",
    ],
    ERROR: [
        "404 error page not found", "page not found", "the page could not be found", "the page was not found on this server", "the page you are looking for could not be found", "the page you are looking for does not exist", "the requested page does not exist", "the requested record could not be found on this server", "the record does not exist", "500 server error", "internal server error", "the server encountered an unexpected error", "the server did not answer the request in time", "bad gateway", "gateway timeout the upstream server did not answer", "the service is temporarily unavailable", "the service is down for maintenance please try again later", "please try again later", "something went wrong", "an error occurred please try again", "access to this page is forbidden", "you do not have permission to access this page", "access to this page was denied", "your session has expired", "session expired", "please sign in again to continue", "too many requests please slow down", "the connection has timed out", "the connection to the server was reset", "connection to the database failed", "could not establish a connection to the database", "database query failed", "fatal error uncaught exception in line", "warning undefined index", "parse error unexpected token", "syntax error unexpected token in line", "unhandled exception stack trace", "traceback most recent call last keyerror", "ページが見つかりません", "ページが存在しません。", "お探しのページは存在しません。", "指定されたページが見つかりませんでした。", "お探しのデータは見つかりませんでした。", "アクセスが拒否されました", "このページへのアクセス権限がありません。", "サーバーエラーが発生しました。", "内部エラーが発生しました。しばらくしてから再度お試しください。", "メンテナンス中です。", "ただいまアクセスできません。", "接続できませんでした。", "タイムアウトしました。", "セッションが切れました。", "データベースエラーが発生しました。", "前のページへ戻ってください。", "找不到頁面", "找不到您要的頁面", "頁面不存在或已被移除", "您沒有存取權限", "伺服器內部錯誤", "伺服器錯誤，請稍後再試", "系統維護中，請稍後再試", "連線逾時，請稍後再試", "資料庫錯誤", "服務不可用", "요청하신 페이지를 찾을 수 없습니다", "페이지가 존재하지 않습니다", "접근이 거부되었습니다", "권한이 없습니다", "서버에 오류가 발생했습니다", "시스템 점검 중입니다. 잠시 후 다시 시도해 주세요", "연결 시간이 초과되었습니다. 다시 시도해 주세요", "서비스 점검 중입니다",
        "http status code 404 not found", "error 404 page not found", "404 not found", "400 bad request", "401 unauthorized", "403 forbidden", "access forbidden",
        "405 method not allowed", "408 request timeout", "410 gone", "this page has been removed for good", "429 too many requests", "rate limit exceeded slow down",
        "500 internal server error", "502 bad gateway", "503 service unavailable", "service temporarily unavailable", "504 gateway time-out", "504 gateway timeout",
        "the requested page could not be found", "the requested url was not found on this server", "the page you requested does not exist", "we can't seem to find the page you're looking for", "oops!",
        "the record you asked for does not exist on this server", "the upstream server did not answer in time", "the upstream server sent an invalid reply",
        "the server met an unexpected condition", "the server encountered an internal error and was unable to complete your request", "something went wrong on our side", "something went wrong please try again later",
        "the archive is down for maintenance, try again later", "the site is down for maintenance", "access to this entry was refused", "access denied", "you do not have permission to view this page",
        "session expired, please sign in again", "your session has expired please log in again", "connection timed out while reading from the image store", "the connection was reset", "connection refused", "connection timed out",
        "error establishing a connection to the database", "error establishing a database connection", "query failed: relation does not exist", "syntax error near unexpected token",
        "fatal error: call to undefined function show_person()", "fatal error: uncaught exception", "warning: undefined variable on line", "notice: undefined index on line", "parse error: syntax error, unexpected",
        "traceback: KeyError 'birth_year' in render_entry", "traceback (most recent call last)", "NullPointerException at EntryView.render", "exception in thread main java.lang", "stack trace", "typeerror: cannot read properties of undefined", "segmentation fault",
        "エラー 404：ページが見つかりません", "お探しのページは見つかりませんでした。", "お探しのページは削除されたか、移動した可能性があります。", "指定されたデータは存在しません。", "指定されたページは存在しません。", "アクセスが拒否されました。", "アクセス権限がありません。",
        "ただいまアクセスが集中しております。", "しばらくしてから再度お試しください", "ただいまメンテナンス中です。", "接続がタイムアウトしました。", "サーバー内部でエラーが発生しました。", "エラーが発生しました。", "前のページへ戻ってやり直してください。",
        "データベースに接続できません。", "セッションの有効期限が切れました。",
        "找不到該頁面", "您訪問的頁面不存在", "頁面不存在", "連線逾時", "伺服器發生錯誤，請稍後再試", "服務暫時無法使用", "拒絕存取", "沒有存取權限", "請稍後再試", "系統維護中", "網頁已被移除", "服务器内部错误", "页面未找到", "資料庫連線失敗", "您沒有權限檢視此頁",
        "페이지를 찾을 수 없습니다", "접근 권한이 없습니다", "연결 시간이 초과되었습니다", "서버 오류가 발생했습니다.", "요청하신 페이지가 존재하지 않습니다", "잠시 후 다시 시도해 주세요", "점검 중입니다", "서비스를 이용할 수 없습니다", "잘못된 요청입니다",
    ],
    NOTICE: [
        "please enable javascript", "please enable javascript to continue", "please enable javascript in your browser and reload the page", "you must enable javascript to view this page", "this site requires javascript", "this page does not work without javascript", "javascript must be enabled in your browser to view this page", "your browser has javascript disabled", "scripts are disabled in your browser", "please allow scripts to view this page", "please turn on javascript in your browser", "turn on scripting and reload this page", "enable scripts to continue", "please switch on javascript to read this entry", "loading please wait", "JavaScriptが無効になっています。", "JavaScriptを有効にしてからご利用ください。", "ブラウザのJavaScriptを有効にしてください。", "このページはJavaScriptが必要です。", "スクリプトが無効です。", "スクリプトをオンにして再読み込みしてください。", "読み込み中です", "請啟用 JavaScript", "請啟用瀏覽器的 JavaScript 功能", "本頁需要啟用 JavaScript", "您的瀏覽器不支援 JavaScript", "자바스크립트를 켜 주세요.", "자바스크립트가 필요합니다.", "JavaScript를 활성화해 주세요.", "브라우저에서 자바스크립트를 활성화하세요", "스크립트 기능을 켜 주세요.",
        "please enable javascript to view this biography", "you need to enable javascript to continue", "you need to enable js to run this app", "this page requires javascript support, then reload the page", "javascript is required to view this site",
        "this viewer will not work without client-side scripts for full functionality of this site", "to read this entry you must turn on scripting in your browser and refresh", "kindly switch on scripts to continue",
        "it looks like your browser has disabled javascript", "we're sorry, but the reader doesn't work properly without javascript", "javascript is disabled in your browser", "javascript is turned off", "your browser does not support javascript", "please turn on javascript and cookies", "scripts must be allowed to show this page", "loading…",
        "このページの表示にはJavaScriptが必要です。", "JavaScriptを有効にしてください。", "スクリプトを有効にして再読み込みしてください。", "Javascriptがオフのため本文を表示できません。", "当館の閲覧画面はJavaScript対応のブラウザでご利用ください。", "お使いのブラウザではスクリプトが無効になっています。",
        "ブラウザの設定でJavaScriptをオンにしてください。", "読み込み中",
        "請啟用 JavaScript 後再瀏覽本頁。", "您的瀏覽器已停用 JavaScript。", "本頁需要 JavaScript 才能顯示。", "请启用JavaScript", "瀏覽器不支援指令碼", "請開啟瀏覽器的 JavaScript 功能",
        "자바스크립트를 활성화해 주세요.", "이 페이지를 보려면 JavaScript가 필요합니다.", "브라우저의 스크립트 기능이 꺼져 있습니다.", "자바스크립트가 비활성화되어 있습니다.",
    ],
    PLACEHOLDER: [
        "insert job title here", "[your name here]", "add organization", "organization goes here", "enter birth year", "fill in religion", "TODO: place", "TBD (family name)", "tba", "to be determined", "to be completed", "fixme", "replace with origin place", "put rank here", "type hobby here", "missing value",
        "氏名未入力", "現職：要記入", "ここに電話番号を記入", "出生地挿入", "要確認", "ここに氏名を入力", "記入してください", "未記入", "未定", "請填寫姓名", "待填寫", "待補", "此處填入", "이름 입력", "여기에 입력", "미입력",
        "name full name first name last name family name given name person name title person id", "rank place birth year birth place birthplace birth date birthday origin place death year start year end year year graduated", "school education religion hobby hobbies phone telephone address email", "organization company employer job title position occupation career spouse wife husband father mother children relation", "volume title volume no entry no entry id page number date today author editor country city province region location",
        "氏名 姓名 名前 姓 名 生年 生年月日 没年 出生地 本籍地 本籍 現住所 住所 電話番号 電話 趣味 宗教 學歷 学歴 卒業年 卒業校 現職 役職名 役職 職業 職名 勤務先 会社名 會社名 団体名 家族 配偶者 続柄 位階 頁 巻名 巻号 年齢 備考 日付",
        "姓名 籍貫 出生年 職稱 電話 學校 地址 單位 備註", "이름 성명 출생지 출생년도 직함 소속 전화번호 주소 학교 취미 종교 가족 직업",
    ],
}
# Bracket pairs that only templates use, and pairs that texts use too.
TEMPLATE_MARKS = [
    (r"\{\{", r"\}\}"), (r"\$\{", r"\}"), (r"#\{", r"\}"), (r"<%=?", r"%>"), (r"\{%", r"%\}"), (r"\[%", r"%\]"), (r"%%", r"%%"), (r"@@", r"@@"), (r"<<", r">>"), (r"&lt;", r"&gt;"),
    (r"\[\[", r"\]\]"), (r"%\(", r"\)[sd]"), (r"__", r"__"), (r"■", r"■"), (r"\$", r"\$"), (r"XXX ?", r" ?XXX"), (r"\{\$", r"\}"), (r"\|\|", r"\|\|"), (r"%", r"%"), (r"~~", r"~~"), (r"\*\|", r"\|\*"),
]
OTHER_MARKS = [(r"\{", r"\}"), (r"<", r">"), (r"\[", r"\]"), (r"＜", r"＞"), (r"【", r"】"), (r"（", r"）"), (r"〔", r"〕"), (r"〈", r"〉"), (r"《", r"》"), (r"「", r"」"), (r"［", r"］"), (r"｛", r"｝"), (r"\(", r"\)"), (r"TB[DA] ?\(", r"\)")]

_INSIDE = r"[ \t]*([\w.\-/：: 　]+?)[ \t]*"
# one pass over the openers; what no bracket can begin with is not tried
_SPAN = re.compile("(?=[{$#<%\\[@&_■X|~*＜【（〔〈《「［｛(T])(?:" + "|".join(f"{a}{_INSIDE}{b}" for a, b in TEMPLATE_MARKS + OTHER_MARKS) + ")")
# plain brackets need a word of instruction besides the field's name
_SOFT_OPENERS = ("(", "（", "〔", "「", "《", "〈")

_WORD = re.compile(r"[A-Za-zÀ-ÿ]+(?:'[a-z]+)?|\d+|[぀-ヿー]+|[㐀-鿿豈-﫿々○〇]+|[가-힣]+")
_HTTP = re.compile(r"[45]\d\d")
_CUT = re.compile(r"\n+|(?<=[。．！？])|(?<=[.!?])\s+")
_IDENT = re.compile(r"[A-Za-z]+(?:[_.][A-Za-z0-9]+)+|[A-Za-z][a-z]+(?:[A-Z][a-z]+)+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_INSTRUCT = {"insert", "add", "enter", "fill", "todo", "tbd", "tba", "your", "goes", "here", "put", "type", "replace", "fixme", "missing"}
_INSTRUCT_CJK = ("未入力", "要記入", "記入", "挿入", "入力", "未記入", "填寫", "填入", "待補", "입력", "未定", "要確認")
_TOLD_CJK = re.compile("ここに|此處|在此|여기에|を|：|:|の|" + "|".join(sorted(_INSTRUCT_CJK, key=len, reverse=True)))

#: an identifier in brackets: no biography has one, so it weighs as a feature never met
IDENT = "#ident"
#: share of a window's weight that a class must cover, and containment of one of its exemplars in the window
COVER = {FILLER: 0.8, ERROR: 0.8, NOTICE: 0.8, PLACEHOLDER: 0.65}
MIN_CONTAIN = {FILLER: 0.0, ERROR: 0.55, NOTICE: 0.3}


def features(text: str) -> list[str]:
    """Words of alphabetic scripts and character pairs of the others; a status code is one feature, other numbers none."""
    out = []
    for m in _WORD.finditer(text):
        w = m.group()
        c = w[0]
        if c.isdigit():
            if _HTTP.fullmatch(w):
                out.append("#status")
        elif c.isascii() or "À" <= c <= "ÿ":
            out.append(w.lower())
        elif "가" <= c <= "힣":
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
    return out


def _field_features(inside: str) -> list[str]:
    text = _CAMEL.sub(" ", inside).replace("_", " ").replace(".", " ").replace("-", " ").replace("/", " ")
    return features(text)


class ResidueIndex:
    """The inverted index over the exemplars: feature -> exemplars, and per class the features it covers."""

    def __init__(self, exemplars: dict[str, list[str]] = EXEMPLARS) -> None:
        self.exemplars = [(kind, frozenset(features(t))) for kind, texts in exemplars.items() for t in texts]
        self.postings: dict[str, list[int]] = {}
        for k, (_, feats) in enumerate(self.exemplars):
            for f in feats:
                self.postings.setdefault(f, []).append(k)
        self.covers: dict[str, set[str]] = {}
        for kind, feats in self.exemplars:
            self.covers.setdefault(kind, set()).update(feats)

    def vocabulary(self) -> list[str]:
        """All indexed features; their number is bounded by the exemplar table."""
        return sorted(self.postings)


def windows(text: str) -> list[tuple[str, list[str]]]:
    """Sentences, and lines of several, with their features."""
    out = []
    for line in text.split("\n"):
        parts = [(p.strip(), features(p)) for p in _CUT.split(line) if p and p.strip()]
        out += parts
        if len(parts) > 1:
            out.append((line.strip(), [f for _, feats in parts for f in feats]))
    return out


def spans(text: str) -> list[tuple[str, bool]]:
    """(inside, told): bracketed spans that may be a placeholder, and whether they hold a word of instruction.

    Plain brackets, which texts use too, are looked at only with such a word.
    """
    out = []
    for m in _SPAN.finditer(text):
        inside = next(g for g in m.groups() if g is not None)
        if not re.search(r"[^\W\d_]", inside):
            continue
        told = m.group()[:2] == "TB" or any(w in _INSTRUCT for w in _field_features(inside)) or any(w in inside for w in _INSTRUCT_CJK)
        if told or m.group()[0] not in _SOFT_OPENERS:
            out.append((inside, told))
    return out


def span_features(inside: str, told: bool, index: ResidueIndex) -> list[str]:
    """What a span is judged by: its words without those of instruction; an identifier's unknown words count as one."""
    if told:
        return _field_features(_TOLD_CJK.sub(" ", inside)) or ["記入"]
    feats = _field_features(inside)
    if _IDENT.fullmatch(inside.strip()):
        known = [f for f in feats if f in index.postings]
        return [IDENT, *known, *(["#other"] if len(known) < len(feats) else [])]
    return feats


class Weights:
    """IDF of every exemplar feature, and the exemplars' whole weights; a feature outside the index weighs half the most."""

    def __init__(self, index: ResidueIndex, df: dict[str, int], n: int) -> None:
        self.index = index
        self.idf = {f: math.log((n + 1) / (df.get(f, 0) + 1)) + 0.1 for f in index.postings} | {IDENT: math.log(n + 1) + 0.1}
        self.other = math.log(n + 1) / 2 + 0.1
        self.norms = [sum(self.idf[f] for f in feats) for _, feats in index.exemplars]

    def covered(self, kind: str, feats: list[str]) -> float:
        """Share of the window's weight that the class's exemplars cover."""
        cover, total, hit = self.index.covers.get(kind, ()), 0.0, 0.0
        for f in feats:
            w = self.idf.get(f, self.other)
            total += w
            if f in cover or f == IDENT and kind == PLACEHOLDER:
                hit += w
        return hit / total if total else 0.0

    def contained(self, kind: str, feats: list[str]) -> float:
        """Highest share of one exemplar of the class that the window holds."""
        seen: dict[int, float] = {}
        for f in set(feats):
            for k in self.index.postings.get(f, ()):
                if self.index.exemplars[k][0] == kind:
                    seen[k] = seen.get(k, 0.0) + self.idf[f]
        return max((s / self.norms[k] for k, s in seen.items()), default=0.0)

    def span_kinds(self, inside: str, told: bool) -> list[str]:
        return [PLACEHOLDER] if self.covered(PLACEHOLDER, span_features(inside, told, self.index)) >= COVER[PLACEHOLDER] else []

    def window_kinds(self, feats: list[str]) -> list[str]:
        found = []
        for kind in (FILLER, ERROR, NOTICE):
            if self.covered(kind, feats) >= COVER[kind]:
                best = self.contained(kind, feats)
                if best >= MIN_CONTAIN[kind] and (kind != FILLER or best >= 0.8 or len(feats) >= 4):
                    found.append(kind)
        return found


def may_be_covered(feats: list[str], index: ResidueIndex) -> bool:
    """False if a window can't be covered whatever the weights: no known feature weighs more than two unknown ones.

    A share of 0.8 then takes two known features for each unknown one.
    """
    known = sum(f in index.postings for f in feats)
    return known > 0 and known * 3 >= len(feats) * 2


def residue_kinds(text: str | None, weights: Weights) -> list[str]:
    """The classes of residue met in a text, in the order placeholder, filler, error, notice."""
    found = {k for inside, told in spans(text or "") for k in weights.span_kinds(inside, told)}
    for _, feats in windows(text or ""):
        if may_be_covered(feats, weights.index):
            found.update(weights.window_kinds(feats))
    return [k for k in (PLACEHOLDER, FILLER, ERROR, NOTICE) if k in found]


_SPAN_ROW, _TOLD_ROW, _WINDOW_ROW, _COUNT_ROW = "span", "told", "window", "count"


def passages(docs: DataFrame, index: ResidueIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, what, value, n): each document's windows and spans that may be residue, and per batch how many documents hold a feature.

    The texts are read whole, and once.  Documents without such a passage leave no row.
    """
    vocab = frozenset(index.postings)
    src = docs.select(key, F.col(text).alias("_text"))
    schema = src.drop("_text").schema.add("what", T.StringType()).add("value", T.StringType()).add("n", T.LongType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, {}
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, what, value = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n += 1
                if not t:
                    continue
                met = set()
                for w, feats in windows(t):
                    met.update(feats)
                    if may_be_covered(feats, index):
                        ids.append(i), what.append(_WINDOW_ROW), value.append(w)
                for f in met & vocab:
                    df[f] = df.get(f, 0) + 1
                for inside, told in spans(t):
                    feats = span_features(inside, told, index)
                    if any(f in vocab or f == IDENT for f in feats):
                        ids.append(i), what.append(_TOLD_ROW if told else _SPAN_ROW), value.append(inside)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(what, pa.string()), pa.array(value, pa.string()), pa.nulls(len(ids), pa.int64())], names=[key, "what", "value", "n"])
        if n:
            df[""] = n
            yield pa.RecordBatch.from_arrays([pa.nulls(len(df), kind), pa.array([_COUNT_ROW] * len(df), pa.string()), pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=[key, "what", "value", "n"])

    return src.mapInArrow(scan, schema)


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text", index: ResidueIndex | None = None) -> DataFrame:
    """(key, kinds): the documents that hold residue, wholly or for a stretch, with its classes.

    Null, empty and blank texts hold none.  Whole texts are read.  Repeated keys come out once; documents with a
    null key count but have no row.  Only the counts of exemplar features reach the driver; their number is
    bounded by the exemplar table whatever the corpus holds.
    """
    index = index or ResidueIndex()
    rows = materialize(passages(docs, index, key, text), "passages")
    df = {r["value"]: r["n"] for r in rows.where(F.col("what") == _COUNT_ROW).groupBy("value").agg(F.sum("n").alias("n")).collect()}
    weights = Weights(index, df, df.pop("", 0))
    src = rows.where((F.col("what") != _COUNT_ROW) & F.col(key).isNotNull()).select(key, "what", "value")
    schema = src.drop("what", "value").schema.add("kind", T.StringType())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = [], []
            for i, what, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for k in weights.window_kinds(features(value)) if what == _WINDOW_ROW else weights.span_kinds(value, what == _TOLD_ROW):
                    ids.append(i), kinds.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(kinds, pa.string())], names=[key, "kind"])

    order = F.array(*[F.lit(k) for k in (PLACEHOLDER, FILLER, ERROR, NOTICE)])
    found = src.mapInArrow(judge, schema).groupBy(key).agg(F.collect_set("kind").alias("_kinds"))
    return found.select(key, F.array_intersect(order, "_kinds").alias("kinds"))


def keep_clean(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The corpus without the documents of ``found``; documents with a null key are kept."""
    return docs.join(found.select(key).distinct(), key, "left_anti")
