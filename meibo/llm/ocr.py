"""Noise of page and reading in scanned text: running headers, page numbers, divided words, misread characters.

Three corpus-wide models come first.  Per volume: the running headers and the distance between scan and
printed page.  For alphabetic script: a frequency lexicon; a symmetric-delete index brings rare words and
frequent ones together, a weighted edit distance with confusion pairs verifies them and bigram context
picks between candidates.  For unspaced script a "word" is a character with two neighbours on each side, and
the delete is the one in its middle: a character that a commoner one replaces in many such contexts is a
confusion, and a place is a misreading where the replacement makes every context commoner.
Headers and page numbers are stripped from each field once; what detection must look up is joined, never collected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meibo.functions.keys import skew_lookup
from meibo.functions.text import osa_distance
from meibo.session import materialize

FIELDS = ("body_text", "header_ocr", "text_content")
HYPHEN, CHAR, HEADER, PAGENO = "hyphen", "char", "header", "pageno"

# What type and eye take for each other (read as = printed as).
CONFUSIONS = tuple(
    tuple(p.split("="))
    for p in "0=o 1=l 1=i 5=s !=i |=l |=i (=c 6=b 9=g 8=b c=e e=c q=g g=q cl=d d=cl ri=n n=ri rn=m m=rn in=m m=in ni=m ii=u u=ii li=h h=li f=t t=f vv=w w=vv ll=u l=i i=l b=h h=b o=c c=o a=o o=a u=n n=u il=d rri=m nn=m iii=m 3=e 4=a 7=t $=s @=a €=e £=f".split()
)
_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_FIRST.setdefault(_a[0], []).append((_a, _b))
_TRIPLES = tuple(a for a, _ in CONFUSIONS if len(a) > 2)
_MARKS = "-‐‑–—=¬~\xad_"
_KANJI_DIGIT = {c: k for k, c in enumerate("〇一二三四五六七八九")} | {"零": 0, "○": 0}
_NUM = r"(?:[0-9０-９]{1,4}|[〇○零一二三四五六七八九]{1,4})"
_PAGE = re.compile(rf"(?:[(（\[［【〔]\s*({_NUM})\s*[)）\]］】〕]|[-—―–・·‐~*]\s*({_NUM})\s*[-—―–・·‐~*]|(?:p\.?|P\.?|頁)\s*({_NUM})|({_NUM})\s*(?:頁|ページ)|({_NUM}))")
_SECTION = re.compile(r"(?:[ァ-ヶ]|[ぁ-ん]|[A-Z])之部|[—―–-]\s*[A-Z]$")
_KANA = re.compile(r"[ぁ-ん]")
_CJK = re.compile(r"[㐀-鿿]")
_ROMAJI = re.compile(r"(?:(?:[kgsztdnhbpmyrwjf]|ch|sh|ts|ky|gy|hy|by|py|my|ry|ny|j|kk|ss|tt|pp|tch|ssh)?[aeiou]|n(?=[^aeiou]|$))+", re.I)
# Characters that look alike in worn type (read as, printed as); more are learned from the corpus.
LOOK_ALIKES = (
    "率卒 勒勤 挍校 叢業 廷庭 曾會 仕任 間問 畏長 鋃銀 聽廳 冶治 縮締 左在 朋明 往行 冢家 識職 敢取 規現 杜社 趨趣 宮官 昧味 諜課 擧學 晨農 懸縣 枝技 紀記 宋宗 杳査 啇商 帥師 賀貿 藍監 "
    "晝書 敖敎 雷電 亊事 汽氣 鐡鐵 遒道 伇役 攴支 矜務 末未 未末 士土 土士 日曰 已己 人入 入人 大太 太大 千干 白自 自白 微徴 復複 侍待 待侍 持特 壬王 圑團 逹達 閒間 徙従 拆折 緑綠"
)
# Forms of strokes that stand for a part of a character.
_STROKES = set("囗丅丄彡〓⊥⊤ⅲ□■◇#|_※＃＿｜〇")
# Strokes in the place of a character of a name (read as=printed as), and kana that alone between kanji are one.
_FORMS = tuple(tuple(p.split("=")) for p in "囗十=田 11|=川 郞_=郎 ⅲ=川 #=井 丅=下 丄=上 ⊥=上 囗=口".split())
_LONE_KANA = dict(zip("ロホエニハカタトチミ", "口木工二八力夕卜千三"))
MIN_CONTEXTS, MIN_SEEN, DOMINANCE = 3, 10, 8
NAME_RATIO = 8
COMMON_WORDS = 5_000
BROADCAST_VOLUMES = 10_000


def number_of(s: str) -> int | None:
    """A page number in Arabic or positional kanji digits."""
    s = s.translate(str.maketrans("０１２３４５６７８９", "0123456789"))
    if s.isdigit():
        return int(s)
    if s and all(c in _KANJI_DIGIT for c in s):
        return int("".join(str(_KANJI_DIGIT[c]) for c in s))
    return None


def _page_match(m: re.Match) -> tuple[int | None, bool]:
    """(number, decorated) of a match of ``_PAGE``."""
    g = next(k for k in range(1, 6) if m.group(k) is not None)
    return number_of(m.group(g)), g != 5


def head_key(line: str) -> str:
    """What is compared of a running header: upper case, without spaces, page number and section."""
    s = _SECTION.sub("", line.strip())
    return re.sub(r"[\s0-9０-９\-—―–・·()（）\[\]．.,、頁]+", "", s).upper()


def _displayed(line: str) -> bool:
    """True if a line looks set as a heading: letters apart, capitals, a section mark or a page number beside it."""
    s = line.strip()
    parts = re.split(r"[\s　]+", s)
    if len(parts) >= 4 and sum(len(p) == 1 for p in parts) >= 0.9 * len(parts):
        return True
    if re.search(r"[ァ-ヶぁ-ん]之部", s):
        return True
    letters = re.sub(r"[^A-Za-z]", "", s)
    if len(letters) >= 8 and len(parts) >= 2 and letters.isupper():
        return True
    edge = re.match(rf"^{_PAGE.pattern}[\s　]+\S", s) or re.search(rf"\S[\s　]+{_PAGE.pattern}$", s)
    return bool(edge) and not s.endswith(("。", "."))


def page_of(source_page: str | None) -> int | None:
    """The scan's number in a page name such as p0067."""
    m = re.search(r"(\d+)\D*$", source_page or "")
    return int(m.group(1)) if m else None


def volume_model(segments: DataFrame) -> DataFrame:
    """(volume, headers, page_shift): the running headers of each volume and scan number minus printed number.

    Counts are added up per batch before the shuffle.  Headers are the displayed lines seen at least three
    times and a twentieth as often as the volume's commonest one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            vols, pages, a, b = (batch.column(k).to_pylist() for k in range(4))
            for vol, page, *texts in zip(vols, pages, a, b):
                scan = page_of(page)
                for text in texts:
                    for line in (text or "").split("\n"):
                        s = line.strip()
                        if not s:
                            continue
                        m = _PAGE.fullmatch(s)
                        if m and scan is not None:
                            n, _ = _page_match(m)
                            if n is not None:
                                seen[(vol, "shift", str(scan - n))] += 1
                        elif _displayed(s):
                            key = head_key(s)
                            if len(key) >= 4:
                                seen[(vol, "head", key)] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys], pa.string()) for j in range(3)] + [pa.array([seen[k] for k in keys], pa.int64())], names=["volume", "what", "value", "n"])

    counts = segments.select("volume", "source_page", "body_text", "text_content").mapInArrow(count, "volume string, what string, value string, n bigint")
    # read for the headers and for the shift
    counts = materialize(counts.groupBy("volume", "what", "value").agg(F.sum("n").alias("n")), "volume-counts")
    top = Window.partitionBy("volume", "what")
    ranked = counts.withColumn("most", F.max("n").over(top))
    heads = ranked.where((F.col("what") == "head") & (F.col("n") >= 3) & (F.col("n") * 20 >= F.col("most"))).groupBy("volume").agg(F.sort_array(F.collect_list("value")).alias("headers"))
    shift = counts.where(F.col("what") == "shift").groupBy("volume").agg(F.max_by(F.col("value").cast("int"), F.struct("n", "value")).alias("page_shift"))
    return heads.join(shift, "volume", "full")


def _resembles(squeezed: str, headers: list[str]) -> bool:
    """False if a line shares too few character pairs with every header to hold one: spares the exact comparison."""
    for h in headers:
        grams = _sampled(h)
        if sum(g in squeezed for g in grams) * (2 if len(h) >= 14 else 3) >= len(grams):
            return True
    return False


@lru_cache(maxsize=4096)
def _sampled(header: str) -> tuple[str, ...]:
    """Character pairs of a header, every third of a long one."""
    return tuple(header[k : k + 2] for k in range(0, len(header) - 1, 1 if len(header) < 14 else 3))


@lru_cache(maxsize=1 << 16)
def _nearest_head(key: str, headers: tuple[str, ...]) -> int | None:
    best = None
    for h in headers:
        limit = max(1, len(h) // 4) if best is None else best - 1
        if limit >= 0 and abs(len(key) - len(h)) <= limit and (d := osa_distance(key, h, limit)) <= limit:
            best = d
    return best


def _head_distance(key: str, headers: list[str]) -> int | None:
    """Edits to the nearest header, None if no header lies within a quarter of its length.  Headers recur: the last ones are kept."""
    return _nearest_head(key, tuple(headers))


def _is_header(key: str, headers: list[str]) -> bool:
    return _head_distance(key, headers) is not None


def strip_marks(text: str, headers: list[str], page: int | None) -> tuple[list[str], set[str]]:
    """(lines left, kinds met): the text's lines without running headers and printed page numbers.

    A header or page number counts where it stands alone or at an end of a line, set apart by white space.  With
    ``page`` (the printed number expected) only that number counts; without it, decorated ones do.
    """
    kinds, left = set(), []
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            left.append("")
            continue
        parts = s.split()
        titled = bool(headers) and _resembles("".join(parts).upper(), headers)
        if titled and _is_header(head_key(s), headers):
            kinds.add(HEADER)
            for m in _PAGE.finditer(s):
                n, deco = _page_match(m)
                if n is not None and (n == page if page is not None else deco):
                    kinds.add(PAGENO)
            continue
        numbered = not _DIGITS.isdisjoint(parts[0]) or not _DIGITS.isdisjoint(parts[-1]) or len(parts) > 1 and not (_DIGITS.isdisjoint(parts[1]) and _DIGITS.isdisjoint(parts[-2]))
        if titled or numbered:
            for _ in range(2):
                cut, s2 = _edge_page(s, page)
                if cut:
                    kinds.add(PAGENO)
                    s = s2
                    if titled and s and _is_header(head_key(s), headers):
                        kinds.add(HEADER)
                        s = ""
                cut, s2 = _edge_header(s, headers) if titled and s else (False, s)
                if cut:
                    kinds.add(HEADER)
                    s = s2
                if not s:
                    break
        if s:
            left.append(s)
    return left, kinds


_DIGITS = frozenset("0123456789０１２３４５６７８９") | frozenset(_KANJI_DIGIT)
_EDGE_FRONT = re.compile(rf"^{_PAGE.pattern}(?=[\s　]|$)")
_EDGE_BACK = re.compile(rf"(?:(?<=[\s　])|^){_PAGE.pattern}$")


def _edge_page(s: str, page: int | None) -> tuple[bool, str]:
    for pat in (_EDGE_FRONT, _EDGE_BACK):
        m = pat.search(s)
        if m:
            n, deco = _page_match(m)
            if n is not None and (n == page if page is not None else deco):
                return True, (s[: m.start()] + s[m.end() :]).strip()
    return False, s


def _edge_header(s: str, headers: list[str]) -> tuple[bool, str]:
    gaps = [m.start() for m in re.finditer(r"[\s　]+", s)]
    if not gaps or not headers:
        return False, s
    longest = max(len(h) for h in headers) + 4
    best: tuple[int, int, str] | None = None
    for g in gaps:
        head, tail = s[:g], s[g:].strip()
        for part, rest in ((head, tail), (tail, head)):
            if len(part) > 5 * longest:
                continue
            key = head_key(part)
            if not 4 <= len(key) <= longest + 2:
                continue
            d = _head_distance(key, headers)
            # letters apart or capitals or title case all through: a heading, not a mention; of equally near cuts the longest heading
            if d is not None and (_CJK.search(part) or not re.search(r"(?:^|\s)(?:of|and|the|in)(?:\s|$)", part)) and (best is None or (d, -len(part)) < best[:2]):
                best = (d, -len(part), rest)
    return (True, best[2]) if best else (False, s)


def _token(w: str) -> str:
    w = w.strip("\"'“”‘’«»").rstrip(".,;:?\"'“”’")
    if w.startswith("(") and w.endswith(")"):
        w = w[1:-1]
    return w.rstrip(".,;:?")


def _usable(w: str) -> bool:
    """True for a word in Latin script that may hold a misreading."""
    return len(w) >= 3 and bool(re.search(r"[A-Za-z]", w)) and not _CJK.search(w) and bool(re.fullmatch(r"[A-Za-z0-9!|($@€£'\-‐‑]+", w)) and not re.fullmatch(r"p?\d+[a-z]{0,2}", w)


def _is_name(w: str) -> bool:
    return w[:1].isupper() and bool(_ROMAJI.fullmatch(w))


def latin_words(lines: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(words, divided): (previous word, word) in running order, and (part, rest) of words divided at a line end."""
    words, divided = [], []
    prev = ""
    carry = None
    for line in lines:
        toks = line.split()
        for k, raw in enumerate(toks):
            if carry is not None:
                rest = _token(raw)
                if rest:
                    divided.append((carry, rest))
                prev, carry = "", None
                continue
            if k == len(toks) - 1 and len(raw) > 1 and raw[-1] in _MARKS and re.search(r"[A-Za-z]", raw):
                part = raw[:-1].lstrip("\"'“”‘’")
                if part.startswith("(") and not re.match(r"\([a-z]*$", part):
                    part = part[1:]
                carry = part
                continue
            w = _token(raw)
            if _usable(w):
                words.append((prev, w))
            prev = w.lower()
    return words, divided


def unspaced(lines: list[str]) -> str:
    """The text of an unspaced script in one run, padded for its contexts."""
    return "^^" + re.sub(r"[\s　]", "", "".join(lines)) + "$$"


def _is_unspaced(text: str) -> bool:
    return bool(_KANA.search(text)) or (bool(_CJK.search(text)) and not re.search(r"[A-Za-z]{3}", text))


_STRIPPED = "segment_id bigint, text_field string, unspaced boolean, kinds array<string>, lines string"


def stripped(segments: DataFrame) -> DataFrame:
    """(segment_id, text_field, unspaced, kinds, lines): every non-null field without running headers and page numbers, and which of them it had.

    The texts are read for this once; counting, looking up and repairing start from its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sid, headers, shift, page, head, *texts in zip(*(batch.column(k).to_pylist() for k in range(7))):
                scan = page_of(page)
                expect = scan - shift if scan is not None and shift is not None else None
                if head is not None:
                    name, kinds = header_name(head, headers or [], expect) if head.strip() else ("", set())
                    rows.append((sid, "header_ocr", _is_native(name), sorted(kinds), name))
                for field, text in zip(("body_text", "text_content"), texts):
                    if text is not None:
                        lines, kinds = strip_marks(text, headers or [], expect)
                        rows.append((sid, field, _is_unspaced(text), sorted(kinds), "\n".join(lines)))
            types = (pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["segment_id", "text_field", "unspaced", "kinds", "lines"])

    return segments.select("segment_id", "headers", "page_shift", "source_page", "header_ocr", "body_text", "text_content").mapInArrow(run, _STRIPPED)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(what, key, n): words 'w', word pairs 'b' and five-character windows 'j' of all ``stripped`` texts.

    Joined parts of divided words enter as words of count 0, so that they are looked up too.  Entry headers count
    apart, as words 'n' (with the names of running text) and windows 'h': what is common in names is not in prose.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for field, native, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if field == "header_ocr":
                    if native:
                        seen.update(("h", win) for win in name_windows(text))
                    else:
                        seen.update(("n", _name_key(w)) for w in text.split())
                elif native:
                    s = unspaced(text.split("\n"))
                    seen.update(("j", s[i - 2 : i + 3]) for i in range(2, len(s) - 2))
                else:
                    words, divided = latin_words(text.split("\n"))
                    for p, w in words:
                        seen[("w", w.lower())] += 1
                        if _is_name(w):
                            seen[("n", w.lower())] += 1
                        elif p:
                            seen[("b", p + " " + w.lower())] += 1
                    for a, b in divided:
                        seen[("w", (a + b).lower())] += 0
                        seen[("w", (a + "-" + b).lower())] += 0
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["what", "key", "n"])

    return texts.select("text_field", "unspaced", "lines").mapInArrow(count, "what string, key string, n bigint").groupBy("what", "key").agg(F.sum("n").alias("n"))


def weighted_edits(read: str, word: str, limit: float = 1.3) -> tuple[float, bool]:
    """(cost, all confusions): edits from a reading to a word; a confusion pair costs 0.3, any other edit 1."""
    n, m = len(read), len(word)
    inf = 99.0
    d = [[inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            v = d[i][j]
            if v > limit:
                continue
            if i < n and j < m:
                c = v + (0.0 if read[i] == word[j] else 1.0)
                if c < d[i + 1][j + 1]:
                    d[i + 1][j + 1] = c
            if i < n and v + 1 < d[i + 1][j]:
                d[i + 1][j] = v + 1
            if j < m and v + 1 < d[i][j + 1]:
                d[i][j + 1] = v + 1
            for a, b in _BY_FIRST.get(read[i], ()) if i < n and j < m else ():
                if read.startswith(a, i) and word.startswith(b, j) and v + 0.3 < d[i + len(a)][j + len(b)]:
                    d[i + len(a)][j + len(b)] = v + 0.3
    cost = d[n][m]
    return cost, cost < 1.0


def deletes(w: str, most: int = 2) -> set[str]:
    """The word and all its forms with up to ``most`` characters left out."""
    out = {w}
    level = {w}
    for _ in range(most):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out |= level
    return out


def word_repairs(counts: DataFrame, ratio: int = 4, what: str = "w") -> DataFrame:
    """(read, word): misread words and what they stand for, from the frequency lexicon.

    A word is a target if it is ``ratio`` times as frequent as the reading; candidates meet on shared deletes, are
    verified by the weighted edit distance (confusions only, as many as two deletes, or three where a reading holds
    a three-letter confusion, bring together), and the nearest wins; of several as
    near, the one that follows the reading's left neighbours most often, then the more frequent.  Of names ('n') a
    reading that no name can be (a digit or mark in it, no romaji) needs no ratio, as it is wrong in any case.
    """
    words = counts.where(F.col("what") == what).select(F.col("key").alias("w"), "n").where(F.length("w").between(3, 40))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, n, d) for w, n in zip(pdf["w"], pdf["n"]) for d in deletes(w, 3 if any(a in w for a in _TRIPLES) else 2) if d]
            yield pd.DataFrame(rows, columns=["w", "n", "d"])

    index = words.repartition("w").mapInPandas(spread, "w string, n bigint, d string")
    index = materialize(index, "deletes")
    rare = index.select(F.col("w").alias("read"), F.col("n").alias("n_read"), "d")
    rarer = (F.col("n_word") >= 4) & (F.col("n_word") >= F.greatest(F.col("n_read"), F.lit(1)) * ratio)
    if what == "n":
        named = lambda c: F.regexp_replace(c, "[-']", "").rlike(f"(?i)^{_ROMAJI.pattern}$")
        often = index.where(named("w"))
        rarer |= ~named("read")
    else:
        often = index.where("n >= 4")
    often = often.select(F.col("w").alias("word"), F.col("n").alias("n_word"), "d")
    met = rare.join(often, "d").where(rarer & (F.col("read") != F.col("word"))).select("read", "n_read", "word", "n_word").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [weighted_edits(a, b) for a, b in zip(pdf["read"], pdf["word"])]
            pdf = pdf.assign(cost=[g[0] for g in got])
            # two confusions make almost any short word of another: words of four letters or less have one
            yield pdf.loc[[ok and (cost < 0.5 or min(len(a), len(b)) > 4) for (cost, ok), a, b in zip(got, pdf["read"], pdf["word"])]]

    near = met.mapInPandas(verify, "read string, n_read bigint, word string, n_word bigint, cost double")
    best = near.withColumn("least", F.min("cost").over(Window.partitionBy("read"))).where(F.col("cost") <= F.col("least") + 1e-9)
    pairs = counts.where("what = 'b'").select(F.substring_index("key", " ", 1).alias("prev"), F.substring_index("key", " ", -1).alias("w"), "n")
    left = best.join(pairs.select(F.col("w").alias("read"), "prev"), "read", "left")
    fits = left.join(pairs.select("prev", F.col("w").alias("word"), F.col("n").alias("fit")), ["prev", "word"], "left")
    scored = fits.groupBy("read", "word", "n_word").agg(F.coalesce(F.sum("fit"), F.lit(0)).alias("fit"))
    return scored.groupBy("read").agg(F.max_by("word", F.struct("fit", "n_word", "word")).alias("word"))


def character_confusions(counts: DataFrame) -> DataFrame:
    """(x, d): characters of unspaced script read as ``x`` for ``d``.

    In at least ``MIN_CONTEXTS`` contexts that ``d`` fills ``MIN_SEEN`` times or more, ``x`` stands in its place at
    most an eighth as often, and taken over all contexts they share too.  Known look-alikes are added, so that
    a small corpus is read as well.  At most one row per pair of characters.
    """
    win = counts.where("what = 'j'").select(F.concat(F.substring("key", 1, 2), F.substring("key", 4, 2)).alias("ctx"), F.substring("key", 3, 1).alias("c"), "n")
    by_ctx = win.groupBy("ctx").agg(F.collect_list(F.struct("n", "c")).alias("cs"), F.max(F.struct("n", "c")).alias("top")).where((F.size("cs") > 1) & (F.col("top.n") >= MIN_SEEN))
    pairs = by_ctx.select(F.col("top.c").alias("d"), F.col("top.n").alias("nd"), F.explode("cs").alias("o")).select(F.col("o.c").alias("x"), "d", F.col("o.n").alias("nx"), "nd").where(F.col("x") != F.col("d"))
    script, digits = r"[㐀-鿿ぁ-ヶ]", r"[〇一二三四五六七八九十百千]"
    pairs = pairs.where(F.col("x").rlike(script) & F.col("d").rlike(script) & ~(F.col("x").rlike(digits) & F.col("d").rlike(digits)))
    met = pairs.groupBy("x", "d").agg(
        F.sum("nx").alias("nx"), F.sum("nd").alias("nd"), F.count_if(F.col("nx") * DOMINANCE <= F.col("nd")).alias("contexts"), F.sum(F.when(F.col("nx") * DOMINANCE <= F.col("nd"), F.col("nx"))).alias("seen"),
    )
    # names of places interchange both ways; a misreading takes one character's place and hardly ever the other way round
    back = met.select(F.col("d").alias("x"), F.col("x").alias("d"), F.col("nd").alias("rx"), F.col("nx").alias("rd"))
    both = met.join(back, ["x", "d"], "left")
    one_way = (F.col("nx") + F.coalesce("rx", F.lit(0))) * DOMINANCE <= F.col("nd") + F.coalesce("rd", F.lit(0))
    learned = both.where(one_way & ((F.col("contexts") >= MIN_CONTEXTS) | (F.col("seen") >= MIN_SEEN))).select("x", "d")
    prior = counts.sparkSession.createDataFrame([tuple(p) for p in LOOK_ALIKES.split()], "x string, d string")
    return learned.unionByName(prior).distinct()


def misread_windows(counts: DataFrame, confusions: DataFrame, odds: float = 50.0, what: str = "j") -> DataFrame:
    """(window, d): five-character windows whose middle is a misreading of ``d``.

    The windows' three trigrams are compared with those that ``d`` would make; the product of the ratios of
    their counts must reach ``odds``, and no trigram may become rarer.  A form of strokes, and in headers ('h') any
    character that no name holds, may stand for every character seen between the same two, or if none is for those
    after the one before; the likeliest is taken.
    """
    win = counts.where(F.col("what") == what).select(F.col("key").alias("window"), "n")
    tri = win.groupBy(F.substring("window", 2, 3).alias("t")).agg(F.sum("n").alias("tn"))
    cand = win.select("window", F.substring("window", 3, 1).alias("x")).join(confusions, "x")
    middle = F.substring("window", 3, 1)
    odd = ~middle.rlike(_NAME_CHARACTER) if what == "h" else middle.isin(sorted(_STROKES - {"〇"}))
    strange = win.where(odd).select("window", middle.alias("x"), F.substring("window", 2, 1).alias("l"), F.substring("window", 4, 1).alias("r"))
    seen = tri.select(F.substring("t", 1, 1).alias("l"), F.substring("t", 3, 1).alias("r"), F.substring("t", 2, 1).alias("d"), "tn").where(F.col("d").rlike(_NAME_CHARACTER) & ~F.col("d").isin(sorted(_STROKES)))
    between = strange.join(seen.select("l", "r", "d").distinct(), ["l", "r"]).select("window", "x", "d")
    follow = seen.groupBy("l", "d").agg(F.sum("tn").alias("n")).groupBy("l").agg(F.max_by("d", F.struct("n", "d")).alias("d"))
    alone = strange.join(between.select("window").distinct(), "window", "left_anti").join(follow, "l").select("window", "x", "d")
    cand = cand.select("window", "x", "d").unionByName(between).unionByName(alone).distinct()
    left, mid, right = F.substring("window", 1, 2), F.substring("window", 2, 1), F.substring("window", 4, 2)
    after = F.substring("window", 4, 1)
    each = cand.select(
        "window", "d",
        F.explode(F.array(
            F.struct(F.lit(0).alias("k"), F.concat(left, "x").alias("tx"), F.concat(left, "d").alias("td")),
            F.struct(F.lit(1).alias("k"), F.concat(mid, F.col("x"), after).alias("tx"), F.concat(mid, F.col("d"), after).alias("td")),
            F.struct(F.lit(2).alias("k"), F.concat(F.col("x"), right).alias("tx"), F.concat(F.col("d"), right).alias("td")),
        )).alias("g"),
    ).select("window", "d", "g.tx", "g.td")
    counted = each.join(tri.select(F.col("t").alias("tx"), F.col("tn").alias("nx")), "tx", "left").join(tri.select(F.col("t").alias("td"), F.col("tn").alias("nd")), "td", "left")
    ratio = (F.coalesce("nd", F.lit(0)) + 0.5) / (F.coalesce("nx", F.lit(0)) + 0.5)
    judged = counted.groupBy("window", "d").agg(F.sum(F.log(ratio)).alias("gain"), F.min(ratio).alias("worst"))
    sure = judged.where(((F.col("gain") >= F.log(F.lit(odds))) & (F.col("worst") >= 0.5)) | odd)
    return sure.groupBy("window").agg(F.max_by("d", F.struct("gain", "d")).alias("d"))


#: what a name in unspaced script is written with (kanji, kana and their marks), without forms of strokes
_NAME_CHARACTER = r"^[㐀-鿿々ァ-ヶぁ-んー&&[^囗丅丄彡]]$"


def _is_native(name: str) -> bool:
    return bool(re.search(r"[㐀-鿿ぁ-ヶ]", name))


def _name_key(w: str) -> str:
    return w.rstrip(".,").lower()


def _lone_kana(core: str) -> list[re.Match]:
    """Single katakana of a name that stand for a kanji."""
    return [] if re.search(r"[一-鿿][ヶケ][一-鿿]", core) else list(re.finditer(r"(?<![ァ-ヶー])[ァ-ヶ](?![ァ-ヶー])", core))


def printed_forms(name: str) -> str:
    """A name in unspaced script without spaces, forms of strokes set back to the characters they stand for."""
    core = re.sub(r"[\s　・]", "", name)
    for read, printed in _FORMS:
        core = core.replace(read, printed)
    for m in _lone_kana(core):
        core = core[: m.start()] + _LONE_KANA.get(m.group(), m.group()) + core[m.end() :]
    return core


def printed_word(w: str) -> str:
    """A word of a name with a digit or mark in it, that set back by one confusion pair, if that makes it a name."""
    if not re.search(r"[0-9!|($@€£]", w):
        return w
    low = _name_key(w)
    for i, c in enumerate(low):
        for read, printed in _BY_FIRST.get(c, ()) if not c.isalpha() else ():
            fixed = low[:i] + printed + low[i + len(read) :]
            if low.startswith(read, i) and _ROMAJI.fullmatch(fixed.replace("-", "").replace("'", "")):
                return fixed.capitalize() + w[len(low) :]
    return w


def printed_name(name: str) -> str:
    """The name in an entry's header as its characters tell by the table of confusions alone."""
    return printed_forms(name) if _is_native(name) else " ".join(map(printed_word, name.split()))


def name_windows(name: str) -> list[str]:
    s = unspaced([printed_forms(name)])
    return [s[i - 2 : i + 3] for i in range(2, len(s) - 2)]


def header_name(name: str, headers: list[str], page: int | None) -> tuple[str, set[str]]:
    """(name, kinds met): the header of an entry without page number and running header."""
    kinds = set()
    s = name.strip()
    if _is_header(head_key(s), headers):
        kinds.add(HEADER)
        return "", kinds
    rest = s
    if headers and _resembles("".join(s.split()).upper(), headers):
        cut, rest = _edge_header(s, headers)
        kinds |= {HEADER} if cut else set()
    pats = [rf"^{_PAGE.pattern}", rf"{_PAGE.pattern}$"]
    for pat in pats:
        m = re.search(pat, rest)
        while m:
            n, deco = _page_match(m)
            body = (rest[: m.start()] + rest[m.end() :]).strip()
            if n is not None and (n == page if page is not None else deco) and body:
                kinds.add(PAGENO)
                rest = body
                break
            # a bare kanji number may run into the name: try a shorter one
            nxt = re.compile(pat).search(rest, m.start() + 1)
            m = nxt if nxt and nxt.start() > m.start() else None
    return rest, kinds


_PLAIN = re.compile("[㐀-鿿々ァ-ヶぁ-んー]")
_HITS = "segment_id bigint, text_field string, what string, a string, b string"


def _is_stroke(s: str, i: int) -> bool:
    """True for a form of strokes in running unspaced text."""
    return s[i] in _STROKES and s[i] != "〇" and bool(_CJK.match(s[i - 1]) or _CJK.match(s[i + 1]))


def _read_fields(texts: DataFrame, skip: frozenset[str], middles: frozenset[str]) -> DataFrame:
    """(segment_id, text_field, what, a, b): words, divided words and windows of the ``stripped`` texts to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple] = set()
            for sid, field, native, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if field == "header_ocr":
                    if printed_name(text) != (re.sub(r"[\s　・]", "", text) if native else " ".join(text.split())):
                        out.add((sid, field, "form", CHAR, None))
                    if native:
                        out |= {(sid, field, "name window", win, None) for win in name_windows(text) if win[2] in middles or win[2] in _STROKES or not _PLAIN.match(win[2])}
                    else:
                        out |= {(sid, field, "name", _name_key(w), None) for w in text.split()}
                elif native:
                    s = unspaced(text.split("\n"))
                    out |= {(sid, field, "window", s[i - 2 : i + 3], None) for i in range(2, len(s) - 2) if s[i] in middles or _is_stroke(s, i)}
                else:
                    words, divided = latin_words(text.split("\n"))
                    for _, w in words:
                        if _is_name(w):
                            continue
                        if w[:1].isupper() and re.search(r"[0-9!|($@]", w) and re.search(r"[a-z]", w):
                            out.add((sid, field, "name", _name_key(w), None))
                        if w.lower() not in skip:
                            out.add((sid, field, "word", w.lower(), w))
                    for a, b in divided:
                        out.add((sid, field, "divided", a.lower(), b.lower()))
                        joined = a + b
                        if not _is_name(joined):
                            out.add((sid, field, "word", joined.lower(), joined))
                            out.add((sid, field, "word", (a + "-" + b).lower(), None))
            rows = list(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[j] for r in rows], pa.string()) for j in range(1, 5)],
                names=["segment_id", "text_field", "what", "a", "b"],
            )

    return texts.select("segment_id", "text_field", "unspaced", "lines").mapInArrow(run, _HITS)


class NoiseModel:
    """The corpus models of one table of segments, written to the shared folder."""

    def __init__(self, segments: DataFrame) -> None:
        segments = segments.select("segment_id", "volume", "source_page", "body_text", "header_ocr", "text_content")
        self.volumes = materialize(volume_model(segments), "volumes")
        # a volume's model has twenty headers of sixty characters at most; a table of too many volumes is joined by key
        if self.volumes.count() <= BROADCAST_VOLUMES:
            segments = segments.join(F.broadcast(self.volumes), "volume", "left")
        else:
            segments = skew_lookup(segments, self.volumes, "volume", "left")
        self.texts = materialize(stripped(segments), "stripped")
        self.counts = materialize(corpus_counts(self.texts), "ocr-counts")
        self.repairs = materialize(word_repairs(self.counts), "word-repairs")
        confusions = materialize(character_confusions(self.counts), "confusions")
        self.windows = materialize(misread_windows(self.counts, confusions), "windows")
        self.names = materialize(word_repairs(self.counts, NAME_RATIO, "n"), "name-repairs")
        self.name_windows = materialize(misread_windows(self.counts, confusions, what="h"), "name-windows")
        # at most one row per character of the script
        self.middles = frozenset(r["x"] for r in confusions.select("x").distinct().collect())
        # the commonest words are never misreadings of others; leaving them out of the look-up only saves its cost
        words = self.counts.where("what = 'w'").select(F.col("key").alias("read"), "n")
        common = words.join(self.repairs, "read", "left_anti").orderBy(F.col("n").desc(), "read").limit(COMMON_WORDS)
        self.common = frozenset(r["read"] for r in common.select("read").collect())
        self.hits = materialize(_read_fields(self.texts, self.common, self.middles), "ocr-hits")


def divided_words(model: NoiseModel) -> DataFrame:
    """(a, b, written): each divided pair of parts and whether the word is 'joined' or written with a 'hyphen' otherwise."""
    parts = model.hits.where("what = 'divided'").select("a", "b").distinct()
    words = model.counts.where("what = 'w'").select(F.col("key").alias("w"), "n")
    j, h = F.concat("a", "b"), F.concat("a", F.lit("-"), "b")
    seen = parts.withColumns({"j": j, "h": h}).join(words.select(F.col("w").alias("j"), F.col("n").alias("nj")), "j", "left").join(words.select(F.col("w").alias("h"), F.col("n").alias("nh")), "h", "left")
    fixed = seen.join(model.repairs.select(F.col("read").alias("j"), F.col("word").alias("fj")), "j", "left").join(model.repairs.select(F.col("read").alias("h"), F.col("word").alias("fh")), "h", "left")
    nj, nh = F.coalesce("nj", F.lit(0)), F.coalesce("nh", F.lit(0))
    hyphenated = (nh > nj) | ((nj == 0) & (nh == 0) & F.col("fj").isNull() & F.coalesce(F.col("fh").contains("-"), F.lit(False)))
    return fixed.select("a", "b", F.when(hyphenated, "hyphen").otherwise("joined").alias("written"))


def noise_found(segments: DataFrame) -> DataFrame:
    """(segment_id, text_field, noise_kind): one row per kind of noise in a field.

    Null and empty fields have none; segments detected twice are judged each for itself.  Whole texts are read.
    """
    model = NoiseModel(segments)
    hits = model.hits
    out = model.texts.select("segment_id", "text_field", F.explode("kinds").alias("noise_kind"))
    # a form of strokes has its printed character in the table of confusions
    out = out.unionByName(hits.where("what = 'form'").select("segment_id", "text_field", F.col("a").alias("noise_kind")))
    words = hits.where("what = 'word'").join(model.repairs.select(F.col("read").alias("a")), "a", "left_semi")
    wins = hits.where("what = 'window'").join(model.windows.select(F.col("window").alias("a")), "a", "left_semi")
    parts = hits.where("what = 'divided'").join(divided_words(model).where("written = 'joined'").select("a", "b"), ["a", "b"], "left_semi")
    names = hits.where("what = 'name'").join(model.names.select(F.col("read").alias("a")), "a", "left_semi")
    name_wins = hits.where("what = 'name window'").join(model.name_windows.select(F.col("window").alias("a")), "a", "left_semi")
    for rows, kind in ((words, CHAR), (wins, CHAR), (names, CHAR), (name_wins, CHAR), (parts, HYPHEN)):
        out = out.unionByName(rows.select("segment_id", "text_field", F.lit(kind).alias("noise_kind")))
    return out.distinct()


def repair_text(lines: list[str], native: bool, words: dict[str, str], windows: dict[str, str], hyphened: set[tuple[str, str]]) -> str:
    """One continuous paragraph of ``stripped`` lines: divided words joined, misread words and characters replaced."""
    if native:
        s = unspaced(lines)
        return "".join(windows.get(s[i - 2 : i + 3], s[i]) for i in range(2, len(s) - 2))
    tokens = [t for line in lines for t in [*line.split(), "\n"]]
    joined: list[str] = []
    k = 0
    while k < len(tokens):
        t = tokens[k]
        if t != "\n" and len(t) > 1 and t[-1] in _MARKS and re.search("[A-Za-z]", t):
            rest = k + 1
            while rest < len(tokens) and tokens[rest] == "\n":
                rest += 1
            if rest > k + 1 and rest < len(tokens):
                pair = (t[:-1].lstrip("\"'“”‘’").lower(), _token(tokens[rest]).lower())
                joined.append(t[:-1] + ("-" if pair in hyphened else "") + tokens[rest])
                k = rest + 1
                continue
        if t != "\n":
            joined.append(t)
        k += 1
    out = []
    for t in joined:
        w = _token(t)
        fix = words.get(w.lower())
        if fix and not _is_name(w):
            out.append(t.replace(w, fix.capitalize() if w[:1].isupper() else fix, 1))
        else:
            out.append(t)
    return " ".join(out)


def repair_header(rest: str, words: dict[str, str], windows: dict[str, str]) -> str:
    """The name in an entry's ``stripped`` header, misread words and characters replaced."""
    if _is_native(rest):
        return "".join(windows.get(win, win[2]) for win in name_windows(rest))
    out = []
    for w in rest.split():
        key = _name_key(w)
        fix = words.get(key)
        w = printed_word(w) if fix is None else w
        out.append(w if fix is None else (fix.upper() if w.isupper() else "-".join(p.capitalize() for p in fix.split("-"))) + w[len(key) :])
    return " ".join(out)


def repaired(segments: DataFrame) -> DataFrame:
    """(segment_id, text_field, repaired_text) of every non-null body text, text content and entry header.

    The repairs a segment needs are joined to it, so no table of repairs is sent to every task.
    """
    model = NoiseModel(segments)
    hits = model.hits
    w = hits.where("what = 'word'").join(model.repairs.withColumnRenamed("read", "a"), "a").select("segment_id", F.lit("w").alias("t"), F.col("a").alias("x"), F.col("word").alias("y"))
    j = hits.where("what = 'window'").join(model.windows.withColumnRenamed("window", "a"), "a").select("segment_id", F.lit("j").alias("t"), F.col("a").alias("x"), F.col("d").alias("y"))
    h = hits.where("what = 'divided'").join(divided_words(model).where("written = 'hyphen'").select("a", "b"), ["a", "b"]).select("segment_id", F.lit("h").alias("t"), F.col("a").alias("x"), F.col("b").alias("y"))
    n = hits.where("what = 'name'").join(model.names.withColumnRenamed("read", "a"), "a").select("segment_id", F.lit("n").alias("t"), F.col("a").alias("x"), F.col("word").alias("y"))
    nj = hits.where("what = 'name window'").join(model.name_windows.withColumnRenamed("window", "a"), "a").select("segment_id", F.lit("nj").alias("t"), F.col("a").alias("x"), F.col("d").alias("y"))
    fixes = w.unionByName(j).unionByName(h).unionByName(n).unionByName(nj).groupBy("segment_id").agg(F.collect_set(F.struct("t", "x", "y")).alias("fixes"))
    src = model.texts.select("segment_id", "text_field", "unspaced", "lines").join(fixes, "segment_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                of = lambda t: {f["x"]: f["y"] for f in r["fixes"] or [] if f["t"] == t}  # noqa: B023, E731
                if r["text_field"] == "header_ocr":
                    text = repair_header(r["lines"], of("n"), of("nj"))
                else:
                    hyphened = {(f["x"], f["y"]) for f in r["fixes"] or [] if f["t"] == "h"}
                    text = repair_text(r["lines"].split("\n"), r["unspaced"], of("n") | of("w"), of("j"), hyphened)
                rows.append((r["segment_id"], r["text_field"], text))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.string())], names=["segment_id", "text_field", "repaired_text"])

    return src.mapInArrow(run, "segment_id bigint, text_field string, repaired_text string")
