"""Noise in text from scanned pages: broken words, misread characters, running heads, page numbers.

Furniture (running heads, page numbers) is told by form and by recurrence over
files. Words broken at line ends are joined unless the corpus writes them with
the hyphen. Skip-gram vectors are learned over all texts; words are linked to
much more frequent words that differ by plausible glyph edits, and an
occurrence is taken as misread if its context fits the frequent word. Last,
furniture is dropped and the lines are reflowed into paragraphs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans import lineage

# What scanners confuse, as (seen, true). Each holds in words; pairs of a digit and a letter also in numbers.
GLYPHS = [
    ("rn", "m"), ("m", "rn"), ("m", "in"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("vv", "w"), ("w", "vv"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("v", "y"), ("y", "v"),
    ("l", "i"), ("i", "l"), ("q", "g"), ("g", "q"), ("ʗ", "c"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("2", "z"), ("3", "s"),
    ("b", "ß"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("ii", "ü"),
]
# Chinese characters of like shape, in groups.
LIKE = """根恨 日曰臼 法怯 素索 水氷永 酮酬 桃挑 柱拄 测侧则 土士 织职 包泡 活恬 抗杭 析折 批挑 白臼 胞泡 天夭夫 未末 己已巳 人入八 大太犬 木本术 王玉主 田由甲申 干千于 目自 白百 贝见 刀力 戊戌戍 侯候 拨拔 晴睛清情 冶治 暑署 栽载裁
辩辨 经径 待侍 诸储 微徽 洒酒 茶荼 粱梁 崇祟 兔免 鸟乌 戒戎 壁璧 萤莹 赢羸 亨享 斤斥 历厉 仑仓 今令 代伐 车东 牛午 矢失 无元 开井 几儿 九丸 了子 习刁 久欠 技枝 皮度 桑柔 柏相 伯佰 作昨 检捡 拮桔 楼搂 样徉 板扳 枚牧 批枇
验险 极级 组姐 细绌 给绐 纸低 绍绐 复夏 提堤 拓柘 杯坏 场扬汤 均钧 取职 耳且 具县 重熏 量童 毒每 海侮 油抽 泊伯 洁浩 深探 浸侵 液掖 涂徐 淀绽 混棍 温湿 溶熔 滴摘 漂飘 准淮 冷泠 减咸 叶汁 含舍 合台 各名 向问 同间 后石 右石 在左 标际 棵裸 植值 椒淑 椹堪 榕容
药约 菌茵 苷苦 苯笨 茎荃 草革 荒慌 营宫 蒸煞 薄簿 藤滕 胞饱 肝肚 胶较 脱悦 脂指 膜模 度席 质贡 负贞 责贵 货贷 账帐 距钜 跟银 辐幅 软钦 轻经 迁迂 进井 过讨 运远 透诱 部陪 配酌 酸酡 醇醉 里甲 针钎 钙钓 铅沿 铜钢 银很 锌辞 镜境 间问 阳阴 限恨 院皖 除徐 难滩 雨两 零雳 需雷 青责 项顶 预顶 题颗 风凤 食良 首育 高亭 鱼鲁 黄寅""".split()
_CJK = "㐀-䶿一-鿿"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+(?:['’][^\W_{_CJK}]+)?")
#: A bracket that is never closed, before or within a word, is a c read wrongly; it goes on as a letter of its own.
_BRACKET = re.compile(r"(?:(?<=[a-zäöü])\(|\((?=[a-zäöü]{2}))(?![^()]{0,160}\))")
_HYPHENS = "-­¬‐‑"
_BREAK = re.compile(rf"([^\W\d_{_CJK}]+)[{_HYPHENS}][ \t]*\Z")
_HEAD = re.compile(rf"[ \t]*([^\W\d_{_CJK}]+)")
_COMPOUND = re.compile(rf"(?<![^\W_{_CJK}])[^\W_{_CJK}]++(?:[-‐‑][^\W_{_CJK}]++)+")
_PAGED = re.compile(r"(?:(?P<a>\d{1,5})[ \t　]{2,}(?P<b>\S.*?)|(?P<c>\S.*?)[ \t　]{2,}(?P<d>\d{1,5}))\Z")
_PAGE = re.compile(
    r"(?:(?:page|seite|p\.|s\.|pg\.?)\s*\d{1,5}(?:\s*(?:of|von|/)\s*\d{1,5})?|第\s*\d{1,5}\s*页(?:\s*[,，/]?\s*共\s*\d{1,5}\s*页)?|\d{1,5}\s*/\s*\d{1,5}|[-–—~·•*|\[(<{]+\s*\d{1,5}\s*[-–—~·•*|\])>}]+|\d{1,4})\Z", re.I
)
_ROMAN = re.compile(r"(?=[ivxlcdm])m*(?:c{0,4}|cd|d?c{0,4}|cm)(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})\Z")
_VOLUME = re.compile(r",?\s*(?:(?:Vol|Bd|Jg)\.?\s*\d+(?:\s*\(\d{4}\))?|第\s*\d+\s*[卷期](?:\s*第?\s*\d+\s*期)?|\d{1,4}(?:\s*\(\d{4}\))?)\Z", re.I)
_AUTHORS = re.compile(rf"(?:[A-ZÄÖÜ][\w'’-]+(?:,? (?:and|und|&) [A-ZÄÖÜ][\w'’-]+)|[A-ZÄÖÜ][\w'’-]+ et al\.?|[{_CJK}]{{2,4}}等)\Z")
_SECTION = re.compile(r"(?:\d+(?:\.\d+)*\.?\s+\S|(?:table|tab\.|fig|abb|图|表|附录|续表))", re.I)
_GLYPH_FOLD = str.maketrans("01583lI|", "olsbsiii")
RATIO, SHORT_RATIO = 6, 20


def _fold(text: str) -> str:
    """text without case, blanks and the differences scanners make."""
    return re.sub(r"\W+", "", _BRACKET.sub("c", unicodedata.normalize("NFKC", text)).lower().translate(_GLYPH_FOLD).replace("rn", "m").replace("cl", "d").replace("ii", "u"))


def _core(line: str) -> tuple[str, bool]:
    """What a line says besides a page number set off by blanks, and whether it has one."""
    m = _PAGED.match(line.strip())
    core = (m["b"] or m["c"]).strip() if m else line.strip()
    return core, bool(m) and len(re.findall(rf"[A-Za-zäöüß{_CJK}]", core)) >= 3


def is_page_number(line: str, page: str | None) -> bool:
    s = unicodedata.normalize("NFKC", line).strip()
    if not s:
        return False
    if s.isdigit():
        near = [int(x) for x in re.findall(r"\d+", page or "")]
        # A bare number is a page number if it lies in the pages of the piece, where these are known.
        return len(s) <= 4 and (not near or min(near) - 1 <= int(s) <= max(near) + 1)
    return bool(_PAGE.match(s) or (s.islower() and _ROMAN.match(s) and len(s) > 1))


def _sentence_like(core: str) -> bool:
    return core[-1:] in ".。,，;；:：!！?？、" and not core.endswith("al.")


def header_cores(lines: list[str], title: str | None) -> list[tuple[int, str, str]]:
    """(line, folded core without volume, form) of lines that might be running heads; form is sure, paged or plain."""
    out, folded = [], _fold(title or "")
    for i, line in enumerate(lines):
        if not line.strip() or len(line) > 160:
            continue
        core, paged = _core(line)
        if _sentence_like(core) or _SECTION.match(core) or not re.search(rf"[A-Za-z{_CJK}]", core):
            continue
        name = _fold(_VOLUME.sub("", core))
        nxt = next((x.strip() for x in lines[i + 1:i + 2]), "")
        if len(folded) > 5 and _fold(core) == folded or _AUTHORS.match(core) and not nxt.startswith("("):
            out.append((i, name, "sure"))
        elif len(name) >= 3:
            out.append((i, name, "paged" if paged else "plain"))
    return out


class Page:
    """A text as lines without furniture, its broken words and its tokens."""

    def __init__(self, text: str, page: str | None, heads: Iterable[int]) -> None:
        self.lines = _BRACKET.sub("ʗ", text).split("\n")
        self.heads = set(heads)
        self.pages = {i for i, s in enumerate(self.lines) if i not in self.heads and is_page_number(s, page)}
        self.next: dict[int, int] = {}
        furniture, last = self.heads | self.pages, None
        self.body = []
        for i, s in enumerate(self.lines):
            if i in furniture:
                continue
            if not s.strip():
                # A blank line beside furniture is part of the page break.
                if any(j in furniture for j in (i - 1, i + 1)):
                    continue
                last = None
                continue
            if last is not None:
                self.next[last] = i
            last = i
            self.body.append(i)

    def breaks(self) -> Iterator[tuple[int, str, str]]:
        """(line, left, right) of words cut at a line end by a hyphen."""
        for i, j in self.next.items():
            a, b = _BREAK.search(self.lines[i].rstrip("\r")), _HEAD.match(self.lines[j])
            if a and b:
                yield i, a.group(1), b.group(1)

    def words(self) -> tuple[list[str], list[int], list[int], list[int]]:
        """Tokens in lower case with broken words joined; the line of each, the line of its second part or -1, the letters of its first part or 0."""
        words: list[str] = []
        lines: list[int] = []
        joins: list[tuple[int, int, int]] = []  # place of the token, second line, letters before the break
        joined = {i: (left, right) for i, left, right in self.breaks()}
        skip = 0
        for i in self.body:
            line = self.lines[i].rstrip("\r")
            start, skip = skip, 0
            found = _TOKEN.findall(line if line.isascii() else unicodedata.normalize("NFC", line), start)
            if i in joined:
                left, right = joined[i]
                if found and found[-1].endswith(left):
                    found[-1] += right
                    joins.append((len(words) + len(found) - 1, self.next[i], len(left)))
                    skip = _HEAD.match(self.lines[self.next[i]]).end()
            words += map(str.lower, found)
            lines += [i] * len(found)
        seconds, lefts = [-1] * len(words), [0] * len(words)
        for k, j, n in joins:
            seconds[k], lefts[k] = j, n
        return words, lines, seconds, lefts


def _iter_pages(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Page]]:
    for b in batches:
        for k, t, p, h in zip(b["chunk_index"], b["text"], b["page"], b["heads"]):
            yield k, Page(t, p, () if h is None else h)


def running_heads(rows: DataFrame, files: int = 2) -> DataFrame:
    """(chunk_index, heads): the lines of each row that are running heads.

    A line is one if it repeats the title or names authors, if it carries a page
    number set off by blanks, or if its words are seen so in other files.
    """

    def cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, f, *c) for k, f, t, title in zip(b["chunk_index"], b["filename"], b["text"], b["title"]) for c in header_cores(t.split("\n"), title)]
            yield pd.DataFrame(out, columns=["chunk_index", "filename", "line_no", "core", "form"]).astype({"chunk_index": "int64", "line_no": "int32"})

    few = lineage.written(rows.select("chunk_index", "filename", "text", "title").mapInPandas(cores, "chunk_index bigint, filename string, line_no int, core string, form string"), "cores")
    known = few.where("form = 'paged'").groupBy("core").agg(F.countDistinct("filename").alias("n")).where(f"n >= {files}").select("core")
    sure = few.where("form <> 'plain'").select("chunk_index", "line_no")
    seen = few.where("form = 'plain'").join(known, "core", "left_semi").select("chunk_index", "line_no")
    return sure.unionAll(seen).groupBy("chunk_index").agg(F.collect_set("line_no").alias("heads"))


def read_pages(pages: DataFrame) -> DataFrame:
    """Each text taken apart once: (chunk_index, words, lines, seconds, lefts, compounds, breaks, heads, numbers), written.

    words are its tokens, lines the line of each, seconds the line on which its
    second part stands or -1, lefts the letters of its first part; compounds are
    words written with hyphens, breaks the (line, own, joined) of words cut at a
    line end, heads and numbers the lines that are furniture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few hundred texts at a time, so that a task holds the words of no more than these.
            for at in range(0, batch.num_rows, 500):
                yield _taken_apart(batch.slice(at, 500))

    schema = "chunk_index bigint, words array<string>, lines array<int>, seconds array<int>, lefts array<int>, compounds array<string>, breaks array<struct<line: int, own: string, joined: string>>, heads array<int>, numbers array<int>"
    return lineage.written(pages.select("chunk_index", "text", "page", "heads").mapInArrow(run, schema), "read")


def _taken_apart(batch: pa.RecordBatch) -> pa.RecordBatch:
    flat: dict[str, list] = {c: [] for c in ("words", "lines", "seconds", "lefts", "compounds", "heads", "numbers", "line", "own", "joined")}
    ends: dict[str, list[int]] = {c: [0] for c in ("words", "compounds", "breaks", "heads", "numbers")}
    for text, page, heads in zip(*(batch.column(c).to_pylist() for c in ("text", "page", "heads"))):
        p = Page(text, page, heads or ())
        for c, values in zip(("words", "lines", "seconds", "lefts"), p.words()):
            flat[c] += values
        flat["compounds"] += [w.lower().replace("‐", "-").replace("‑", "-") for i in p.body if re.search("[-‐‑]", p.lines[i]) for w in _COMPOUND.findall(p.lines[i])]
        for i, a, z in p.breaks():
            flat["line"].append(i)
            flat["own"].append(f"{a}-{z}".lower())
            flat["joined"].append(f"{a}{z}".lower())
        flat["heads"] += sorted(p.heads)
        flat["numbers"] += sorted(p.pages)
        for c in ends:
            ends[c].append(len(flat["line" if c == "breaks" else c]))
    ints, text = pa.int32(), pa.string()
    lists = lambda c, values: pa.ListArray.from_arrays(pa.array(ends[c], ints), values)
    breaks = pa.StructArray.from_arrays([pa.array(flat["line"], ints), pa.array(flat["own"], text), pa.array(flat["joined"], text)], ["line", "own", "joined"])
    return pa.RecordBatch.from_arrays(
        [batch.column("chunk_index"), lists("words", pa.array(flat["words"], text)), *[lists("words", pa.array(flat[c], ints)) for c in ("lines", "seconds", "lefts")],
         lists("compounds", pa.array(flat["compounds"], text)), lists("breaks", breaks), lists("heads", pa.array(flat["heads"], ints)), lists("numbers", pa.array(flat["numbers"], ints))],
        ["chunk_index", "words", "lines", "seconds", "lefts", "compounds", "breaks", "heads", "numbers"])


def _counts(read: DataFrame) -> DataFrame:
    """(word, n, n_joined) over all texts: words and words with their hyphens, and how often a word is joined from two lines."""
    whole = read.select(F.explode(F.arrays_zip("words", "seconds")).alias("x")).select(F.col("x.words").alias("word"), (F.col("x.seconds") < 0).cast("bigint").alias("n"), (F.col("x.seconds") >= 0).cast("bigint").alias("n_joined"))
    hyphened = read.select(F.explode("compounds").alias("word"), F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("n_joined"))
    return lineage.written(whole.unionAll(hyphened).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_joined").alias("n_joined")), "words")


def broken_words(read: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_index, line_no) of words cut at a line end; not where the corpus writes the word with its hyphen more often than without."""
    found = read.select("chunk_index", F.inline("breaks"))
    known = words.where("n > 0")
    return (
        found.join(known.select(F.col("word").alias("own"), F.col("n").alias("n_own")), "own", "left")
        .join(known.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left")
        .where("coalesce(n_own, 0) <= coalesce(n_joined, 0)")
        .select("chunk_index", F.col("line").alias("line_no"))
    )


def glyph_edits(word: str) -> set[str]:
    """Words that a scanner may have turned into this one: one confusion, at one or all of its places."""
    one = set()
    for seen, true in GLYPHS:
        at = word.find(seen)
        if at >= 0 and word.count(seen) > 1:
            one.add(word.replace(seen, true))
        while at >= 0:
            one.add(word[:at] + true + word[at + len(seen):])
            at = word.find(seen, at + 1)
    return one - {word}


_LIKE = {c: set(g) - {c} for g in LIKE for c in g}
for _g in LIKE:
    for _c in _g:
        _LIKE[_c] = _LIKE[_c] | (set(_g) - {_c})


def links(words: DataFrame) -> DataFrame:
    """(word, true, n, n_true): words and the much more frequent words they may stand for.

    words has word, n and n_joined. A word longer than all that are frequent
    enough to be meant, by more than a confusion can add, has no link.
    """
    longest = (words.where(f"n >= {min(RATIO, 4)}").agg(F.max(F.length("word"))).first()[0] or 0) + 2

    def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, n in zip(b["word"], b["n"]):
                if len(w) == 1:
                    out += [(w, c, n) for c in _LIKE.get(w, ())]
                else:
                    out += [(w, c, n) for c in glyph_edits(w)]
            yield pd.DataFrame(out, columns=["word", "true", "n"]).astype({"n": "int64"})

    own = words.where(~F.contains("word", F.lit("-")) & (F.length("word") <= _doubled(longest)) & ~F.col("word").rlike(r"^\p{Nd}{2,}$")).select("word", (F.col("n") + F.col("n_joined")).alias("n"))
    known = words.where("n >= 4").select(F.col("word").alias("true"), F.col("n").alias("n_true"))
    short = F.when(F.length("word") >= 6, RATIO).otherwise(SHORT_RATIO)
    return (
        own.mapInPandas(edits, "word string, true string, n bigint").join(known, "true")
        .where((F.col("n_true") >= F.col("n") * short) & ~F.col("true").rlike(r"^\d"))
    )


def _doubled(n: int) -> int:
    """The longest form that a word of n characters can be read as: every character as two."""
    return 2 * n


def skip_grams(read: DataFrame, least: int, total: int, dim: int = 32, only: set[str] | None = None) -> dict[str, np.ndarray]:
    """Skip-gram vectors of all words seen at least that often, or of those of them in only, of unit length.

    They are learned from every text. The passes over the texts run in as many
    parts as the words ask for.
    """
    text = read.select(F.col("words").alias("seq"))
    if only is not None:
        kept = read.sparkSession.sparkContext.broadcast(only)

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep = pa.array(sorted(kept.value))
            for b in batches:
                lists = b.column("seq")
                flat = lists.flatten()
                hit = pc.is_in(flat, value_set=keep)
                ends = np.concatenate([[0], np.cumsum(hit.to_numpy(zero_copy_only=False))])
                at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends[at], pa.int32()), flat.filter(hit))], ["seq"])

        text = text.mapInArrow(known, "seq array<string>")
    text = text.where("size(seq) > 1")
    if text.isEmpty():
        return {}
    parts = int(min(64, max(8, total // 3_000_000)))
    model = Word2Vec(vectorSize=dim, minCount=least, numPartitions=parts, maxIter=1, windowSize=3, stepSize=0.05, seed=3, inputCol="seq", outputCol="v").fit(text)
    got = {r["word"]: r["vector"].toArray().astype(np.float32) for r in model.getVectors().toLocalIterator()}
    return {w: v / (np.linalg.norm(v) + 1e-9) for w, v in got.items()}


#: Words rarer than this share of all words have a vector only if words are linked to them, so the driver and the tasks hold at most 1 / RARE words and the linked ones.
RARE = 5e-6
#: Words seen less often have no vector, however small the table. Below the number that a short word needs for a link.
LEAST = 10
#: Suspect words that are sent to all tasks at most; more meet the words of the texts in a shuffle.
SENT = 1_000_000
AROUND = 4
_ALNUM = re.compile(r"(?:[a-zäöüß]{2,}[01589][a-zäöüß]*|[01589][a-zäöüß]{3,})\Z")
_BAD_NUMBER = re.compile(r"(?=[\dolis]*\d)(?=[\dolis]*[olis])[\dolis]{2,}\Z")


_AS_DIGITS, _AS_LETTERS = str.maketrans("olis", "0115"), str.maketrans("015893", "olsbgs")


def _plain(word: str) -> str | None:
    """A number without its letters, or a word without its digits; None for all else."""
    return word.translate(_AS_DIGITS) if _BAD_NUMBER.match(word) else word.translate(_AS_LETTERS) if _ALNUM.match(word) else None


def known_codes(words: DataFrame, linked: DataFrame, total: int) -> DataFrame:
    """(word): forms of letters and digits that the corpus writes often, and neither a word linked to them nor their plain form RATIO times as often."""

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(plain=[_plain(w) for w in b["word"]])

    often = words.where((F.col("n") >= max(20, 1e-6 * total)) & F.col("word").rlike(r"[0-9]") & F.col("word").rlike(r"[a-z]"))
    often = often.select("word", "n").mapInPandas(plain, "word string, n bigint, plain string").join(linked.select("word"), "word", "left_anti")
    return often.join(words.select(F.col("word").alias("plain"), F.col("n").alias("n_plain")), "plain", "left").where(F.coalesce("n_plain", F.lit(0)) < F.col("n") * RATIO).select("word")


def _suspects(words: DataFrame, linked: DataFrame, usual: DataFrame) -> DataFrame:
    """(word, n, trues, plain): words that may be misread, with the words they may stand for and their plain form, if any."""

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(w, n, x) for w, n in zip(b["word"], b["n"]) if (x := _plain(w)) is not None]
            yield pd.DataFrame(out, columns=["word", "n", "plain"]).astype({"n": "int64"})

    mixed = words.where(F.col("word").rlike("[0-9]")).select("word", "n").mapInPandas(plain, "word string, n bigint, plain string").join(usual, "word", "left_anti")
    by_glyph = linked.groupBy("word").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("true")).alias("trues"))  # as many as a word has edits
    both = by_glyph.join(mixed.select("word", F.col("n").alias("_n"), "plain"), "word", "full")
    return both.select("word", F.coalesce("n", "_n").alias("n"), F.coalesce("trues", F.array().cast("array<string>")).alias("trues"), "plain")


def misread(read: DataFrame, words: DataFrame, fit: float = 0.12, margin: float = 0.1, alike: float = 0.8) -> DataFrame:
    """(chunk_index, line_no, seen, true) of misread words and numbers; true in lower case.

    A linked word counts where its context fits the frequent word: the mean
    similarity of their vectors is at least fit. A word whose share of all words
    is RARE or more counts where the context fits the other by margin
    more, or if both are used alike. Letters among digits, and digits among small
    letters, count by themselves unless the form is a known code.

    The places of suspect words are found by a join and judged one by one, each
    with the words around it; only vectors are held by the tasks.
    """
    spark = read.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, int(RARE * total))
    linked = lineage.written(links(words), "links")
    only = None
    if least > LEAST:
        only = {r["word"] for r in words.where(F.col("n") >= least).select("word").toLocalIterator()}
        only |= {r["true"] for r in linked.where(F.col("n_true") >= LEAST).select("true").distinct().toLocalIterator()}
    sent = spark.sparkContext.broadcast(skip_grams(read, LEAST, total, only=only))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = sent.value

        def judged(word: str, n: int, trues: list[str], around: list[str]) -> str | None:
            near = [v for t in around if (v := vectors.get(t)) is not None]
            mean, best, top = (np.mean(near, axis=0) if near else None), None, -2.0
            mine = vectors.get(word) if n >= least else None
            for c in trues:
                v = vectors.get(c)
                if v is None:  # too rare for a vector: only a long word is taken on its glyphs alone
                    s, ok = 0.0, len(word) >= 6
                else:
                    s = float(mean @ v) if mean is not None else 0.0
                    ok = s >= fit if mine is None else mean is not None and s - float(mean @ mine) >= margin or float(mine @ v) >= alike
                if ok and s > top:
                    best, top = c, s
            return best

        for b in batches:
            out = []
            for k, word, n, trues, plain, before, after, i, j, left in zip(*(b[c] for c in ("chunk_index", "word", "n", "trues", "plain", "before", "after", "line", "second", "left"))):
                true = judged(word, n, trues, [*before, *after]) if len(trues) else None
                true = plain if true is None else true
                if true is not None:
                    out.append((k, i if j < 0 else _part(word, true, left, i, j), word, true))
            yield pd.DataFrame(out, columns=["chunk_index", "line_no", "seen", "true"]).astype({"chunk_index": "int64", "line_no": "int32"})

    suspects = lineage.written(_suspects(words, linked, known_codes(words, linked, total)), "suspects")
    places = read.select("chunk_index", "words", "lines", "seconds", "lefts", F.posexplode("words").alias("at", "word"))
    met = places.join(F.broadcast(suspects) if suspects.count() <= SENT else suspects, "word").select(
        "chunk_index", "word", "n", "trues", "plain",
        F.slice("words", F.greatest(F.col("at") + 1 - AROUND, F.lit(1)), F.least(F.col("at"), F.lit(AROUND))).alias("before"), F.slice("words", F.col("at") + 2, AROUND).alias("after"),
        F.get("lines", "at").alias("line"), F.get("seconds", "at").alias("second"), F.get("lefts", "at").alias("left"))
    return met.mapInPandas(judge, "chunk_index bigint, line_no int, seen string, true string").distinct()


def _part(seen: str, true: str, left: int, first: int, second: int) -> int:
    """The line on which a misread broken word is wrong."""
    at = next((k for k, (x, y) in enumerate(zip(seen, true)) if x != y), min(len(seen), len(true)))
    return first if at < left else second


def _prepared(rows: DataFrame) -> DataFrame:
    few = rows.select(F.col("chunk_index").cast("bigint").alias("chunk_index"), "filename", "title", "text", "page").where("chunk_index is not null and text rlike '[^\\\\s]'")
    return lineage.written(few.join(running_heads(few), "chunk_index", "left"), "pages")


def noise(rows: DataFrame) -> DataFrame:
    """(chunk_index, line_no, noise): hyphen, misread, running_header and page_number for each noisy line.

    rows has chunk_index, filename, title, text and page; other columns are
    ignored. Null and blank texts have no noise; null titles, files and pages
    only leave out what they would tell. Repeated rows give repeated results.
    """
    read = read_pages(_prepared(rows))
    words = _counts(read)
    furniture = [read.select("chunk_index", F.explode(c).alias("line_no"), F.lit(n).alias("noise")) for c, n in (("heads", "running_header"), ("numbers", "page_number"))]
    broken = broken_words(read, words).withColumn("noise", F.lit("hyphen"))
    wrong = misread(read, words).select("chunk_index", "line_no").withColumn("noise", F.lit("misread"))
    return reduce(DataFrame.unionAll, [*furniture, broken, wrong]).withColumn("line_no", F.col("line_no").cast("bigint")).distinct()


def _cased(seen: str, true: str) -> str:
    return true.upper() if len(seen) > 1 and seen.isupper() else true[:1].upper() + true[1:] if seen[:1].isupper() else true


def reflowed(p: Page, broken: set[int], fixes: list[tuple[str, str]]) -> str:
    """The text of a page as paragraphs: words corrected and joined, furniture gone, one line each paragraph."""
    paragraphs: list[str] = []
    held, last = "", None
    for i in p.body:
        line = p.lines[i].strip()
        if last is None or p.next.get(last) != i:
            paragraphs.append("")
            held = ""
        if last is not None and last in broken and held and p.next.get(last) == i:
            paragraphs[-1] = _BREAK.sub(lambda m: m.group(1), paragraphs[-1]) + line
        elif not paragraphs[-1] or re.search(rf"[-{_CJK}。，；：！？、）》”]\Z", paragraphs[-1]):
            paragraphs[-1] += line
        else:
            paragraphs[-1] += " " + line
        held, last = line, i
    wrong = dict(fixes)
    out = "\n\n".join(_TOKEN.sub(lambda m: _cased(m.group(0), wrong[m.group(0).lower()]) if m.group(0).lower() in wrong else m.group(0), x) for x in paragraphs)
    return out.replace("ʗ", "c")


def repaired(rows: DataFrame) -> DataFrame:
    """(chunk_index, text): every text as continuous paragraphs; null and blank texts stay as they are.

    Tables and lists lose their line breaks within a paragraph as text does. A
    correction holds for all places of its word in the row.
    """
    pages = _prepared(rows)
    read = read_pages(pages)
    words = _counts(read)
    cut = broken_words(read, words).groupBy("chunk_index").agg(F.collect_set("line_no").alias("broken"))
    wrong = misread(read, words).groupBy("chunk_index").agg(F.collect_set(F.struct("seen", "true")).alias("fixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for (k, p), cuts, fixes in zip(_iter_pages(iter([b])), b["broken"], b["fixes"]):
                pairs = [] if fixes is None else [(x["seen"], x["true"]) for x in fixes]
                out.append((k, reflowed(p, set() if cuts is None else set(cuts), pairs)))
            yield pd.DataFrame(out, columns=["chunk_index", "text"])

    clean = pages.join(cut, "chunk_index", "left").join(wrong, "chunk_index", "left").mapInPandas(run, "chunk_index bigint, text string")
    blank = rows.select(F.col("chunk_index").cast("bigint").alias("chunk_index"), "text").where("chunk_index is not null and (text is null or not text rlike '[^\\\\s]')")
    return clean.unionAll(blank)
