"""Defective prompt and response pairs, each with the type of its defect.

A suffix automaton of the prompt measures how much of the response is copied;
an automaton of refusal phrases, delimiter stacks and stopword votes tell the
other defects. Every pair is judged on its own, so nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of a refusal, words of courtesy around it, placeholders for nothing, stopwords.
REFUSALS = (
    "can't help with", "cannot help with", "unable to help", "unable to answer", "not able to answer", "not able to help", "cannot answer", "can't answer",
    "cannot give advice", "can't give advice", "cannot provide", "can't provide", "cannot assist", "can't assist", "cannot discuss", "can't discuss", "cannot comment",
    "cannot be provided", "no answer can be", "outside what i can", "outside my scope", "beyond my scope", "beyond what i can", "have to decline", "must decline",
    "refrain from", "do not permit me", "don't permit me", "not permitted to", "not allowed to", "rather not", "won't be able to", "will not be able to",
    "won't answer", "not something i can", "i have to pass",
    "无法回答", "不能回答", "无法作答", "不便作答", "不便回答", "不能提供", "无法提供", "不便提供", "恕不能", "恕难", "恕无法", "超出了我", "超出我的", "超出本",
    "帮不了", "没有办法就", "无法就", "不能就", "无可奉告", "不予回答", "不方便回答", "拒绝回答", "无法协助", "不能协助", "无法帮助", "不能帮助",
    "kann ich nicht beantworten", "kann ich nicht helfen", "nicht beantworten", "nicht weiterhelfen", "darf ich nicht", "keine auskunft", "kann ich keine", "muss ich ablehnen",
)
COURTESY = (
    "thank you", "thanks", "sorry", "apologies", "unfortunately", "feel free", "let us return", "let's return", "you could ask", "you can ask", "you may ask", "please ask", "please see", "please contact",
    "good question", "happy to help with", "anything else", "谢谢", "抱歉", "对不起", "不好意思", "很遗憾", "请咨询", "建议询问", "建议咨询", "可以继续提问", "请换一个", "欢迎继续", "其他课程问题", "您问的是一个常见问题",
    "danke", "leider", "entschuldigung", "gern", "bitte fragen", "bitte wenden",
)
NOTHING = ("null", "none", "nil", "n/a", "na", "nan", "no content", "no answer", "empty", "undefined", "tbd", "todo", "无", "空", "无内容", "暂无", "没有", "略", "keine", "leer")
STOPWORDS = {
    "en": frozenset("the a an of and or is are was were in on at for to with from by that this it its be not as which what how when why does do can if than but has have into after before only they".split()),
    "de": frozenset("der die das den dem des ein eine einer eines einem und oder ist sind war waren im in am an auf für zu zum zur mit aus von vom nicht als wie was wird wurde werden soll darf nach bei sich kann man sieht gilt trotz".split()),
}
_SAID = r"(?:\s*(?:作答|回答|答复|答|回复|写|输出|说明|解释))"
ASKED = {
    k: re.compile(rf"(?:用|以|成|译为|译成)\s*(?:{zh})|(?:{zh}){_SAID}|\b(?:in|into|using)\s+{en}\b|\b{en}\s+(?:please|answer|only|reply)\b|auf\s+{de}", re.I)
    for k, zh, en, de in (("en", "英文|英语", "english", "englisch"), ("zh", "中文|汉语", "chinese", "chinesisch"), ("de", "德文|德语", "german", "deutsch"))
}
_CJK = re.compile(r"[㐀-䶿一-鿿]")
_LATIN, _UMLAUT = re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[äöüßÄÖÜ]")
_WORD = re.compile(r"[^\W\d_㐀-䶿一-鿿]+")
_SENTENCE = re.compile(r"[^.。!！?？\n]+(?:\.(?=\d)[^.。!！?？\n]*)*[.。!！?？]*[\"”’」）)]*|[.。!！?？]+")
_TRAIL = re.compile(r"(?:\s|\[[\d,\s\-–]+\]|[（(][^（()）\n]{1,60}[)）]|[\U0001F000-\U0001FAFF☀-➿️])+\Z")
_ITEM = re.compile(r"\s*(?:\d+[.)、．]|[-*•·])\s*(.*)\Z", re.S)
_LABELLED = re.compile(r"\s*[^:：\n]{1,24}[:：]\s*\S")
_NOT_ALNUM = re.compile(r"[\W_]+")
_LABEL = re.compile(r"\A\s*[\"“「]?[^:：\n]{1,24}[:：]\s*(?=\S)")
_CONTACT = re.compile(r"(?:[\w.+-]+[@＠][\w.-]+|[\d０-９](?:[\d０-９Xx\s().\-]{4,})[\d０-９Xx])\s*\Z")
_SIGNED = re.compile(r"(?:regards|best|yours|sincerely|cheers|greetings|此致|敬上)[,，\s]", re.I)
_COUNT = re.compile(r"\b(two|three|four|five|six|seven|\d)\s+(?:main\s+|key\s+)?(?:points|steps|reasons|parts|features|items|checks)\b|([二两三四五六七]|\d)\s*[个点条项]", re.I)
_NUMERAL = {w: i for i, ws in enumerate(("", "", "two二两", "three三", "four四", "five五", "six六", "seven七")) for w in re.findall(r"[a-z]+|.", ws)}
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "」": "「", "』": "『", "”": "“", "》": "《"}
_DELIMITER = re.compile(f"[{re.escape(''.join([*_PAIRS, *_PAIRS.values()]))}]")


def automaton(text: str) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """Suffix automaton of text: transitions, suffix links and lengths of the states."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, link, length


def copied(prompt: str, response: str, least: int = 4) -> int:
    """Characters of response inside substrings of prompt of at least that length."""
    nxt, link, length = automaton(prompt)
    s = n = covered = 0
    upto = -1  # last covered place
    for i, c in enumerate(response):
        while s and c not in nxt[s]:
            s = link[s]
            n = length[s]
        if c in nxt[s]:
            s = nxt[s][c]
            n += 1
        else:
            n = 0
        if n >= least:
            covered += i - max(upto, i - n)
            upto = i
    return covered


def is_copy(prompt: str, response: str) -> bool:
    """Whether at least nine tenths of response stand in long runs of prompt (both bare).

    Only long runs count: words of the question are no copy of it. A run of
    least characters of prompt holds one of its aligned blocks of half that
    length whole, so the automaton is built only where response has such a block.
    """
    if not prompt or not response:
        return False
    least = max(min(4, len(prompt)), min(len(response), len(prompt)) // 2)
    half = (least + 1) // 2
    if not any(prompt[i:i + half] in response for i in range(0, len(prompt) - half + 1, half)):
        return False
    return copied(prompt, response, least) >= 0.9 * len(response)


def _bare(text: str) -> str:
    return _NOT_ALNUM.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


@cache
def _phrases():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("refusal", REFUSALS), ("courtesy", COURTESY)):
        for w in words:
            a.add_word(w, kind)
    a.make_automaton()
    return a


def sentences(text: str) -> list[str]:
    return [s for m in _SENTENCE.finditer(text) if (s := m.group(0).strip())]


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    bare = _bare(text)
    return not bare or bare in _nothing()


@cache
def _nothing() -> frozenset[str]:
    return frozenset(map(_bare, NOTHING))


def is_refusal(text: str) -> bool:
    """Whether every sentence refuses or is courtesy, and at least one refuses."""
    text = text.replace("’", "'")
    if not any(k == "refusal" for _, k in _phrases().iter(text.lower())):
        return False
    refused = False
    for s in sentences(text):
        kinds = {k for _, k in _phrases().iter(s.lower())}
        if "refusal" in kinds:
            refused = True
        elif "courtesy" not in kinds and _bare(s):
            return False
    return refused


def _stopword_vote(text: str) -> str | None:
    words = _WORD.findall(text.lower())
    hits = {k: sum(map(stop.__contains__, words)) for k, stop in STOPWORDS.items()}
    if not text.isascii() and _UMLAUT.search(text):
        hits["de"] += 1
    best = max(hits, key=hits.get)
    return best if hits[best] > min(hits.values()) else None


def language(text: str) -> str | None:
    """The language most of text is in: zh, en, de or None; in mixed scripts its sentences vote."""
    if text.isascii() or not (chars := len(_CJK.findall(text))):
        return _stopword_vote(text)
    if len(_LATIN.findall(text)) < chars / 2:
        return "zh"
    votes: dict[str, float] = {}
    for s in sentences(text):
        chars = len(_CJK.findall(s))
        if chars and chars * 2 >= len(_LATIN.findall(s)):
            votes["zh"] = votes.get("zh", 0) + chars * 2.5
        elif k := _stopword_vote(s):
            votes[k] = votes.get(k, 0) + len(s)
    return max(votes, key=votes.get) if votes else None


# Questions recur, so what is read from them is remembered; the number kept is bounded.
_asked_language = lru_cache(20_000)(language)
_asked_bare = lru_cache(20_000)(_bare)


def _open_delimiters(text: str) -> bool:
    """Whether a code fence, bracket or quote is still open at the end."""
    if text.count("```") % 2:
        return True
    stack = []
    for m in _DELIMITER.finditer(text):
        i, c = m.start(), m.group(0)
        if c not in _PAIRS:
            stack.append(c)
        else:
            if stack and stack[-1] == _PAIRS[c]:
                stack.pop()
            elif c == ")" and re.search(r"(?:^|\s)[\da-z]+\Z", text[max(0, i - 4):i]):
                continue  # "1)" of a list
    return bool(stack)


def is_truncated(text: str) -> bool:
    if _open_delimiters(text):
        return True
    body = _TRAIL.sub("", text)
    if not body:
        return False
    line = body.rsplit("\n", 1)[-1]
    item = _ITEM.match(line)
    lines = [x for x in body.split("\n") if x.strip()]
    if item and len(lines) > 1:
        words = item.group(1).split()
        if not words or words[-1].lower() in STOPWORDS["en"] | STOPWORDS["de"] or line.rstrip()[-1] in ",，、;；:：":
            return True
        said = [m for x in lines for m in _COUNT.finditer(x) if x.rstrip()[-1:] in ":："]
        if said:
            w = next(g for g in said[-1].groups() if g).lower()
            return sum(bool(_ITEM.match(x)) for x in lines) < (int(w) if w.isdigit() else _NUMERAL[w])
        return False
    if body[-1] in ".。!！?？":
        if body.endswith("...") or re.search(r"(?:\b(?:at|about|was|below|of|flow|to)|[约按过为在速])\s?\d+\.\Z", body):
            return not re.search(r"\b(?:in|of|as seen in|year)\s(?:19|20)\d\d\.\Z", body)
        return False
    if line.rstrip().endswith("|") and line.lstrip().startswith("|"):
        return False
    last = (sentences(line) or [line])[-1]
    if body[-1] in "…,，、;；:：-–—=({[（":
        return True
    if _CONTACT.search(last) or _SIGNED.match(last):
        return False
    if _LABELLED.match(last) and len(lines) > 1 and line.strip() == last:
        return False
    if re.match(r"\s*[💬\U0001F000-\U0001FAFF]", line):
        return False
    if body[-1] in "\"”’」』》】":
        return body[-2:-1] not in ".。!！?？"
    return True


def defect(prompt: str | None, answer: str | None, may_refuse: bool = False) -> str | None:
    """The defect of a pair, or None: empty, copy, refusal, other_language, truncated; the first that holds."""
    if answer is None or not (bare := _bare(answer)) or bare in _nothing():
        return "empty"
    if prompt and prompt.strip():
        label = _LABEL.match(answer)  # such as "Question:", which may stand before the copy
        if is_copy(_asked_bare(prompt), _bare(answer[label.end():]) if label else bare):
            return "copy"
    if is_refusal(answer):
        return None if may_refuse else "refusal"
    if prompt and (spoken := language(answer)) and (asked := _asked_language(prompt)) and spoken != asked:
        if not ASKED[spoken].search(prompt):
            return "other_language"
    return "truncated" if is_truncated(answer) else None


def defects(pairs: DataFrame) -> DataFrame:
    """(src, row_key, defect) of the defective pairs.

    pairs has src, row_key, prompt, answer and may_refuse; null may_refuse means
    false. Without a prompt only the answer is judged. Repeated pairs are given
    once for each row; an empty table gives no rows; other columns are ignored.
    """

    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, a, r in batches:
            yield pd.Series([defect(x, y, z is True or z == 1) for x, y, z in zip(p, a, r)], dtype="object")

    # Not deterministic for the optimizer: a filter pushed below it would run it twice.
    found = F.pandas_udf(judge, "string").asNondeterministic()("prompt", "answer", F.coalesce("may_refuse", F.lit(False)))
    return pairs.select("src", "row_key", found.alias("defect")).where("defect is not null")


def log_pairs(chat_log: DataFrame) -> DataFrame:
    return chat_log.select(F.lit("chat_log").alias("src"), F.col("id").cast("string").alias("row_key"), "prompt", "answer", F.lit(False).alias("may_refuse"))


def evaluation_pairs(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Answers with the question of their item; answers to unknown items have no prompt."""
    key = F.concat_ws("|", "cond", "id", F.col("rep").cast("string"))
    asked = items.select(F.col("id").alias("_item"), F.col("q").alias("prompt"), F.coalesce("expect_refuse", F.lit(False)).alias("may_refuse")).dropDuplicates(["_item"])
    return answers.join(asked, answers["id"] == asked["_item"], "left").select(F.lit("paper_eval_answers_v3").alias("src"), key.alias("row_key"), "prompt", "answer", "may_refuse")
