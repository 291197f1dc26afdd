"""Trains the tagger of pii: python -m lumenfold.llm.pii_training CHAT_LOG.parquet OUT.npz

The labelled spans come from two places: a bounded sample of a chat log whose
spans are marked by labelling functions (a lexicon of first names taken from its
user_name column, cues, shapes of numbers and addresses), and the same texts
with the marked spans replaced by invented ones, so that the tagger learns
contexts and shapes rather than the sample's names.
"""

from __future__ import annotations

import random
import re
import sys
import time
from collections import Counter

import numpy as np
import pandas as pd

from lumenfold.llm import bilstm_crf as net
from lumenfold.llm import pii

#: Rows of the chat log used at most; a bounded sample is enough for a tagger of this size.
MAX_ROWS = 60_000
#: Texts without spans that are learned from at most: such as could mislead (digits, signs, capitals), and any others.
MAX_HARD, MAX_PLAIN = 20_000, 12_000
HIDDEN, DIM, EPOCHS, BATCH = 32, 24, 8, 64
CITY = r"[A-Z][a-z]+(?:[ ][A-Z][a-z]+)?"
STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Boulevard|Blvd|Drive|Dr|Court|Terrace|Square|Row|Way|Hill)\b\.?"
#: Words that stand between a number and a street's kind only where no street is meant ("4.0 from lane 3").
_LINKING = r"(?:from|of|on|in|at|and|or|the|to|for|with|by|per|a|an|this|that|each|every|was|is|are|were)\b"
_AT = r"\s?(?:[@＠]|\(at\)|\[at\]|\sat\s)\s?"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\])\s?|\sdot\s)"
_ID_CUE = r"(?:[Pp]assport(?: no\.| number)?:? |护照(?:号码?)?[：:]?)"
#: A number that stands behind one of these is no telephone number.
_NO_PHONE = r"(?<!Batch )(?<!batch )(?<!批号)(?<!SB-)(?<!CAS )"
RULES = [
    (0, re.compile(rf"[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z][A-Za-z0-9-]*(?:{_DOT}[A-Za-z][A-Za-z0-9-]*)+", re.A | re.I)),
    (3, re.compile(rf"(?<![\w.,:/-])(?:(?i:Apt|Flat|Unit|Suite) \w+, )?\d+(?:[A-Za-z]|-\d+)? (?:(?!(?i:{_LINKING}))[A-Za-z]+ ){{1,3}}(?i:{STREET})(?:, {CITY}(?: \d{{5}})?)?")),
    (3, re.compile(r"(?:[一-鿿]{2}省)?[一-鿿]{2}市(?:[一-鿿]{2}[区县])?[一-鿿]{2}[路街巷道][\d０-９]+号(?:[\d０-９]+室|[\d０-９]+栋[\d０-９]+单元)?")),
    (2, re.compile(r"(?<!\d)[1-9]\d{5}\s?(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\s?\d{3}[\dXx](?!\d)")),
    (2, re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    (2, re.compile(rf"(?:(?<=assport )|(?<=assport: )|(?<=assport no\. )|(?<=assport number )|(?<=护照)|(?<=护照号)|(?<=护照号码：)|(?<=护照：))[A-Z]\d{{7,8}}(?!\d)")),
    (1, re.compile(r"\b(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)\b[,\s-]*){5,}(?<![,\s])", re.I)),
    (1, re.compile(rf"\+\d[\d ().-]{{7,}}\d|\(0?\d{{2,4}}\)\s?\d{{3,4}}[-. ]?\d{{4}}(?!\d)|{_NO_PHONE}(?<![\d.,-])0\d{{2,4}}[- ]?\d{{3,4}}[- ]?\d{{4}}(?![\d-])|{_NO_PHONE}(?<![\d.,-])1\d{{2}}[- ]?\d{{4}}[- ]?\d{{4}}(?![\d-])|(?<![\d-])\d{{3}}([.-])\d{{3}}\1\d{{4}}(?![\d-])|{_NO_PHONE}(?<![\w-])\d{{3}}-\d{{4}}(?![\d-])")),
    (1, re.compile(r"(?:(?<=Tel: )|(?<=number is )|(?<=Call me on )|(?<=will ring )|(?<=tutor under )|(?<=电话)|(?<=电话：)|(?<=手机)|(?<=拨打))\d{7,11}(?!\d)")),
]
_ZH_CUE = r"(?:(?<=我叫)|(?<=学生：)|(?<=学生:)|(?<=请转告)|(?<=已经通知)|(?<=这是)|(?<=联系人：)|(?<=署名))"
_ZH_END = r"(?=同学|老师|[。，！\n]|$)"
ZH_CUED = re.compile(rf"{_ZH_CUE}([一-鿿]{{2,3}}?){_ZH_END}")


def _half(text: str) -> str:
    """Full-width forms as half-width, place by place."""
    return "".join(pii.unicodedata.normalize("NFKC", c)[:1] if "！" <= c <= "～" and c not in "：，。！？" else c for c in text)


class Labels:
    """Labelling functions over the texts of one log.

    First names are the letters of its user_name column; family names are what
    follows them. Characters of Chinese names are those that recur behind cues
    ("my name is", "please tell"), first characters and later ones apart.
    """

    def __init__(self, log: pd.DataFrame, least: int = 5) -> None:
        texts = pd.concat([log["prompt"], log["answer"]]).dropna().unique()
        stems = Counter(re.sub(r"[^a-z]", "", str(u).lower()) for u in log["user_name"].dropna())
        self.first = {w for w, n in stems.items() if len(w) > 2 and n > 5}
        names = "|".join(w.capitalize() for w in sorted(self.first))
        after = Counter(m for t in texts for m in re.findall(rf"\b(?:{names})\s([A-Z][a-z]+(?:-[A-Z][a-z]+)?)\b", t))
        self.last = {w for w, n in after.items() if n > 2}
        last = "|".join(sorted(self.last, key=len, reverse=True))
        self.en = re.compile(rf"(?<![\w@.+-])(?:{names})(?:[ ](?:[A-Z]\.[ ])?(?:{last})(?:-(?:{last}))?)?(?![\w@+]|\.\w)", re.I)
        cued = [m for t in texts for m in ZH_CUED.findall(t)]
        family, given = Counter(m[0] for m in cued), Counter(c for m in cued for c in m[1:])
        one, more = ("".join(c for c, n in x.items() if n >= least) for x in (family, given))
        self.zh = re.compile(rf"(?:{_ZH_CUE}|^|(?<=[。！？，\n]))([{one}][{more}]{{1,2}}){_ZH_END}") if one and more else None

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        half, out = _half(text), []
        for k, rx in [*RULES, (4, self.en), (4, self.zh)]:
            for m in rx.finditer(half) if rx else ():
                a, b = m.span(1) if rx is self.zh else m.span()
                if b > a and not any(x < b and a < y for x, y, _ in out):
                    out.append((a, b, k))
        return sorted(out)


_SYL = "ba be bi bo da de di do fa fen ga gor ha hel is jor ka kel la lem lo ma mir na ner o or pa per qui ra ren ro sa sel si ta tho u va vel wen xan ya yor za zel".split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYL) for _ in range(rng.randrange(2, 4))).capitalize()


def invented(kind: int, was: str, rng: random.Random) -> str:
    """A span of the same kind and shape with other letters and digits."""
    if kind in (1, 2):
        keep = re.search(r"(?:19|20)\d{6}(?=\s?\d{3}[\dXx]$)", was)
        return "".join(rng.choice("0123456789") if c.isdigit() and not (keep and keep.start() <= i < keep.end()) else c for i, c in enumerate(was))
    if kind == 4:
        if re.search(r"[一-鿿]", was):
            return "".join(chr(rng.randrange(0x4E00, 0x9FA0)) if rng.random() < 0.5 else c for c in was)
        new = re.sub(r"[A-Za-z]+", lambda m: _word(rng), was)
        return new.upper() if was.isupper() else new.lower() if was.islower() else new
    if kind == 0:
        return re.sub(r"[a-z]{4,}", lambda m: _word(rng).lower() if m.group(0) not in ("example", "mailto") else m.group(0), was)
    return re.sub(r"\d", lambda m: rng.choice("0123456789"), re.sub(r"(?<=\d )[A-Z][a-z]+(?= (?!St|Rd))", lambda m: _word(rng), was))


def examples(log: pd.DataFrame, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    rng, labels = random.Random(seed), Labels(log)
    plain, marked, seen = [], [], set()
    for t in pd.concat([log["prompt"], log["answer"]]).dropna():
        if t in seen or not t.strip():
            continue
        seen.add(t)
        s = labels.spans(t)
        (marked if s else plain).append((t, s))
    rng.shuffle(plain)
    # Texts without spans but with digits, capitals or signs within are the ones that could mislead.
    hard = [x for x in plain if re.search(rf"\d{{3}}|@|号|[A-Z][a-z]+ [A-Z]|(?i:\b{STREET})", x[0])][:MAX_HARD]
    out = marked + hard + plain[:MAX_PLAIN]
    for t, s in marked:
        new, at, ns = [], 0, []
        for a, b, k in s:
            new.append(t[at:a])
            w = invented(k, t[a:b], rng)
            pos = sum(map(len, new))
            new.append(w)
            ns.append((pos, pos + len(w), k))
            at = b
        out.append(("".join(new) + t[at:], ns))
    rng.shuffle(out)
    return out


def _windows(data: list, chars: dict[str, int], rng: random.Random) -> list[tuple[np.ndarray, np.ndarray]]:
    known = pii.Codes(chars)
    out = []
    for t, s in data:
        ids, tags = known.of(t), np.zeros(len(t), np.int64)
        for a, b, k in s:
            tags[a] = 2 * k + 1
            tags[a + 1:b] = 2 * k + 2
        lo = rng.randrange(max(1, len(t) - 96)) if not s else max(0, min(s[0][0] - rng.randrange(48), len(t) - 96))
        out.append((ids[lo:lo + 112], tags[lo:lo + 112]))
    return out


def train(log: pd.DataFrame, out: str, epochs: int = EPOCHS, seed: int = 7) -> dict[str, float]:
    rng = random.Random(seed)
    data = examples(log.head(MAX_ROWS), seed)
    held, data = data[:len(data) // 10], data[len(data) // 10:]
    count = Counter(c for t, _ in data for c in map(pii.symbol, set(t)))
    chars = "".join(sorted(c for c, n in count.items() if n >= 25))
    ids = {c: i for i, c in enumerate(chars, start=pii.OTHER_UP + 1)}
    p = net.init(len(chars) + pii.OTHER_UP + 1, 2 * len(pii.KINDS) + 1, DIM, HIDDEN, seed)
    wins = _windows(data, ids, rng)

    def batches():
        steps, done = epochs * (len(wins) // BATCH), 0
        for _ in range(epochs):
            order = sorted(range(len(wins)), key=lambda k: len(wins[k][0]) + rng.random() * 16)
            groups = [order[i:i + BATCH] for i in range(0, len(order) - BATCH + 1, BATCH)]
            rng.shuffle(groups)
            for g in groups:
                n = max(len(wins[k][0]) for k in g)
                x, m, y = np.zeros((n, len(g)), np.int32), np.zeros((n, len(g)), np.float32), np.zeros((n, len(g)), np.int64)
                for j, k in enumerate(g):
                    w, t = wins[k]
                    w = np.where(np.random.default_rng(done * BATCH + j).random(len(w)) < 0.03, pii.OTHER_CJK, w) if rng.random() < 0.2 else w
                    x[:len(w), j], m[:len(w), j], y[:len(w), j] = w, 1, t
                done += 1
                yield x, m, y, max(0.05, 1 - done / max(steps, 1))

    loss = net.fit(p, batches())
    p.pop("_tables", None)
    np.savez_compressed(out, chars=np.array(chars), **{k: v.astype(np.float16) for k, v in p.items()})
    pii.load.cache_clear()
    return {"loss": loss, **held_out(held, out)}


def held_out(held: list, path: str) -> dict[str, float]:
    """Precision and recall of (text, kind) on labelled texts that were not trained on."""
    got = pii.find([t for t, _ in held], path)
    hit = sum(len({k for *_, k in s} & {k for *_, k in g}) for (_, s), g in zip(held, got))
    said, true = sum(len({k for *_, k in g}) for g in got), sum(len({k for *_, k in s}) for _, s in held)
    return {"precision": hit / max(said, 1), "recall": hit / max(true, 1), "texts": len(held)}


if __name__ == "__main__":
    began = time.time()
    print(train(pd.read_parquet(sys.argv[1]).drop_duplicates("id"), sys.argv[2], int(sys.argv[3]) if len(sys.argv) > 3 else EPOCHS), round(time.time() - began))
