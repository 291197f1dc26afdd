"""Personal information in free text: found by a character tagger, replaced by typed placeholders.

Texts are cut into overlapping windows; each is decoded on its own, and the
windows are reconciled over the whole text: every character takes the tag of
the window in which it stands farthest from an edge, and spans that meet across
windows are joined. The tagger is a bidirectional LSTM with CRF transitions
(bilstm_crf), trained by pii_training from labelled spans.
"""

from __future__ import annotations

import io
import os
import pkgutil
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import bilstm_crf as net

KINDS = ("email", "phone", "id_number", "address", "name")
MODEL = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_model.npz")
WINDOW, OVERLAP, BATCH = 160, 64, 512
PAD, OTHER, OTHER_CJK, OTHER_LOW, OTHER_UP = range(5)


@cache
def load(path: str = MODEL) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    # The package may lie in an archive, so its own weights are read through its loader.
    own = pkgutil.get_data("lumenfold.llm", "pii_model.npz") if path == MODEL else None
    with np.load(io.BytesIO(own) if own else path) as f:
        p = {k: f[k].astype(np.float32) for k in f.files if k != "chars"}
        chars = {c: i for i, c in enumerate(str(f["chars"]), start=OTHER_UP + 1)}
    return p, chars


def symbol(c: str) -> str:
    """A character as the tagger sees it: half-width, all digits alike."""
    c = unicodedata.normalize("NFKC", c) if ord(c) > 127 else c
    return "0" if c[:1].isdigit() else "\n" if c == "\r" else c[:1] or " "


class Codes:
    """Codes of characters by code point, filled in as characters are met."""

    def __init__(self, chars: dict[str, int]) -> None:
        self.chars, self.table = chars, np.full(0x110000, -1, np.int32)

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[points]
        if len(out) and out.min() < 0:
            for p in np.unique(points[out < 0]):
                s = symbol(chr(p))
                k = self.chars.get(s)
                self.table[p] = k if k is not None else OTHER_CJK if "㐀" <= s <= "鿿" else OTHER_UP if s.isupper() else OTHER_LOW if s.isalpha() else OTHER
            out = self.table[points]
        return out


def _windows(n: int) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        yield at, min(at + WINDOW, n)
        if at + WINDOW >= n:
            return
        at += WINDOW - OVERLAP


def tag(texts: list[str], path: str = MODEL) -> list[np.ndarray]:
    """The tag of each character of each text: 0 none, 2k + 1 begins and 2k + 2 continues a span of kind k."""
    p, chars = load(path)
    known = Codes(chars)
    codes = [known.of(t) for t in texts]
    jobs = sorted(((hi - lo, k, lo, hi) for k, c in enumerate(codes) if len(c) for lo, hi in _windows(len(c))), key=lambda x: x[0])
    out = [np.zeros(len(c), np.int8) for c in codes]
    for a in range(0, len(jobs), BATCH):
        part = jobs[a:a + BATCH]
        n = part[-1][0]
        ids, mask = np.zeros((n, len(part)), np.int32), np.zeros((n, len(part)), np.float32)
        for j, (m, k, lo, hi) in enumerate(part):
            ids[:m, j] = codes[k][lo:hi]
            mask[:m, j] = 1
        tags = net.decoded(p, net.scores(p, ids, mask), mask)
        for j, (m, k, lo, hi) in enumerate(part):
            # The window owns its places up to the middle of the overlap on either side.
            left = lo + OVERLAP // 2 if lo else 0
            right = hi - OVERLAP // 2 if hi < len(codes[k]) else hi
            out[k][left:right] = tags[left - lo:right - lo, j]
    return out


def spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the tagged spans; a continued span without a beginning begins where it is first seen."""
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(tags):
        k = (int(tags[i]) - 1) // 2
        if out and out[-1][1] == i and out[-1][2] == k and tags[i] % 2 == 0:
            out[-1] = (out[-1][0], int(i) + 1, k)
        else:
            out.append((int(i), int(i) + 1, k))
    return out


_DIGIT = re.compile(r"\d")
#: A house number with the word that a street's name ends in, before or behind it.
_ADDRESS = re.compile(
    r"\d+[A-Za-z]?(?:-\d+)?\s(?!(?:from|of|on|in|at|and|the|to|for|with|by)\b)(?:[^\W\d_][\w'’-]*\s){1,3}(?:street|st|road|rd|lane|ln|avenue|ave|close|boulevard|blvd|drive|dr|court|ct|terrace|square|sq|row|way|hill|place|pl)\b"
    r"|[^\W\d_]{3,}(?:straße|strasse|str\.|weg|gasse|platz|allee)\s\d+|[路街巷道弄村里]\s?\d+\s?[号號弄]", re.I)
_DATE = re.compile(r"\d{6}\s?(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\s?\d{3}[\dXx]")


_SPOKEN = re.compile(r"\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double)\b|[零〇一二三四五六七八九幺]", re.I)


def plausible(kind: int, text: str, a: int, b: int) -> bool:
    """An exact check of what the tagger found: the least a span of its kind must have."""
    found = text[a:b]
    t = unicodedata.normalize("NFKC", found)
    digits = len(_DIGIT.findall(t))
    if kind == 0:
        return bool(re.search(r"[\w.+-]\s*(?:@|[(\[]\s*at\s*[)\]]|\bat\b)\s*[\w-]", t, re.I))
    if kind == 1:
        return 7 <= digits <= 15 or len(_SPOKEN.findall(t)) >= 5
    if kind == 2:
        longest = re.search(r"\d{15,}", re.sub(r"\s", "", t))
        return digits >= 6 and (not longest or bool(_DATE.search(t)))
    if kind == 3:
        return bool(_ADDRESS.search(t)) and not re.search(r"[\d][.,]\Z", unicodedata.normalize("NFKC", text[max(0, a - 2):a]))
    if digits or sum(c.isalpha() for c in t) < 2:
        return False
    if not "㐀" <= found[0] <= "鿿":  # whole words, as the language cuts them
        if a and text[a - 1].isalpha() or b < len(text) and text[b].isalpha():
            return False
    return True


def snapped(text: str, span: tuple[int, int, int], reach: int = 2) -> tuple[int, int, int]:
    """A span with its edges mended: an address or name ends with its line; a name that misses up to reach letters of a word at an edge has them."""
    a, b, k = span
    if k > 2 and "\n" in (found := text[a:b]).strip():
        a += len(found) - len(found.lstrip())
        b = a + len(text[a:b].split("\n")[0].rstrip())
    if k == 4 and text[a].isascii():
        for n in range(1, reach + 1):
            if a - n >= 0 and text[a - n:a].isalpha() and not text[a - n - 1:a - n].isalpha():
                a -= n
                break
        for n in range(1, reach + 1):
            if text[b:b + n].isalpha() and len(text[b:b + n]) == n and not text[b + n:b + n + 1].isalpha():
                b += n
                break
    return a, b, k


def find(texts: list[str], path: str = MODEL) -> list[list[tuple[int, int, int]]]:
    """Checked spans of each text; equal texts are decoded once."""
    one = list(dict.fromkeys(texts))
    known = {t: [s for s in (snapped(t, s) for s in spans(g)) if plausible(s[2], t, s[0], s[1])] for t, g in zip(one, tag(one, path))}
    return [known[t] for t in texts]


def placeholder(kind: int) -> str:
    return f"[{KINDS[kind].upper()}]"


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, k in found:
        out += [text[at:a], placeholder(k)]
        at = b
    return "".join([*out, text[at:]])


def redacted(rows: DataFrame, fields: tuple[str, ...], path: str = MODEL) -> DataFrame:
    """rows with each field replaced by its redacted text, and <field>_kinds, the kinds found in it.

    Null stays null with null kinds; an empty text stays empty with none. Whole
    texts are read, however long. Other columns are kept; a column that has the
    name of a new one is replaced. Repeated rows are treated alike.
    """

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            here = [t for t in texts if t is not None]
            got = iter(find(here, path))
            out = []
            for t in texts:
                found = next(got) if t is not None else None
                out.append((None, None) if found is None else (redact(t, found), sorted({KINDS[k] for _, _, k in found})))
            yield pd.DataFrame(out, columns=["text", "kinds"])

    # Not deterministic for the optimizer: merged projections would run it once for each use.
    udf = F.pandas_udf(work, "text string, kinds array<string>").asNondeterministic()
    for f in fields:
        rows = rows.withColumn("_redacted", udf(F.col(f))).withColumn(f, F.col("_redacted.text")).withColumn(f"{f}_kinds", F.col("_redacted.kinds")).drop("_redacted")
    return rows


def kinds(rows: DataFrame, key: str, fields: tuple[str, ...], path: str = MODEL) -> DataFrame:
    """(key, field, kind), distinct: which kinds of personal information each field of each key holds."""
    few = redacted(rows.select(key, *fields), fields, path)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_kinds").alias("kinds")) for f in fields]))
    return few.select(key, pairs.alias("x")).select(key, "x.field", F.explode("x.kinds").alias("kind")).distinct()
