"""Evaluation passages inside a corpus, by greedy string tiling.

Texts become tokens: words, and single Chinese characters. Seeds of min_tile
tokens are found by a running Karp-Rabin hash; from the seeds the longest common
run of unmarked tokens is marked again and again until none is left. Tiles never
overlap, so reordered passages are covered piece by piece.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TILE = 8
WORDS, CHARS = 12, 20
#: Items compared with the corpus in one pass; more items take further passes.
ITEM_BLOCK = 5_000
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_TOKEN = re.compile(r"[一-鿿㐀-䶿]|[^\W_一-鿿㐀-䶿]+")
_MARK = re.compile(r"[­​-‏⁠﻿]")


def tokens(text: str) -> list[str]:
    """Lower-case words and single Chinese characters; punctuation, marks and spacing are gone."""
    text = unicodedata.normalize("NFKD", _MARK.sub("", text)).lower()
    return _TOKEN.findall("".join(c for c in text if not unicodedata.combining(c)))


def _hashes(code: list[int], n: int) -> Iterator[tuple[int, int]]:
    """(position, Karp-Rabin hash) of each run of n token codes."""
    if len(code) < n:
        return
    top, h = pow(_BASE, n - 1, _PRIME), 0
    for c in code[:n]:
        h = (h * _BASE + c) % _PRIME
    yield 0, h
    for i in range(n, len(code)):
        h = ((h - code[i - n] * top) * _BASE + code[i]) % _PRIME
        yield i - n + 1, h


def _code(toks: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(t) for t in toks]


def tiles(pattern: list[str], text: list[str], seeds: list[tuple[int, int]], min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, length): longest matches first, none overlapping, each of min_tile or more.

    seeds are the (place in pattern, place in text) of equal runs of min_tile tokens.
    """
    heap, seen = [], set()
    for p, t in seeds:
        if (p, t) in seen or pattern[p:p + min_tile] != text[t:t + min_tile]:
            continue
        while p and t and pattern[p - 1] == text[t - 1]:
            p, t = p - 1, t - 1
        n = 0
        while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n]:
            n += 1
        seen.update((p + i, t + i) for i in range(n))
        heap.append((-n, p, t))
    heapq.heapify(heap)
    marked_p, marked_t, out = [False] * len(pattern), set(), []
    while heap:
        n, p, t = heapq.heappop(heap)
        free = [not marked_p[p + i] and t + i not in marked_t for i in range(-n)]
        if all(free):
            for i in range(-n):
                marked_p[p + i] = True
                marked_t.add(t + i)
            out.append((p, t, -n))
            continue
        start = None
        for i, ok in enumerate([*free, False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= min_tile:
                    heapq.heappush(heap, (start - i, p + start, t + start))
                start = None
    return out


class Index:
    """Seeds of the evaluation passages of one block of items."""

    def __init__(self, items: list[tuple[str, str, str]], min_tile: int) -> None:
        self.min_tile, self.passages, self.seeds = min_tile, [], defaultdict(list)
        for item_id, field, text in items:
            toks = tokens(text)
            for i, h in _hashes(_code(toks), min_tile):
                self.seeds[h].append((len(self.passages), i))
            self.passages.append((item_id, field, toks))

    def matches(self, text: str) -> Iterator[tuple[str, str, int, int, int, int, float]]:
        toks = tokens(text)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, h in _hashes(_code(toks), self.min_tile):
            for k, p in self.seeds.get(h, ()):
                found[k].append((p, t))
        for k, seeds in found.items():
            item_id, field, passage = self.passages[k]
            got = tiles(passage, toks, seeds, self.min_tile)
            if got:
                chars = [sum("㐀" <= x[0] <= "鿿" for x in passage[p:p + n]) for p, _, n in got]
                words = [n - c for (_, _, n), c in zip(got, chars)]
                covered = sum(n for _, _, n in got)
                yield item_id, field, len(got), max(words), max(chars), covered, covered / len(passage)


def leaks(docs: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("q", "rubric"), min_tile: int = MIN_TILE, coverage: float = 0.5,
          words: int = WORDS, chars: int = CHARS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, field, tiles, longest_words, longest_chars, covered, coverage, verbatim).

    One row for each document and field of an item that has a tile of words
    words or chars Chinese characters (verbatim), or whose tiles cover at least
    the given share of the field in any order. Items are read to the driver in
    blocks of item_block, each against all documents, so what is sent out stays
    bounded however many items there are. Null, blank and short texts match
    nothing; repeated items give one row for each item_id and field.
    """

    def scan(index: Index):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["doc_id", "item_id", "field", "tiles", "longest_words", "longest_chars", "covered", "coverage"]
            for b in batches:
                yield pd.DataFrame([(d, *m) for d, t in zip(b["doc_id"], b["text"]) for m in index.matches(t)], columns=names).astype({"doc_id": "int64"})
        return run

    few = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null and length(text) > 0")
    long = reduce(DataFrame.unionAll, [items.select(F.col("id").cast("string").alias("id"), F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    parts, block = [], []
    schema = "doc_id bigint, item_id string, field string, tiles int, longest_words int, longest_chars int, covered int, coverage double"

    def close() -> None:
        parts.append(few.mapInPandas(scan(Index(block, min_tile)), schema))
        block.clear()

    for r in long.where("id is not null and text is not null").distinct().orderBy("id", "field").toLocalIterator():
        block.append((r["id"], r["field"], r["text"]))
        if len(block) == item_block:
            close()
    if block or not parts:
        close()
    verbatim = (F.col("longest_words") >= words) | (F.col("longest_chars") >= chars)
    return reduce(DataFrame.unionAll, parts).withColumn("verbatim", verbatim).where(F.col("verbatim") | (F.col("coverage") >= coverage))
