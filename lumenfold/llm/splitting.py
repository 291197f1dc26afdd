"""Cutting oversized items at natural boundaries, range by range.

A text (a column value or a file) is read as ranges with a halo on both sides.
Each worker finds the boundaries of its range; where a long text goes on into
the next range both workers find the same anchor in the halo, so every range is
cut on its own. The boundary tables of the ranges are stitched by prefix sums
and running maxima, which number the pieces and measure units that span ranges.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1000, 100
RANGE, HALO = 65_536, 4_096
_EOL = r"(?:\r\n|\r(?!\n)|\n)"
_BLANK = re.compile(rf"[^\S\r\n]*{_EOL}(?:[^\S\r\n]*{_EOL})+\s*")
#: A full stop ends a sentence only before white space or the end, so never within a number.
_STOP = re.compile(r"(?:[。！？；!?…]+[\"”’』」）)\]]*|\.+[\"”’)\]]*(?=\s|\Z))\s*")
_SPACE = re.compile(r"[\s，、,;|]+")
_RANGES = "id string, r int, last boolean, start bigint, lead int, own int, body string"


def ranges(rows: DataFrame, key: str, text: str, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """(id, r, last, start, lead, body): overlapping windows of each text; start is the offset of the range, lead the halo before it.

    id is the key as a string. Null and empty texts have none.
    """
    n = F.length("t")
    return (
        rows.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).where("length(t) > 0")
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))))
        .withColumn("start", F.col("r").cast("bigint") * size)
        .withColumn("lead", F.least(F.col("start"), F.lit(halo)).cast("int"))
        .select("id", "r", (F.col("start") + size >= n).alias("last"), "start", "lead", F.least(F.lit(size), n - F.col("start")).cast("int").alias("own"),
                F.expr(f"substring(t, cast(start - lead + 1 as int), lead + {size + halo})").alias("body"))
    )


def file_ranges(spark: SparkSession, paths: str | list[str], size: int = RANGE, halo: int = HALO) -> DataFrame:
    """The same windows over UTF-8 files: each task seeks to its bytes, none reads a whole file.

    paths are files, folders or patterns on any file system that the session and
    the tasks reach; only names and lengths are listed. Ranges begin at the first
    character at or after a multiple of size bytes; start counts characters and
    comes from prefix sums over the lengths of the ranges. Empty files have none.
    """
    listed = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("id"), F.col("length").alias("bytes")).where("bytes > 0")
    plan = listed.withColumn("r", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / size).cast("int")))).select("id", "r", "bytes").repartition(F.col("id"), F.col("r"))
    opened: dict[str, pa.NativeFile] = {}

    def read(path: str, a: int, b: int) -> str:
        """The characters that begin in bytes [a, b)."""
        if path not in opened:
            opened.clear()
            system, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
            opened[path] = system.open_input_file(name)
        raw = opened[path].read_at(b - max(a, 0) + 4, max(a, 0))
        body = raw[: b - max(a, 0)]
        skip = next((i for i, c in enumerate(body) if c & 0xC0 != 0x80), len(body))
        more = next((i for i, c in enumerate(raw[len(body):]) if c & 0xC0 != 0x80), len(raw) - len(body))
        return raw[skip if a > 0 else 0: len(body) + more].decode("utf-8", "replace")

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(chars=[len(read(p, r * size, min((r + 1) * size, n))) for p, r, n in zip(b["id"], b["r"], b["bytes"])])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, r, n, start in zip(b["id"], b["r"], b["bytes"], b["start"]):
                at, to = r * size, min((r + 1) * size, n)
                left = read(p, at - 4 * halo, at)[-halo:] if at else ""
                own = read(p, at, to)
                out.append((p, r, to >= n, start, len(left), len(own), left + own + (read(p, to, min(to + 4 * halo, n))[:halo] if to < n else "")))
            yield pd.DataFrame(out, columns=["id", "r", "last", "start", "lead", "own", "body"])

    before = Window.partitionBy("id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    placed = plan.mapInPandas(lengths, "id string, r int, bytes bigint, chars bigint").withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    return placed.repartition("id", "r").mapInPandas(windows, _RANGES)


def _cuts(body: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Paragraph ends and sentence ends as (end of content, start of the next)."""
    paragraphs = [m.span() for m in _BLANK.finditer(body)]
    sentences = []
    for m in _STOP.finditer(body):
        end = m.start() + len(m.group(0).rstrip())
        if end < len(body):
            sentences.append((end, m.end()))
    return paragraphs, sentences


def _anchor(paragraphs: list, sentences: list, at: int, body: str, halo: int) -> int:
    """Where a range really begins: the first paragraph, else sentence, that begins within half a halo after at, else at."""
    for cuts in (paragraphs, sentences):
        for end, nxt in cuts:
            if at <= end and nxt <= min(at + halo // 2, len(body)):
                return nxt
    return at


def boundary_table(windows: DataFrame) -> DataFrame:
    """One row per range: the first and last paragraph and sentence cut in it, and the longest unit between cuts of the range.

    A cut belongs to the range in which its content ends. Offsets count from the start of the text.
    """

    def units(cuts: list[tuple[int, int]], lo: int, hi: int, shift: int) -> tuple:
        own = [(e + shift, n + shift) for e, n in cuts if lo <= e < hi]
        if not own:
            return None, None, 0
        return own[0][0], own[-1][1], max([b[0] - a[1] for a, b in zip(own, own[1:])], default=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, r, last, start, lead, own, body in b.itertuples(index=False):
                paragraphs, sentences = _cuts(body)
                hi = len(body) if last else lead + own
                both = _merged(paragraphs, sentences)
                head = len(body) - len(body.lstrip()) if r == 0 else None
                tail = start - lead + len(body.rstrip()) if last else None
                shift = start - lead
                out.append((i, r, head, tail, *units(paragraphs, lead, hi, shift), *units(both, lead, hi, shift)))
            yield pd.DataFrame(out, columns=_BOUNDS).astype({c: "Int64" for c in _BOUNDS[1:]})

    return windows.select("id", "r", "last", "start", "lead", "own", "body").mapInPandas(run, "id string, " + ", ".join(f"{c} bigint" for c in _BOUNDS[1:]))


_BOUNDS = ["id", "r", "head", "tail", "p_first", "p_last", "p_inner", "s_first", "s_last", "s_inner"]


def _merged(paragraphs: list[tuple[int, int]], sentences: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Paragraph and sentence cuts in order, those that touch made one."""
    out: list[tuple[int, int]] = []
    for e, n in sorted(paragraphs + sentences):
        if out and e <= out[-1][1]:
            out[-1] = (out[-1][0], max(n, out[-1][1]))
        else:
            out.append((e, n))
    return out


def longest_units(windows: DataFrame) -> DataFrame:
    """(id, paragraph, sentence): the longest paragraph and the longest sentence of each text, also across ranges."""
    t = boundary_table(windows)
    before = Window.partitionBy("id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    for u in ("p", "s"):
        open_at = F.coalesce(F.max(f"{u}_last").over(before), F.first("head").over(Window.partitionBy("id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
        t = t.withColumn(f"{u}_edge", F.col(f"{u}_first") - open_at).withColumn(f"{u}_end", F.col("tail") - F.coalesce(f"{u}_last", open_at))
    longest = lambda u: F.max(F.greatest(f"{u}_inner", f"{u}_edge", f"{u}_end"))
    return t.groupBy("id").agg(longest("p").alias("paragraph"), longest("s").alias("sentence"))


def boundary_kinds(windows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, boundary): where an oversized text can be cut: paragraph, sentence or inside a sentence."""
    room = limit - overlap
    kind = F.when(F.col("paragraph") <= room, "paragraph").when(F.col("sentence") <= room, "sentence").otherwise("inside")
    return longest_units(windows).select("id", kind.alias("boundary"))


def _split(body: str, lo: int, hi: int, first: bool, limit: int, overlap: int, paragraphs: list, sentences: list, final: bool) -> Iterator[tuple[int, int, int, int, str]]:
    """(overlap start, overlap end, start, end, kind of the cut at the end) of the pieces of body[lo:hi]."""
    pos, over_end = lo, lo
    while pos < hi:
        over = max(0, over_end - overlap) if not (first and pos == lo) else over_end
        room = limit - (over_end - over)
        if hi - pos <= room:
            yield over, over_end, pos, hi, "end" if final else "range"
            return
        for kind, cuts in (("paragraph", paragraphs), ("sentence", sentences)):
            k = bisect.bisect_right(cuts, (pos + room, 1 << 62)) - 1
            while k >= 0 and cuts[k][1] >= hi and cuts[k][0] > pos:
                k -= 1  # the last piece of a range keeps the white space up to the next range
            if k >= 0 and cuts[k][0] > pos:
                end, nxt = cuts[k]
                break
        else:
            kind, end = "inside", pos + room
            spaces = [m.end() for m in _SPACE.finditer(body, pos + room // 2, pos + room)]
            end = spaces[-1] if spaces and pos < spaces[-1] < end else end
            nxt = end
        keep = min(nxt, pos + room)  # white space after the cut stays with the piece as far as it fits
        yield over, over_end, pos, keep, kind
        pos, over_end = nxt, keep


def pieces(windows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, halo: int = HALO) -> DataFrame:
    """(id, piece_no, start_at, end_at, cut, text): pieces of at most limit characters.

    Every piece but the first begins with the last overlap characters of the one
    before; start_at and end_at bound what is new in it. Pieces cover the text in
    order; only white space at a cut that would exceed the limit is left out. cut
    tells what ends the piece: paragraph, sentence, inside, range (an anchor
    between ranges) or end. Texts within the limit are one piece; empty and null
    texts have none; texts with the same key are to be told apart by the caller.
    """
    if not 0 <= overlap < limit or 4 * limit > halo:
        raise ValueError("0 <= overlap < limit <= halo / 4 must hold")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, r, last, start, lead, own, body in b.itertuples(index=False):
                paragraphs, sentences = _cuts(body)
                lo = 0 if r == 0 else _anchor(paragraphs, sentences, lead, body, halo)
                hi = len(body) if last else _anchor(paragraphs, sentences, lead + own, body, halo)
                shift = start - lead
                for k, (o, oe, a, e, cut) in enumerate(_split(body, lo, hi, r == 0, limit, overlap, paragraphs, sentences, last)):
                    out.append((i, r, k, a + shift, e + shift, cut, body[o:oe] + body[a:e]))
            yield pd.DataFrame(out, columns=["id", "r", "k", "start_at", "end_at", "cut", "text"])

    cut = windows.select("id", "r", "last", "start", "lead", "own", "body").mapInPandas(run, "id string, r int, k int, start_at bigint, end_at bigint, cut string, text string")
    # A range reaches at most halo beyond its size, so its pieces fit one task; ranges of a text are numbered by prefix sums.
    before = Window.partitionBy("id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("id", "r").count().select("id", "r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return cut.join(counts, ["id", "r"]).select("id", (F.col("base") + F.col("k")).alias("piece_no"), "start_at", "end_at", "cut", "text")
