"""Column expressions on text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4E00}-\x{9FFF}]"


def tokens(c: Column) -> Column:
    """Bag of words a-z of two letters or more, of Chinese single characters, pairs and triples, and of numbers of two digits or more."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit(f"({CJK}+)"))

    def grams(run: Column, n: int) -> Column:
        places = F.when(F.length(run) >= n, F.sequence(F.lit(1), F.length(run) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(run, i, F.lit(n)))

    chinese = F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 1), grams(r, 2), grams(r, 3))))
    return F.concat(F.regexp_extract_all(low, F.lit("([a-z]{2,})")), chinese, F.regexp_extract_all(low, F.lit(r"(\p{Nd}{2,})")))


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cjk_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\x{4E00}-\x{9FFF}]", ""))


def is_english(c: Column) -> Column:
    """Whether less than 5 % of the characters that are no blanks are Chinese; false for blank text."""
    n = F.length(no_space(F.coalesce(c, F.lit(""))))
    return (n > 0) & (cjk_count(F.coalesce(c, F.lit(""))) < 0.05 * n)


def english_piece(text: Column, filename: Column) -> Column:
    """Whether a piece is English and less than 20 % of its file's name are Chinese; false for a blank text."""
    name = F.coalesce(filename, F.lit(""))
    return F.coalesce(is_english(text) & (cjk_count(name) < 0.2 * F.length(name)), F.lit(False))


def mostly_chinese(c: Column) -> Column:
    """Whether at least 30 % of the characters that are no blanks are Chinese."""
    n = F.length(no_space(F.coalesce(c, F.lit(""))))
    return (n > 0) & (cjk_count(F.coalesce(c, F.lit(""))) >= 0.3 * n)


def stem(filename: Column) -> Column:
    """A file name without the extension of a document."""
    return F.regexp_replace(filename, r"(\.pdf|\.PDF|\.docx|\.DOCX|\.pptx|\.PPTX|\.xlsx|\.XLSX|\.txt)$", "")


def safe_name(c: Column, most: int = 150) -> Column:
    return F.left(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_"), F.lit(most))


def sentences(c: Column) -> Column:
    """Pieces ending in a sentence mark or a point with a blank; blank pieces are dropped, nothing else."""
    parts = F.split(c, r"(?<=[\x{3002}\x{FF1B};\x{FF01}!\x{FF1F}?])|(?<=\. )")
    return F.filter(parts, lambda p: F.length(strip(p)) > 0)


def chunks(c: Column, size: int = 500, overlap: int = 100, least: int = 30) -> Column:
    """Greedy pieces of at most size characters, from whole lines where these fit and from sentences of longer lines.

    Each piece but the first is led by the last overlap characters of the one
    before; pieces of no more than least characters are dropped at the end.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda p: F.length(p) > 0)
    one = lambda s, glue: F.struct(s.alias("s"), F.lit(glue).alias("glue"), F.lit(False).alias("flush"))

    def items(p: Column) -> Column:
        # A long line closes what is open; its sentences follow without a separator.
        close = F.array(F.struct(F.lit("").alias("s"), F.lit(0).alias("glue"), F.lit(True).alias("flush")))
        return F.when(F.length(p) > size, F.concat(close, F.transform(sentences(p), lambda s: one(s, 0)))).otherwise(F.array(one(p, 1)))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        cur, done, s, glue = acc["cur"], acc["done"], x["s"], x["glue"]
        closed = F.when(cur != "", F.concat(done, F.array(cur))).otherwise(done)
        fits = F.length(cur) + F.length(s) + glue <= size
        joined = F.when((glue == 1) & (cur != ""), F.concat(cur, F.lit("\n"), s)).otherwise(F.concat(cur, s))
        # One struct per outcome keeps the fold a single pass.
        return (
            F.when(x["flush"], F.struct(closed.alias("done"), F.lit("").alias("cur")))
            .when(fits, F.struct(done.alias("done"), joined.alias("cur")))
            .otherwise(F.struct(closed.alias("done"), s.alias("cur")))
        )

    raw = F.aggregate(F.flatten(F.transform(lines, items)), start, step, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    led = F.transform(raw, lambda x, i: F.when(i > 0, F.concat(F.right(F.get(raw, i - 1), F.lit(overlap)), F.lit("\n"), x)).otherwise(x)) if overlap else raw
    return F.filter(led, lambda x: F.length(strip(x)) > least)
