"""Pages of documents and where pieces lie in them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as T


def page_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): pages are the blocks between blank lines; blank ones are left out."""
    p = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n\n")).alias("page_no", "text"))
    return p.where(F.length(T.strip("text")) > 0)


def located(rows: DataFrame, piece: str, text: str, offsets: str) -> DataFrame:
    """rows with page: "a" or "a-b", the pages (from 1) on which a piece begins and ends.

    White space is ignored. Probes of 40, then 20, then 10 characters of the
    piece are looked up in the text, the first that is found decides; its place
    less its offset in the piece is the start. A page is the last whose offset is
    not after a place. Pieces that are not found have null.
    """
    body, whole = T.no_space(F.col(piece)), T.no_space(F.col(text))
    # Offsets count characters of the text with its white space; the same count without it comes from the prefix.
    solid = F.transform(F.col(offsets), lambda o: F.length(T.no_space(F.left(F.col(text), o.cast("int")))))

    def probe(n: int):
        starts = F.when(F.length("_body") >= n, F.sequence(F.lit(0), F.length("_body") - n, F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda o: F.struct(F.instr(F.col("_whole"), F.substring(F.col("_body"), o + 1, F.lit(n))).alias("at"), o.alias("o")))

    r = rows.withColumns({"_body": body, "_whole": whole, "_off": solid})
    hits = F.filter(F.concat(probe(40), probe(20), probe(10)), lambda x: x["at"] > 0)
    r = r.withColumn("_hit", F.get(hits, F.lit(0)))
    r = r.withColumn("_start", F.greatest(F.col("_hit.at") - 1 - F.col("_hit.o"), F.lit(0))).withColumn("_end", F.col("_start") + F.greatest(F.length("_body") - 1, F.lit(0)))
    last = lambda place: F.size(F.filter("_off", lambda o: o <= place))
    a, b = last(F.col("_start")), last(F.col("_end"))
    page = F.when(F.col("_hit").isNotNull(), F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string"))))
    return r.withColumn("page", page).drop("_body", "_whole", "_off", "_hit", "_start", "_end")


class File:
    """The pages of one file as one text without white space, taken in by their order."""

    def __init__(self, name: str) -> None:
        self.name, self.numbers, self.parts = name, [], []
        self.text, self.offsets = "", []

    def add(self, number: object, text: str) -> None:
        self.numbers.append(number)
        self.parts.append(text)

    def close(self) -> None:
        if self.parts:
            self.text, self.offsets, self.parts = "".join(self.parts), [0, *accumulate(map(len, self.parts[:-1]))], []

    def page(self, body: str) -> str | None:
        """What located says of a piece without white space, by the numbers of the pages; a probe is only tried if none before it is found."""
        self.close()
        for n in (40, 20, 10):
            for o in range(0, len(body) - n + 1, n):
                at = self.text.find(body[o:o + n])
                if at >= 0:
                    start = max(at - o, 0)
                    a, b = (bisect_right(self.offsets, x) - 1 for x in (start, start + len(body) - 1))
                    known = [str(self.numbers[i]) for i in ((a,) if a == b else (a, b)) if self.numbers[i] is not None]
                    return "-".join(known) if known or a != b else None
        return None


def in_files(pieces: DataFrame, pages: DataFrame) -> DataFrame:
    """pieces, which have filename and _body, with page instead of _body; pages has filename, page_no and t; _body and t have no white space.

    Pages and pieces of a file meet in one task, pages first, so a task holds
    the text of one file, once, and its pieces pass by.
    """
    columns = [c for c in pieces.columns if c != "_body"]
    row = F.struct(*columns)
    told = pieces.select("filename", F.lit(True).alias("piece"), F.lit(None).cast(pages.schema["page_no"].dataType).alias("page_no"), F.col("_body").alias("t"), row.alias("row"))
    read = pages.where("filename is not null").select("filename", F.lit(False).alias("piece"), "page_no", "t", F.lit(None).cast(told.schema["row"].dataType).alias("row"))
    kind = told.select("row", F.lit(None).cast("string").alias("page")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = File("")
        for batch in batches:
            at, found = [], []
            for i, (name, piece, number, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("filename", "piece", "page_no", "t")))):
                if name is not None and name != file.name:
                    file = File(name)
                if not piece:
                    file.add(number, t)
                    continue
                at.append(i)
                found.append(None if name is None or t is None else file.page(t))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int32())), pa.array(found, pa.string())], ["row", "page"])

    by_file = told.unionByName(read).repartition("filename").sortWithinPartitions("filename", "piece", "page_no", "t")
    return by_file.mapInArrow(run, kind).select(*[F.col("row").getField(c).alias(c) for c in columns], "page")


def slides(docs: DataFrame, head: str = "slide") -> DataFrame:
    """(doc_id, page_no, text): slides of a text in which each is led by a line [slide n], without those lines."""
    parts = F.regexp_extract_all("text", F.lit(rf"(?s)(\[{head} \d+\]\n.*?)(?=\n\n\[{head} \d+\]\n|\z)"), F.lit(1))
    one = docs.select("doc_id", F.explode(parts).alias("part"))
    return one.select("doc_id", F.regexp_extract("part", r"^\[\w+ (\d+)\]", 1).cast("int").alias("page_no"), F.regexp_replace("part", r"^\[\w+ \d+\]\n", "").alias("text"))


def with_scans(pages: DataFrame, scans: DataFrame) -> DataFrame:
    """Pages of documents; one that has no text at all on its pages takes those of its scan, if there is one, split at blank lines."""
    bare = pages.groupBy("doc_id").agg(F.max(F.length(T.strip(F.coalesce("text", F.lit("")))) > 0).alias("any")).where("not any").select("doc_id")
    read = scans.join(bare, "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", r"\n\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page_no"), "text")
    return pages.join(read.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "page_no", "text").unionByName(read)


def assigned(chunks: DataFrame, pages: DataFrame, given: DataFrame, summary: str = "[summary]") -> DataFrame:
    """chunks with page, null where none is known.

    chunks has chunk_index, filename and text; pages has filename, page_no and
    text; given has filename and pages, the pages of its pieces in order, written
    down by hand. A file in given takes those, '' and missing ones giving none;
    summaries have no page; other pieces are located by their text without the
    first line, which repeats the end of the piece before.
    """
    nth = F.row_number().over(Window.partitionBy("filename").orderBy("chunk_index"))
    by_hand = chunks.join(given.select("filename", F.col("pages").alias("_given")), "filename").withColumn("_n", nth)
    by_hand = by_hand.withColumn("page", F.nullif(F.get("_given", F.col("_n") - 1), F.lit(""))).drop("_given", "_n")
    rest = chunks.join(given.select("filename"), "filename", "left_anti")
    skip = F.coalesce(F.startswith("text", F.lit(summary)), F.lit(False))
    body = F.when(F.instr("text", "\n") > 0, F.substring(F.col("text"), F.instr("text", "\n") + 1, F.length("text"))).otherwise(F.col("text"))
    solid = pages.select("filename", "page_no", T.no_space(F.coalesce("text", F.lit(""))).alias("t"))
    # Rows are told apart by themselves, so repeated numbers of pieces stay what they are.
    return by_hand.unionByName(in_files(rest.withColumn("_body", F.when(~skip, T.no_space(body))), solid))


def scoring_text(chunks: DataFrame, part: int = 500, budget: int = 3000) -> DataFrame:
    """(filename, body): a title line, then the first part of each piece in order until the parts before exceed the budget, cut there."""
    p = chunks.select("filename", "title", "chunk_index", F.left(F.coalesce("text", F.lit("")), F.lit(part)).alias("part"))
    before = Window.partitionBy("filename").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("before", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    kept = p.groupBy("filename").agg(F.min_by(F.coalesce("title", F.lit("")), "chunk_index").alias("title"), F.array_sort(F.collect_list(F.when(F.col("before") <= budget, F.struct("chunk_index", "part")))).alias("parts"))
    return kept.select("filename", F.left(F.concat(F.lit("title: "), "title", F.lit("\n"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n")), F.lit(budget)).alias("body"))
