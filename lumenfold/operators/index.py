"""A retrieval index as tables: pieces, postings, document frequencies, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as T


def chunk_documents(docs: DataFrame, key: str = "doc_id", size: int = 500, overlap: int = 100) -> DataFrame:
    """(key, chunk_no, text): the pieces of each text."""
    return docs.select(key, F.posexplode(T.chunks(F.col("text"), size, overlap)).alias("chunk_no", "text"))


def postings(chunks: DataFrame) -> DataFrame:
    """(token, chunk_index, tf, dl): words of the body once, of file stem and title three times each occurrence; dl is the length of the body in characters."""
    text = F.coalesce("text", F.lit(""))
    dl = F.length(text).alias("dl")
    body = chunks.select("chunk_index", F.explode(T.tokens(text)).alias("token"), F.lit(1).alias("w"), dl)
    stem = T.stem(F.coalesce("filename", F.lit("")))
    title = F.coalesce("title", F.lit(""))
    label = F.when((title != "") & (title != stem), F.concat_ws(" ", stem, title)).otherwise(stem)
    meta = chunks.select("chunk_index", F.explode(T.tokens(label)).alias("token"), F.lit(3).alias("w"), dl)
    return body.unionAll(meta).groupBy("chunk_index", "token").agg(F.sum("w").cast("bigint").alias("tf"), F.max("dl").alias("dl")).select("token", "chunk_index", "tf", "dl")


def weighted_tokens(chunks: DataFrame) -> DataFrame:
    """(chunk_index, token, tf) of the postings."""
    return postings(chunks).select("chunk_index", "token", "tf")


def doc_freq(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("df"))


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: pieces, files, sorted file list and status."""
    files = F.array_sort(F.collect_set(F.when(F.col("filename") != "", F.col("filename"))))
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct(F.when(F.col("filename") != "", F.col("filename"))).alias("n_files"), F.array_join(files, "|").alias("files")).withColumn(
        "status", F.when(F.col("n_chunks") > 0, "ready").otherwise("empty")
    )


def without_files(chunks: DataFrame, dropped: DataFrame) -> DataFrame:
    return chunks.join(dropped.select("filename"), "filename", "left_anti")


def unscored(chunks: DataFrame, scores: DataFrame) -> DataFrame:
    """(filename): files of the index that have no score."""
    return chunks.select("filename").where("filename <> ''").distinct().join(scores.select("filename"), "filename", "left_anti")


def joined_body(chunks: DataFrame, most: int = 20_000) -> DataFrame:
    """(filename, body): the pieces of a file in order, joined by line feeds and cut at most characters.

    Pieces that begin behind the cut are left out before a file is gathered.
    """
    before = Window.partitionBy("filename").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    text = F.coalesce("text", F.lit(""))
    near = chunks.withColumn("_before", F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))).where(F.col("_before") < most)
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", text.alias("text"))))
    return near.groupBy("filename").agg(F.left(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"), F.lit(most)).alias("body"))
