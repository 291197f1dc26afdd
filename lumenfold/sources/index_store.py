"""A retrieval index in a folder: pieces, postings with lengths, document frequencies and totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import index

PIECES = "chunk_index bigint, filename string, title string, text string, page string"
POSTINGS = "token string, chunk_index bigint, tf bigint, dl int"
DF = "token string, df bigint"
TOTALS = "n bigint, avgdl double"


@dataclass
class Index:
    pieces: DataFrame
    postings: DataFrame
    doc_freq: DataFrame
    totals: DataFrame


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save(chunks: DataFrame, path: str) -> None:
    """Writes the index of chunks in place of what the folder holds; the totals last, so a folder with them is whole.

    Postings stay as their aggregation leaves them, sorted by token within each
    file, so a query reads few row groups of each; the postings of one token lie
    in many files, however common it is.
    """
    pieces = chunks.select(F.col("chunk_index").cast("bigint"), "filename", "title", "text", "page")
    pieces.write.mode("overwrite").parquet(f"{path}/pieces")
    spark = chunks.sparkSession
    kept = spark.read.schema(PIECES).parquet(f"{path}/pieces")
    index.postings(kept).sortWithinPartitions("token", "chunk_index").write.mode("overwrite").parquet(f"{path}/postings")
    index.doc_freq(spark.read.schema(POSTINGS).parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/doc_freq")
    kept.agg(F.count("*").alias("n"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/totals")


def load(spark: SparkSession, *paths: str) -> Index:
    """The index in the first of the folders that holds one; an empty index if none does."""
    path = next((p for p in paths if exists(spark, f"{p}/totals/_SUCCESS")), None)
    parts = (("pieces", PIECES), ("postings", POSTINGS), ("doc_freq", DF), ("totals", TOTALS))
    return Index(*[spark.read.schema(s).parquet(f"{path}/{n}") if path else spark.createDataFrame([], s) for n, s in parts])
