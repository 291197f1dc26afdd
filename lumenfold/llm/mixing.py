"""A training mix with target shares per source, as a curriculum over positions.

Each source has a weight that changes along the mix; its integral is the demand
for tokens of the source up to a position. A copy of a document takes its place
where the cumulative demand of its source meets its cumulative supply; the copies
are then range-sorted by position.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.plans import lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How words are cut before byte pairs are merged: fixed values of the public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 256


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs (any columns and text) with n_tokens instead of text; null and blank texts have 0.

    The vocabulary is read by the driver and sent to the tasks; it is of a fixed size.
    """
    with open(tokenizer, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        enc = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t and t.strip() else 0 for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", F.pandas_udf(count, "bigint")("text")).drop("text")


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, no outer blanks, underscores for hyphens and blanks."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[-\s]+", "_")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, tilt: float = 0.5, tokenizer: str = TOKENIZER) -> DataFrame:
    """(position, doc_id, copy, source, n_tokens, progress) of the mix, position from 0.

    docs has doc_id, source and text; targets has source, target_share and
    max_repeat, one row each, few. Shares of sources without tokens are spread
    over the others. Without total_tokens the mix is the largest that meets all
    shares within max_repeat. Weights go linearly along the mix: sources that
    repeat more come later, tilt 0 keeps all even. Documents of other or null
    sources, without text or id are not used; repeated rows are documents of
    their own. An empty table gives no rows.
    """
    sized = lineage.written(
        token_counts(docs.select(F.col("doc_id").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").alias("text"))
                     .join(F.broadcast(_few(targets).select("source")), "source", "left_semi"), tokenizer)
        .where("n_tokens > 0 and doc_id is not null")
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("b", F.pmod("h", F.lit(BUCKETS)).cast("int")),
        "sized",
    )
    # Two-level prefix sums: within a bucket of a source, and over the bucket totals.
    buckets = sized.groupBy("source", "b").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = buckets.select("source", "b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"), F.sum("t").over(Window.partitionBy("source")).alias("supply"))
    plan = _demand(base, targets, total_tokens, tilt)
    here = Window.partitionBy("source", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # Both sides of these joins have at most sources x BUCKETS rows.
    placed = (
        sized.withColumn("upto", F.sum("n_tokens").over(here))
        .join(F.broadcast(base.select("source", "b", "base", "supply")), ["source", "b"])
        .join(F.broadcast(plan), "source")
        .withColumn("mid", F.col("base") + F.col("upto") - F.col("n_tokens") / 2)
        .withColumn("copy", F.explode(F.expr("sequence(0, greatest(cast(least(max_repeat, ceil(demand / supply)) as int) - 1, 0))")))
        .withColumn("mid", F.col("mid") + F.col("copy") * F.col("supply"))
        .where("mid <= demand and max_repeat > 0")
        .withColumn("progress", _invert(F.col("mid") / F.col("demand"), F.col("slope")))
        .select("doc_id", "copy", "source", "n_tokens", "progress", "h")
    )
    return lineage.numbered(placed, ["progress", "h", "doc_id", "copy"], "position", "mix").select("position", "doc_id", "copy", "source", "n_tokens", "progress")


def _few(targets: DataFrame) -> DataFrame:
    return targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeat").where("source is not null and target_share > 0")


def _demand(base: DataFrame, targets: DataFrame, total: int | None, tilt: float) -> DataFrame:
    """(source, max_repeat, demand, slope): tokens wanted of each source, and how its weight goes along the mix."""
    supply = base.groupBy("source").agg(F.first("supply").alias("supply"))
    everything = Window.partitionBy()  # one row a source
    t = F.broadcast(_few(targets)).join(supply, "source").withColumn("share", F.col("target_share") / F.sum("target_share").over(everything))
    most = F.min(F.col("max_repeat") * F.col("supply") / F.col("share")).over(everything)
    t = t.withColumn("demand", F.col("share") * (F.least(F.lit(float(total)), most) if total is not None else most))
    t = t.withColumn("lean", F.ln(F.col("max_repeat") + F.lit(1.0)))
    t = t.withColumn("lean", F.col("lean") - F.sum(F.col("lean") * F.col("share")).over(everything))
    widest = F.max(F.abs("lean")).over(everything)
    return t.withColumn("slope", F.when(widest > 1e-12, tilt * F.col("lean") / widest).otherwise(F.lit(0.0))).select("source", "max_repeat", "demand", "slope")


def _invert(share: Column, slope: Column) -> Column:
    """Where a source has met that share of its demand, if its weight is proportional to 1 + slope * (2x - 1)."""
    root = (slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, share).otherwise(root)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_docs, n_copies, most_copies); sources without documents have zeros."""
    got = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum(F.when(F.col("copy") == 0, 1).otherwise(0)).alias("n_docs"),
        F.count("*").alias("n_copies"), (F.max("copy") + 1).alias("most_copies"))
    zero = {c: 0 for c in ("n_tokens", "n_docs", "n_copies", "most_copies")}
    full = F.broadcast(_few(targets).drop("max_repeat")).join(got, "source", "left").fillna(zero)
    actual = F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy())  # one row a source
    return full.select("source", "target_share", F.coalesce(actual, F.lit(0.0)).alias("actual_share"), *zero)
