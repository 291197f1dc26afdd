"""Scores of evidence in five dimensions, tiers, and how stable these are under other weights."""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.rounding import exact_round
from lumenfold.operators.retrieval import tier

DIMENSIONS = ("study", "venue", "method", "recency", "consensus")
# Weights of the dimensions, and scores of the age of a source in years.
WEIGHTS = (0.30, 0.25, 0.20, 0.15, 0.10)
AGES = ((5, 1.0), (10, 0.8), (20, 0.6))
OLDER = 0.4


def _reaches(score: float, places: int = 3) -> float:
    """The smallest double that rounds to score or more at so many places, by its exact binary value."""
    short, x = score - 10**-places, score
    while short < (mid := (short + x) / 2) < x:
        short, x = (short, mid) if round(mid, places) >= score else (mid, x)
    return x


A_SUM, B_SUM = _reaches(0.8), _reaches(0.6)


def weighted(weights: tuple[float | Column, ...] = WEIGHTS) -> Column:
    """The weighted sum, left to right; a missing dimension is 0."""
    total = None
    for d, w in zip(DIMENSIONS, weights):
        x = F.coalesce(F.col(d), F.lit(0.0)) * F.lit(w)
        total = x if total is None else total + x
    return total


def scored(dims: DataFrame) -> DataFrame:
    return dims.withColumn("credibility", exact_round(weighted(), 3)).withColumn("tier", tier(F.col("credibility")))


def recency(year: Column, now: int = 2026, kind: Column | None = None, archival: tuple[str, ...] = ()) -> Column:
    """The score of a source's age; kinds that do not age have the highest, an unknown year none."""
    age, out = F.lit(now) - year, F.when(year.isNull(), None)
    if kind is not None and archival:
        out = F.when(kind.isin(*archival), AGES[0][1]).when(year.isNull(), None)
    for most, score in AGES:
        out = out.when(age <= most, score)
    return out.otherwise(OLDER)


def graded(records: DataFrame, column: str, scores: DataFrame, name: str, default: float) -> DataFrame:
    """records with name, the score that a dimension table (column, score) gives to the value of a column, else the default."""
    return records.join(scores.select(F.col(column), F.col("score").alias(name)), column, "left").fillna({name: default})


def tier_of_sum(total: Column) -> Column:
    """The tier of a weighted sum after rounding to three places, without rounding: two bounds say the same."""
    return F.when(total >= A_SUM, "A").when(total >= B_SUM, "B").otherwise("C")


def without(dims: DataFrame, names: tuple[str, ...], every: bool = False) -> DataFrame:
    """dims without the files named, unless every file is asked for."""
    return dims if every or not names else dims.where(F.col("filename").isNull() | ~F.col("filename").isin(*names))


def targets(files: DataFrame, done: DataFrame, rescore: bool = False) -> DataFrame:
    """Files still to be scored: all without a good record, or all on rescore."""
    return files if rescore else files.join(done.where("error is null").select("filename"), "filename", "left_anti")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """One record a file; the new one wins."""
    return old.join(new.select("filename"), "filename", "left_anti").unionByName(new)


def tier_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("tier", F.lit("?")).alias("tier")).agg(F.count("*").alias("n"))


def perturbed(delta: float = 0.05) -> list[tuple[str, tuple[float, ...]]]:
    """Ten weight vectors, each with one weight changed by delta up or down, scaled back to sum 1."""
    out = []
    for i, d in enumerate(DIMENSIONS):
        for sign in (1, -1):
            w = [x + sign * delta * (k == i) for k, x in enumerate(WEIGHTS)]
            out.append((f"{d}{'+' if sign > 0 else '-'}", tuple(x / sum(w) for x in w)))
    return out


def random_weights(n: int = 1000, delta: float = 0.05, seed: int = 42) -> list[tuple[str, tuple[float, ...]]]:
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = [x + rng.uniform(-delta, delta) for x in WEIGHTS]
        out.append((str(k), tuple(x / sum(w) for x in w)))
    return out


def changes(spark: SparkSession, dims: DataFrame, vectors: list[tuple[str, tuple[float, ...]]]) -> DataFrame:
    """(vector, n_changed, a_left): files whose tier differs from that of the usual weights, and those of them that were A, for each of a list of vectors.

    Files alike in all dimensions count as one row with their number. The
    vectors are an exploded literal, so that thousands of them make one short plan.
    """
    listed = F.explode(F.from_json(F.lit(json.dumps([{"vector": n, "w": w} for n, w in vectors])), "array<struct<vector: string, w: array<double>>>")).alias("v")
    alike = dims.groupBy(*DIMENSIONS).agg(F.count("*").alias("n")).withColumn("base", tier_of_sum(weighted(tuple(w / sum(WEIGHTS) for w in WEIGHTS))))
    other = tier_of_sum(weighted(tuple(F.col("v.w")[i] for i in range(len(DIMENSIONS))))) != F.col("base")
    found = alike.select("*", listed).select("v.vector", F.when(other, F.col("n")).otherwise(0).alias("n_changed"), F.when(other & (F.col("base") == "A"), F.col("n")).otherwise(0).alias("a_left"))
    none = spark.range(1).select(listed).select("v.vector", F.lit(0).cast("bigint").alias("n_changed"), F.lit(0).cast("bigint").alias("a_left"))  # each vector has a row, also without files
    return found.unionAll(none).groupBy("vector").agg(F.sum("n_changed").alias("n_changed"), F.sum("a_left").alias("a_left"))
