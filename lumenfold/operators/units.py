"""Values of one quantity in common units, and unit changes within source histories.

The history of a source is what it says of one quantity, as numbers are
written, in order. Each history is segmented by exact penalised changepoint
search on log10 values. A segment proposes the unit of its numbers: the usual
one of those that state a unit or, where none does, that of the segment before,
reversed by the known factor that the level shifts by. Numbers are converted by
the unit proposed; an exact check against the text follows, and where the text
states another unit, that one holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import quantities
from lumenfold.plans import lineage

#: Powers of ten by which two customary units of one quantity differ.
FACTORS = (3, 6, 9, 4, 2, 1)
#: Numbers searched at once, and how many of their neighbours on either side are searched with them.
BLOCK, HALO = 32_768, 4_096


def changepoints(x: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments of x that minimise squared error plus penalty per segment.

    Exact search by dynamic programming; candidates that can never be best
    again are pruned, which leaves the optimum as it is.
    """
    n = len(x)
    if n < 2:
        return [0] if n else []
    # No split can save more than all of the squared error.
    if float(((x - x.mean()) ** 2).sum()) <= penalty:
        return [0]
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    best[0] = -penalty
    open_at = np.array([0], dtype=np.int64)
    for t in range(1, n + 1):
        cost = best[open_at] + q[t] - q[open_at] - (s[t] - s[open_at]) ** 2 / (t - open_at)
        k = int(np.argmin(cost))
        best[t], last[t] = cost[k] + penalty, open_at[k]
        open_at = np.append(open_at[cost <= best[t]], t)
    starts, t = [], n
    while t > 0:
        t = int(last[t])
        starts.append(t)
    return starts[::-1]


def stated_values(rows: DataFrame, text: str = "endpoint", key: str = "entry_id", source: str = "filename") -> DataFrame:
    """(source, key, pos, quantity, assay, log_raw, power, common_value), one row for each number read.

    common_value is null where no unit is stated, or where it would not fit a
    bigint. Null and blank texts give no rows. Other columns are left behind, so
    their names cannot clash.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for src, k, t in zip(b["source"], b["key"], b["t"]):
                assay = quantities.assay(t)
                for i, (_, quantity, v, power) in enumerate(quantities.read(t)):
                    common = None if power is None else int(v.scaleb(power).to_integral_value())
                    out.append((src, k, i, quantity, assay, float(v.log10()) if v > 0 else None, power, common if common is None or abs(common) < 2**63 else None))
            yield pd.DataFrame(out, columns=["source", "key", "pos", "quantity", "assay", "log_raw", "power", "common_value"]).astype(
                {"key": "Int64", "pos": "Int32", "power": "Int32", "common_value": "Int64", "log_raw": "Float64"}
            )

    few = rows.select(F.col(source).alias("source"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("t")).where("t is not null and trim(t) <> ''")
    return few.mapInPandas(parse, "source string, key bigint, pos int, quantity string, assay string, log_raw double, power int, common_value bigint")


def _searched(pdf: pd.DataFrame, penalty: float) -> pd.DataFrame:
    """The own rows of one block with start and before: where their segment and the one before it begin, -1 if ahead of what is seen."""
    pdf = pdf.sort_values("at", kind="stable", ignore_index=True)
    x, at = pdf["log_raw"].to_numpy(dtype=float, na_value=np.nan, copy=True), pdf["at"].to_numpy(np.int64)
    source, quantity = pdf["source"].fillna("\0").to_numpy(), pdf["quantity"].fillna("\0").to_numpy()
    new = np.ones(len(pdf), bool)
    new[1:] = (source[1:] != source[:-1]) | (quantity[1:] != quantity[:-1])
    edges = [*np.flatnonzero(new), len(pdf)]
    start, before = np.full(len(pdf), -1, np.int64), np.full(len(pdf), -1, np.int64)
    cut = at[0] > 0  # the first history seen may begin ahead of the block
    for lo, hi in zip(edges, edges[1:]):
        own = x[lo:hi]
        if np.isnan(own).any():  # a zero has no logarithm and takes the mean of the others
            own = np.where(np.isnan(own), np.nanmean(own) if (~np.isnan(own)).any() else 0.0, own)
        parts = [lo + k for k in changepoints(own, penalty)] + [hi]
        for k, (a, b) in enumerate(zip(parts, parts[1:])):
            start[a:b] = -1 if cut and not lo and not k else at[a]
            before[a:b] = at[a] if not k else start[parts[k - 1]]
    # before is the segment's own start where its history has no segment before it.
    return pdf.assign(start=start, before=before)[pdf["own"]]


def unit_segments(values: DataFrame, penalty: float = 4.0, block: int = BLOCK, halo: int = HALO, tolerance: float = 0.35) -> DataFrame:
    """values with at, segment, level, usual, shift, factor and proposed by history (source, quantity).

    The numbers of all histories are numbered in order and searched in blocks of
    equal size, each with its neighbours on either side, so no task holds more
    than block + 2 * halo numbers however hot a source is, and the edge of a
    block begins no segment. A history of at most halo numbers is searched as a
    whole. A number without unit belongs to the quantity that its assay usually
    gives. segment is the number at which it begins. factor is the known power of
    ten within tolerance of the shift of the level, else null; proposed is the
    power of ten from the numbers as written to the common unit.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The rows of a block come together; blocks are small, so one is held at a time.
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf["b"].iloc[-1] if len(pdf) else None
            held = pdf[pdf["b"] == last]
            for _, g in pdf[pdf["b"] != last].groupby("b", sort=False):
                yield _searched(g, penalty)
        if held is not None and len(held):
            yield _searched(held, penalty)

    # As many rows as there are names of assays, which are a fixed list.
    usual = values.where("quantity is not null and assay is not null").groupBy("assay", "quantity").agg(F.count("*").alias("n")).groupBy("assay").agg(F.max_by("quantity", F.struct("n", "quantity")).alias("_usual_quantity"))
    filled = values.join(F.broadcast(usual), "assay", "left").withColumn("quantity", F.coalesce("quantity", "_usual_quantity")).drop("_usual_quantity")
    placed = lineage.numbered(filled, ["source", "quantity", "key", "pos"], "at", "histories")
    b, within = F.floor(F.col("at") / block), F.col("at") % block
    copies = F.filter(F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.when((within < halo) & (b > 0), F.struct((b - 1).alias("b"), F.lit(False).alias("own"))), F.when(within >= block - halo, F.struct((b + 1).alias("b"), F.lit(False).alias("own")))), lambda c: c.isNotNull())
    seen = (
        placed.withColumn("common_value", F.col("common_value").cast("string"))  # pandas would make a nullable bigint a double
        .select("*", F.inline(copies)).repartition("b").sortWithinPartitions("b")
    )
    fields = ", ".join(f"{c} {t}" for c, t in seen.dtypes)
    cut = lineage.written(seen.mapInPandas(search, f"{fields}, start bigint, before bigint").drop("own"), "segments")
    # A segment that begins ahead of what a block sees is the last one to begin in the blocks before; one row a block.
    ahead = F.max("last").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    begun = cut.groupBy("b").agg(F.max("start").alias("last")).select("b", F.coalesce(ahead, F.lit(0)).alias("_open"))
    rows = cut.join(begun, "b").withColumns({"segment": F.when(F.col("start") < 0, F.col("_open")).otherwise(F.col("start")), "before": F.when(F.col("before") < 0, F.col("_open")).otherwise(F.col("before"))})
    levels = rows.groupBy("segment").agg(F.avg("log_raw").alias("level"), F.mode("power", deterministic=True).alias("usual"), F.min("before").alias("before"))
    earlier = levels.select(F.col("segment").alias("before"), F.col("level").alias("_level"), F.col("usual").alias("_usual"))
    levels = levels.join(earlier, "before", "left").withColumn("shift", F.when(F.col("before") != F.col("segment"), F.col("level") - F.col("_level")))
    gap = F.abs(F.col("shift"))
    factor = F.coalesce(*[F.when(F.abs(gap - f) <= tolerance, F.signum("shift") * f) for f in FACTORS]).cast("int")
    levels = levels.withColumn("factor", factor).withColumn("proposed", F.coalesce("usual", F.col("_usual") - F.col("factor")))
    return (
        rows.join(levels.select("segment", "level", "usual", "shift", "factor", "proposed"), "segment")
        .withColumn("common_value", F.col("common_value").cast("bigint"))
        .select("source", "key", "pos", "quantity", "assay", "log_raw", "power", "common_value", "at", "segment", "level", "usual", "shift", "factor", "proposed")
    )


def harmonised(rows: DataFrame, **names: str) -> DataFrame:
    """(source, key, pos, quantity, common_value, segment, shift, factor, decided): every number in its common unit.

    decided tells what the unit rests on: segment, where the text states none
    other than the history proposes; text, where the text states another;
    history, where the text states none. A number without unit stays null if its
    history proposes none. Repeated rows are repeated; without rows there are none.
    """
    seg = unit_segments(lineage.written(stated_values(rows, **names), "values"))  # texts are read once
    reversed_ = F.round(F.pow(F.lit(10.0), F.col("log_raw") + F.col("proposed"))).cast("bigint")
    # The exact decimal of the text stands for the value reversed in floating point; both are the same where the units are.
    decided = F.when(F.col("power").isNull(), "history").when(F.col("power") == F.col("proposed"), "segment").otherwise("text")
    return seg.select("source", "key", "pos", "quantity", F.when(F.col("power").isNull(), reversed_).otherwise(F.col("common_value")).alias("common_value"), "segment", "shift", "factor", decided.alias("decided"))
