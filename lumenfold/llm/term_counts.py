"""How often every term occurs, in all and in how many rows.

Each block of rows is encoded against its own dictionary and counted in two
integer arrays (occurrences, rows holding the term). The distinct terms get
global ids by range-sorting; block counts are sent to the id range they belong
to, and the arrays of a range are summed there. What crosses the network is one
pair of numbers per term and block, however often a hot term occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans import lineage

_RUN = re.compile(r"[a-z]{2,}|[一-鿿]{2,}")
ID_RANGE = 4096
#: Distinct terms a block may gather before its counts are passed on.
BLOCK_TERMS = 200_000


def terms(text: str) -> list[str]:
    """Runs of two or more letters a-z of the lower-cased text, and pairs of adjacent Chinese characters."""
    out = []
    for run in _RUN.findall(text.lower()):
        if run[0] <= "z":
            out.append(run)
        else:
            out += [run[i:i + 2] for i in range(len(run) - 1)]
    return out


def _block_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids: dict[str, int] = {}
    occ, rows = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def passed() -> pd.DataFrame:
        n = len(ids)
        return pd.DataFrame({"term": list(ids), "occ": occ[:n], "n_rows": rows[:n]})

    for batch in batches:
        for text in batch["text"]:
            if text is None:
                continue
            found = terms(text)
            if not found:
                continue
            code = np.fromiter((ids.setdefault(t, len(ids)) for t in found), np.int64, len(found))
            if len(ids) > len(occ):
                more = np.zeros(max(len(occ), len(ids) - len(occ)), np.int64)
                occ, rows = np.concatenate([occ, more]), np.concatenate([rows, more])
            one, times = np.unique(code, return_counts=True)
            occ[one] += times
            rows[one] += 1
        if len(ids) > BLOCK_TERMS:
            yield passed()
            ids, occ, rows = {}, np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    if ids:
        yield passed()


def dictionary(distinct: DataFrame) -> DataFrame:
    """(term, term_id): ids from 0 without gaps, in the order of the terms.

    An id is the place within a range partition plus the sizes of those before it.
    """
    return lineage.numbered(distinct, ["term"], "term_id", "terms")


def term_counts(rows: DataFrame, text: str = "text", id_range: int = ID_RANGE) -> DataFrame:
    """(term, term_id, occurrences, n_rows) over all rows.

    Null and blank texts hold no term; an empty table gives no rows; repeated
    rows each count. Other columns are ignored.
    """
    blocks = lineage.written(rows.select(F.col(text).alias("text")).mapInPandas(_block_counts, "term string, occ bigint, n_rows bigint"), "blocks")
    ids = lineage.written(dictionary(blocks.select("term").distinct()), "dictionary")
    encoded = blocks.join(ids, "term").select((F.col("term_id") % id_range).cast("int").alias("at"), F.floor(F.col("term_id") / id_range).alias("r"), "occ", "n_rows")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task holds whole id ranges; each has two arrays of id_range counts.
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, part in b.groupby("r"):
                a = sums.setdefault(int(r), np.zeros((2, id_range), np.int64))
                np.add.at(a[0], part["at"].to_numpy(), part["occ"].to_numpy())
                np.add.at(a[1], part["at"].to_numpy(), part["n_rows"].to_numpy())
        for r, a in sums.items():
            at = np.flatnonzero(a[0])
            yield pd.DataFrame({"term_id": r * id_range + at, "occurrences": a[0][at], "n_rows": a[1][at]})

    sums = encoded.repartition("r").mapInPandas(summed, "term_id bigint, occurrences bigint, n_rows bigint")
    return sums.join(ids, "term_id").select("term", "term_id", "occurrences", "n_rows")


def marked(counts: DataFrame, rows: DataFrame, rare: int = 2, common: float = 0.2) -> DataFrame:
    """counts with mark: rare for at most that many rows, common for more than that share of all rows, else null.

    A term that is both (in a tiny table) is rare.
    """
    total = rows.agg(F.count("*").alias("total"))  # one row
    mark = F.when(F.col("n_rows") <= rare, "rare").when(F.col("n_rows") > F.col("total") * common, "common")
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("total")
