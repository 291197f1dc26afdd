"""Usage logs, tokens and accounts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(log: DataFrame, day: Column) -> DataFrame:
    """One row: requests, today's, distinct addresses of all and of today, reasoning requests and their rate in percent."""
    today = F.col("day") == day
    g = log.agg(
        F.count("*").alias("total"), F.count_if(today).alias("today"), F.count_distinct("ip").alias("visitors"), F.count_distinct(F.when(today, F.col("ip"))).alias("visitors_today"), F.count_if(F.col("think") == 1).alias("thinking"))
    return g.withColumn("think_rate", F.coalesce(F.round(F.try_divide(F.col("thinking") * 100.0, F.col("total")), 1), F.lit(0.0)))


def daily(log: DataFrame, last: DataFrame, days: int = 7) -> DataFrame:
    """(day, label, n) of the days up to the one in last, zeros included."""
    span = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return F.broadcast(span).join(log.groupBy("day").agg(F.count("*").alias("n")), "day", "left").select("day", F.date_format("day", "MM-dd").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def modes(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce(F.nullif("mode", F.lit("")), F.lit("lecture")).alias("mode")).agg(F.count("*").alias("n"))


def hot_keywords(log: DataFrame, words: list[str], k: int = 20) -> DataFrame:
    """(keyword, n): in how many prompts each word of a short list occurs, without regard to case, the k most frequent.

    The words are configuration, so each is a conditional sum of one pass.
    """
    row = log.agg(*[F.count_if(F.contains(F.lower("prompt"), F.lit(w.lower()))).alias(f"w{i}") for i, w in enumerate(words)])
    pairs = F.array(*[F.struct(F.lit(w).alias("keyword"), F.col(f"w{i}").alias("n"), F.lit(i).alias("i")) for i, w in enumerate(words)])
    return row.select(F.explode(pairs).alias("x")).select("x.*").where("n > 0").orderBy(F.desc("n"), "i").limit(k).drop("i")


def candidates(names: DataFrame, vocabulary: list[str], always: list[str]) -> DataFrame:
    """(word, n): words of a vocabulary by their occurrences in distinct names, then the words always offered."""
    d = names.distinct()
    count = lambda w: F.coalesce(F.sum(F.size(F.split(F.col("filename"), f"\\Q{w}\\E")) - 1), F.lit(0))
    row = d.agg(*[count(w).alias(f"w{i}") for i, w in enumerate(vocabulary)])
    pairs = [F.struct(F.lit(w).alias("word"), F.col(f"w{i}").cast("bigint").alias("n")) for i, w in enumerate(vocabulary)] + [F.struct(F.lit(w).alias("word"), F.lit(-1).cast("bigint").alias("n")) for w in always if w not in vocabulary]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").where("n <> 0")


def top_addresses(log: DataFrame, k: int = 10) -> DataFrame:
    return log.where("ip is not null").groupBy("ip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ip").limit(k)


def page(log: DataFrame, number: int, size: int) -> DataFrame:
    return log.orderBy(F.desc("id")).offset((number - 1) * size).limit(size)


def page_count(log: DataFrame, size: int) -> DataFrame:
    """One row: the number of rows and of pages of them, at least one page."""
    return log.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("bigint"))


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the rows of the keys; rows without a key stay."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The last row of each key: an upsert over an append-only table."""
    w = Window.partitionBy(key).orderBy(F.desc(by))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def valid_tokens(tokens: DataFrame, now: Column, revoked: DataFrame) -> DataFrame:
    return tokens.where(F.col("expires") > now).join(revoked, "account", "left_anti")


def password_hash(salt: Column, secret: Column) -> Column:
    return F.concat(F.lit("sha256:"), salt, F.lit(":"), F.sha2(F.concat(salt, secret), 256))


def password_ok(secret: Column, stored: Column, salt: Column) -> Column:
    """Whether a secret is that of a stored hash, or of a stored plain text from before there were hashes; nothing stored fails."""
    kept = F.coalesce(stored, F.lit(""))
    return F.when(kept == "", F.lit(False)).when(F.startswith(kept, F.lit("sha256:")), kept == password_hash(salt, secret)).otherwise(kept == secret)


def client_ip(forwarded: Column) -> Column:
    return F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))


def limiter(state: list[float], t: float, limit: int, window: float) -> tuple[bool, int]:
    """Whether a request at t is let in, and the seconds to wait otherwise; state, the times let in, is updated in place.

    A time exactly window old still counts; refused requests are not recorded.
    """
    while state and state[0] < t - window:
        state.pop(0)
    if len(state) >= limit:
        return False, int(window - (t - state[0])) + 1
    state.append(t)
    return True, 0


def rate_limit(requests: DataFrame, limit: int = 20, window: float = 60.0) -> DataFrame:
    """(account, id, t, allowed, retry_after) of requests with account, id and t in seconds, in order of t and id.

    The fold depends on order, so a key is read in order; rows stream through in
    Arrow batches and only the last limit times of the current key are held, so a
    hot key costs one sequential pass and no memory. Rows without account or t
    are left out.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, []
        for b in batches:
            out = []
            for a, i, t in zip(b["account"], b["id"], b["t"]):
                if a != key:
                    key, state = a, []
                ok, wait = limiter(state, t, limit, window)
                out.append((a, i, t, ok, wait))
            yield pd.DataFrame(out, columns=["account", "id", "t", "allowed", "retry_after"])

    few = requests.where("account is not null and t is not null").select("account", "id", F.col("t").cast("double").alias("t"))
    ordered = few.repartition("account").sortWithinPartitions("account", "t", "id")
    return ordered.mapInPandas(fold, f"account {dict(few.dtypes)['account']}, id {dict(few.dtypes)['id']}, t double, allowed boolean, retry_after int")
