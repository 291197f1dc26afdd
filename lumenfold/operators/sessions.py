"""Sessions separated by inactivity, as a sweep over +1/-1 deltas.

Each event adds one at its start and takes one away at its end plus the gap.
Where the running sum per key returns to zero the session closes. The running
sum is built in two levels, within time buckets and over bucket totals, so no
task ever sorts all events of a hot key: the largest window partition is one
key in one bucket, and the upper level holds at most span / bucket rows a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 1_800_000
BUCKET_MS = 3_600_000


def utc_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of ISO 8601 text that is always UTC; null if it is no time."""
    bare = F.regexp_replace(F.trim(ts), r"(?i)\s*(z|utc|[+-]00:?00)$", "")
    return F.unix_millis(F.concat(bare, F.lit("Z")).try_cast("timestamp"))


def chat_events(chat_log: DataFrame) -> DataFrame:
    """(user_id, id, start_ms, end_ms) of a request log, each id once.

    Outer blanks and case of user_id are ignored; rows without user_id, id or a
    readable ts are left out; a null or negative duration counts as 0.
    """
    end = utc_millis(F.col("ts"))
    took = F.greatest(F.coalesce(F.col("duration_ms").cast("bigint"), F.lit(0)), F.lit(0))
    user = F.lower(F.regexp_replace("user_id", r"(?U)^\s+|\s+$", ""))
    return (
        chat_log.select(user.alias("user_id"), "id", (end - took).alias("start_ms"), end.alias("end_ms"))
        .where("user_id <> '' and id is not null and end_ms is not null")
        .dropDuplicates(["id"])
    )


def sessionize(events: DataFrame, key: str, gap_ms: int = GAP_MS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, start_ms, end_ms, duration_ms, n_events), one row for each session.

    events has key, start_ms and end_ms. An event that starts more than gap_ms
    after the latest end so far opens a session; one that starts exactly gap_ms
    after it does not. An end before its start counts as the start. Rows with a
    null key or time are left out; an empty table gives no rows; repeated rows
    each count, so remove repeated deliveries first. Other columns are ignored.
    """
    end = F.greatest("start_ms", "end_ms")
    deltas = (
        events.where(F.col(key).isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
        .select(F.col(key).alias("k"), F.explode(F.array(
            F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")),
            F.struct((end + gap_ms).alias("t"), F.lit(-1).alias("d")),
        )).alias("x"))
        .select("k", "x.t", "x.d", F.floor(F.col("x.t") / bucket_ms).alias("b"))
        .repartition("k", "b")
    )
    in_bucket = Window.partitionBy("k", "b").orderBy("t", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("d") + 1) / 2
    base = (
        deltas.groupBy("k", "b").agg(F.sum("d").alias("s"), F.sum(opens.cast("bigint")).alias("n"))
        .select("k", "b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    )
    swept = (
        deltas.withColumns({"s": F.sum("d").over(in_bucket), "n": F.sum(opens.cast("bigint")).over(in_bucket)})
        .join(base, ["k", "b"])
        .select("k", "t", "d", (F.col("s") + F.col("s0")).alias("s"), (F.col("n") + F.col("n0")).alias("n"))
        .where("(d = 1 and s = 1) or (d = -1 and s = 0)")
    )
    # Only the opening and the closing of each session are left: at most span / gap of either a key.
    pair = Window.partitionBy("k").orderBy("t", F.desc("d"))
    return (
        swept.withColumns({"t2": F.lead("t").over(pair), "n2": F.lead("n").over(pair)})
        .where("d = 1")
        .select(
            F.col("k").alias(key), F.col("t").alias("start_ms"), (F.col("t2") - gap_ms).alias("end_ms"),
            (F.col("t2") - gap_ms - F.col("t")).alias("duration_ms"), (F.col("n2") - F.col("n") + 1).alias("n_events"),
        )
    )
