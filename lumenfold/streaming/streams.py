"""Streams: daily counts, request limits, token streams cut at markers, token expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.operators.logs import limiter


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n); on a stream, rows later than the watermark are dropped and earlier ones update their day."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def limited(requests: DataFrame, limit: int = 20, window: float = 60.0) -> DataFrame:
    """(account, id, t, allowed, retry_after) of a stream of requests; the state of an account is the times let in, at most limit of them, and its clock.

    The clock of an account never runs back: a request that comes with an earlier
    time than one before it is judged at the time of that one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, clock = (list(state.get[0]), state.get[1]) if state.exists else ([], float("-inf"))
        rows = pd.concat(list(batches)).sort_values(["t", "id"])  # a micro-batch of one account
        out = []
        for i, t in zip(rows["id"], rows["t"]):
            clock = max(clock, t)
            out.append((key[0], i, t, *limiter(times, clock, limit, window)))
        state.update((times, clock))
        yield pd.DataFrame(out, columns=["account", "id", "t", "allowed", "retry_after"])

    return requests.groupBy("account").applyInPandasWithState(step, "account string, id long, t double, allowed boolean, retry_after int", "times array<double>, clock double", "append", GroupStateTimeout.NoTimeout)


class Shown:
    """What a token stream shows so far: nothing from the first marker or the second heading on, even if these are split over tokens."""

    def __init__(self, marker: str, heading: str | None, held: str = "", heads: int = 0, stopped: bool = False) -> None:
        self.stops, self.heading = [x for x in (marker, heading) if x], heading
        self.held, self.heads, self.stopped = held, heads, stopped

    def add(self, token: str) -> str:
        if self.stopped:
            return ""
        self.held += token
        out = ""
        while (hit := min(((at, x) for x in self.stops if (at := self.held.find(x)) >= 0), default=None)) is not None:
            at, what = hit
            if what == self.heading and not self.heads:
                out, self.held, self.heads = out + self.held[:at + len(what)], self.held[at + len(what):], 1
                continue
            self.stopped = True
            out, self.held = out + self.held[:at], ""
            return out
        # The end of what is held may be the beginning of something that stops the stream.
        keep = max((n for x in self.stops for n in range(1, min(len(x) - 1, len(self.held)) + 1) if x.startswith(self.held[-n:])), default=0)
        out, self.held = out + self.held[:len(self.held) - keep], self.held[len(self.held) - keep:]
        return out

    def end(self) -> str:
        """What is still held when the stream ends."""
        out, self.held = self.held, ""
        return out


def shown(tokens: DataFrame, marker: str, heading: str | None = None, first: int = 1) -> DataFrame:
    """(conv, seq, text): what each token of a stream (conv, seq from first, token) shows; a null token ends a conversation.

    Tokens that come before their turn wait for those between, repeated ones are
    dropped. The state of a conversation is the text held back (shorter than a
    marker), what has been seen, the next number and the tokens that wait.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, heads, stopped, due, numbers, waiting = state.get if state.exists else ("", 0, False, first, [], [])
        queue = dict(zip(numbers, waiting))
        for b in batches:
            queue.update({int(s): t if isinstance(t, str) else None for s, t in zip(b["seq"], b["token"]) if s >= due})
        view, out = Shown(marker, heading, held, heads, stopped), []
        while due in queue:
            token = queue.pop(due)
            out.append((key[0], due, view.add(token) if token is not None else view.end()))
            due += 1
        state.update((view.held, view.heads, view.stopped, due, list(queue), list(queue.values())))
        yield pd.DataFrame(out, columns=["conv", "seq", "text"])

    return tokens.groupBy("conv").applyInPandasWithState(
        step, "conv string, seq long, text string", "held string, heads int, stopped boolean, due long, numbers array<long>, waiting array<string>", "append", GroupStateTimeout.NoTimeout)


def split_kinds(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reasoning and the content of a stream of two kinds."""
    return stream.where("kind = 'reasoning'"), stream.where("kind = 'content'")


def live_tokens(tokens: DataFrame, ttl: float = 7 * 86_400.0, late: str = "1 hour") -> DataFrame:
    """(token, account, at, state) of a stream of tokens (token, account, seen): live when a token is issued, expired when its time to live has passed.

    A token that is seen again lives on from then. The state of a token is dropped
    as it expires, when the watermark passes the end of its time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["token", "account", "at", "state"]
        if state.hasTimedOut:
            account, ends = state.get
            state.remove()
            yield pd.DataFrame([(key[0], account, pd.Timestamp(ends, unit="ms"), "expired")], columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values("seen")
        known = state.exists
        ends = int(rows["seen"].iloc[-1].timestamp() * 1000 + ttl * 1000)
        ends = max(ends, state.get[1]) if known else ends
        state.update((rows["account"].iloc[0], ends))
        state.setTimeoutTimestamp(ends)
        yield pd.DataFrame([] if known else [(key[0], rows["account"].iloc[0], rows["seen"].iloc[0], "live")], columns=columns)

    return tokens.withWatermark("seen", late).groupBy("token").applyInPandasWithState(
        step, "token string, account string, at timestamp, state string", "account string, ends long", "append", GroupStateTimeout.EventTimeTimeout)


def on_finish(stream: DataFrame, effects: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts a query that hands the rows of ended answers (done) of each micro-batch to a list of effects, in order: reports, tails, log writes.

    A batch may come again after a failure; effects get its number so that they can write it once.
    """

    def run(batch: DataFrame, number: int) -> None:
        ended = batch.where("done").persist()
        try:
            for effect in effects:
                effect(ended, number)
        finally:
            ended.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drained(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream gives until its source is read, as a table."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
