"""Streams: gate and dedup of candidates, an idempotent ledger sink, a countdown latch, a paced chain."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.sources.storage import exists

LATCH_TTL_MS = 2 * 60 * 60 * 1000
LATCH = "news_id string, remaining int, done boolean"
CHAIN = "channel_id long, token string, live boolean"


def distinct_candidates(stream: DataFrame, key: str, time: str, lateness: str = "1 day") -> DataFrame:
    """Each key once, within a bounded state; older keys are the ledger's matter."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, time: str, keys: list[str], offset: str = "0 hours", lateness: str = "1 day") -> DataFrame:
    """Counts of calendar days of a zone with a fixed offset from UTC (its midnight, as a start time)."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, "1 day", None, offset).alias("day"), *keys).agg(F.count("*").alias("n"))


def latch_step(remaining: int | None, event: str, amount: int) -> tuple[int, bool]:
    """(outstanding tasks, whether the article is complete) after an event; a lost count makes any end the last."""
    if event == "start":
        return amount, amount <= 0
    left = 0 if remaining is None else max(0, remaining - amount)
    return left, left == 0


def _latch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = []
    for batch in batches:
        for event, amount in zip(batch["event"], batch["amount"], strict=True):
            left, done = latch_step(state.get[0] if state.exists else None, event, int(amount))
            if done:
                if state.exists:
                    state.remove()
            else:
                state.update((left,))
                state.setTimeoutDuration(LATCH_TTL_MS)
            rows.append((key[0], left, done))
    yield pd.DataFrame(rows, columns=["news_id", "remaining", "done"])


def latch(events: DataFrame) -> DataFrame:
    """Countdown of each article's tasks: events (news_id, event start or end, amount) to its state after each."""
    return events.groupBy("news_id").applyInPandasWithState(_latch, LATCH, "remaining int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _fenced(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = []
    for batch in batches:
        for kind, token in zip(batch["kind"], batch["token"], strict=True):
            if kind == "start":
                state.update((token,))
            rows.append((key[0], token, bool(state.exists and state.get[0] == token)))
    yield pd.DataFrame(rows, columns=["channel_id", "token", "live"])


def token_chain(ticks: DataFrame) -> DataFrame:
    """Ticks (channel_id, kind start or tick, token): only those of the channel's latest start are live."""
    return ticks.groupBy("channel_id").applyInPandasWithState(_fenced, CHAIN, "token string", "append", GroupStateTimeout.NoTimeout)


def ledger_sink(spark: SparkSession, path: str, keys: list[str], send: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: claims rows whose key has no claim yet, sends them, and appends their outcome to the ledger.

    A claim is written before its send. So a batch that runs again after a failure
    between the two sends nothing twice: such rows keep a claim without an outcome
    (``uncertain`` lists them), and someone has to look. ``send`` (rows -> rows with
    an outcome) is the effect; without it rows count as sent. Claims are in
    ``path``/claims, outcomes in ``path``/ledger; the sink is their only writer.
    """
    claims, ledger = f"{path}/claims", f"{path}/ledger"

    def write(batch: DataFrame, _: int) -> None:
        fresh, attempt = batch.dropDuplicates(keys), uuid.uuid4().hex
        mine = fresh.select(*keys)
        if exists(spark, claims):
            mine = mine.join(spark.read.parquet(claims).select(*keys), keys, "left_anti")
        mine.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(claims)
        # what was written says what may be sent; the anti join would now find it claimed
        claimed = spark.read.parquet(claims).where(F.col("attempt") == attempt).select(*keys)
        if claimed.isEmpty():
            return
        fresh = fresh.join(claimed, keys, "left_semi")
        (send(fresh) if send else fresh).write.mode("append").parquet(ledger)

    return write


def uncertain(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Claims of a ledger sink without an outcome: their send may or may not have arrived."""
    claims = spark.read.parquet(f"{path}/claims").select(*keys)
    return claims.join(spark.read.parquet(f"{path}/ledger").select(*keys), keys, "left_anti") if exists(spark, f"{path}/ledger") else claims


def fresh_only(stream: DataFrame, time: str, now: Column, hours: int) -> DataFrame:
    """A clock filter at ingest and again at sending; a watermark follows the data, not the clock."""
    return stream.where((F.col(time) >= now - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col(time) < now + F.expr("INTERVAL 1 HOUR")))


RETRIES = {"news_fetch": (3, (30, 120, 300)), "media_download": (3, (30, 120, 300)), "publishing": (1, ())}


def next_attempt(attempt: Column, tries: int, waits: tuple[int, ...]) -> Column:
    """Seconds until the next attempt, or null when all are used."""
    if not waits:
        return F.lit(None).cast("int")
    return F.when(attempt < tries, F.array(*map(F.lit, waits))[F.least(attempt - 1, F.lit(len(waits) - 1))])
