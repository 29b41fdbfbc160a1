"""Publishing: who may be sent, claims, what a claim becomes after a send, a channel's cadence, the address that is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import settings
from quillspark.functions import records
from quillspark.operators.relations import first_by


def eligible(articles: DataFrame, ledger: DataFrame, channel_id: Column, start: Column, end: Column) -> DataFrame:
    """Articles that a channel may still send: analysed, neither queued nor published, fresh, and not in its ledger.

    articles: canonical_url, analysed_at, queued_at, published_at, sent_at; ledger:
    channel_id, canonical_url. An article without an address was never sent.
    """
    waiting = articles.where(F.col("analysed_at").isNotNull() & F.col("queued_at").isNull() & F.col("sent_at").isNull() & (F.col("published_at") >= start) & (F.col("published_at") < end))
    sent = ledger.where(F.col("channel_id") == channel_id).select(F.col("canonical_url").alias("_sent")).distinct()
    return waiting.join(sent, F.col("canonical_url") == F.col("_sent"), "left_anti")


def guard(sends: DataFrame, channels: DataFrame, articles: DataFrame, ledger: DataFrame, start: Column, end: Column) -> DataFrame:
    """Each send's reason to be skipped at the moment of sending, or null; the first that fits.

    sends: channel_id, news_id; channels: channel_id, is_active; articles: news_id,
    canonical_url, published_at, started_at, sent_at; ledger: channel_id, canonical_url.
    """
    there = ledger.select(F.col("channel_id").alias("_channel"), F.col("canonical_url").alias("_url"), F.lit(True).alias("_in_ledger")).distinct()
    known = articles.select("news_id", "canonical_url", "published_at", "started_at", "sent_at", F.lit(True).alias("_known"))
    joined = sends.join(channels.select("channel_id", "is_active"), "channel_id", "left").join(known, "news_id", "left")
    joined = joined.join(there, (F.col("channel_id") == F.col("_channel")) & (F.col("canonical_url") == F.col("_url")), "left")
    fresh = F.coalesce((F.col("published_at") >= start) & (F.col("published_at") < end), F.lit(False))
    reason = (
        F.when(~F.coalesce("is_active", F.lit(False)), "channel_inactive")
        .when(F.col("_in_ledger"), "already_sent_to_channel")
        .when(F.col("_known").isNull(), "news_item_missing")
        .when(~fresh, "not_fresh_at_send_time")
        .when(F.col("started_at").isNotNull() | F.col("sent_at").isNotNull(), "already_claimed_or_published")
    )
    return joined.select(*sends.columns, reason.alias("skip_reason"))


def claim(rows: DataFrame, bids: DataFrame, key: str, claimed: str, order: list[Column]) -> DataFrame:
    """Compare and set for a batch of bids: each bid with ``won``.

    Of the bids for a row whose claim is empty the first in the order wins; bids for
    a claimed or missing row lose. Add a unique column last to settle ties. A table
    has one writer, so that a batch sees all claims before it.
    """
    free = rows.where(F.col(claimed).isNull()).select(key)
    winners = first_by(bids.join(free, key, "left_semi"), [key], order).withColumn("won", F.lit(True))
    return bids.join(winners, bids.columns, "left").withColumn("won", F.coalesce("won", F.lit(False)))


def claim_after(outcome: Column) -> Column:
    """What a claim becomes by the outcome of its send: kept for good, held (it may have arrived), or released."""
    return F.when(outcome == "sent", "published").when(outcome.isin("delivery_unknown", "invalid_receipt"), "held").otherwise("released")


def cadence(rules: Column, min_minutes: Column, max_minutes: Column, min_priority: Column) -> Column:
    """struct<min_minutes, max_minutes, min_priority, error> of a channel's rules with the given options, which may be null.

    Options are texts. The first error counts, and then the rules stay as they are.
    """
    stated = lambda name: records.rule(rules, name)
    whole = lambda c: F.floor(c.try_cast("double")).cast("int")
    low = F.coalesce(whole(min_minutes), stated("min_publish_interval_minutes"))
    high = F.coalesce(whole(max_minutes), stated("max_publish_interval_minutes"))
    share = F.coalesce(min_priority.try_cast("double"), stated("min_news_priority_score"))
    bad_minutes = lambda c: c.isNotNull() & F.coalesce(whole(c) < 1, F.lit(True))
    error = (
        F.when(bad_minutes(min_minutes), "min-interval must be a whole number of minutes, at least 1")
        .when(bad_minutes(max_minutes), "max-interval must be a whole number of minutes, at least 1")
        .when(min_priority.isNotNull() & ~F.coalesce(min_priority.try_cast("double").between(0, 1), F.lit(False)), "min-priority must be between 0 and 1")
        .when(low > high, "min-interval cannot exceed max-interval")
    )
    kept = lambda given, name: F.when(error.isNull(), given).otherwise(stated(name))
    return F.struct(
        kept(low, "min_publish_interval_minutes").alias("min_minutes"),
        kept(high, "max_publish_interval_minutes").alias("max_minutes"),
        kept(share, "min_news_priority_score").alias("min_priority"),
        error.alias("error"),
    )


def send_urls(assets: DataFrame, variants: DataFrame, base: str, kind: str = "telegram") -> DataFrame:
    """Adds ``send_url``: the stored variant for the platform, else the stored original, else the original address.

    assets: asset_id, storage_path, original_url; variants: asset_id, variant_type, storage_path.
    """
    own = variants.where(F.col("variant_type") == kind).groupBy("asset_id").agg(F.min("storage_path").alias("_variant"))
    path = F.coalesce("_variant", "storage_path")
    return assets.join(own, "asset_id", "left").withColumn("send_url", F.when(path.isNotNull() & (path != ""), F.concat(F.lit(base.rstrip("/") + "/"), path)).otherwise(F.col("original_url"))).drop("_variant")


def pool_of(queue: Column) -> Column:
    """The worker pool of a queue; null for an unknown one."""
    pools = [F.when(queue.isin(names), pool) for pool, names in settings.QUEUES.items()]
    return F.coalesce(*pools)
