"""Keyed merges, ledgers, ranks and health: the relational part, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partitions_for(df: DataFrame, mb: int = 4) -> int:
    """Into how many partitions to deal a table so that one gets about so many MB of its files; the session's number at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, size // (mb << 20)) if size < 1 << 50 else least  # above: Spark doesn't know the size


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order; add a unique column last to settle ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def insert_ignore(new: DataFrame, ledger: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows whose key neither the ledger nor an earlier new row has; append them to the ledger."""
    return first_by(new, keys, order).join(ledger.select(*keys), keys, "left_anti")


def merge(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Upsert: new rows replace old ones of the same key; of several new ones the last in the order counts."""
    latest = first_by(new, keys, order) if order else new
    return old.join(latest.select(*keys), keys, "left_anti").select(*old.columns).unionByName(latest.select(*old.columns))


def deactivate_missing(table: DataFrame, present: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    """Rows whose key isn't present any more lose their flag; a null key is never present."""
    marked = table.join(present.select(F.col(key).alias("_key")).where("_key is not null").distinct().withColumn("_there", F.lit(True)), F.col(key) == F.col("_key"), "left")
    return marked.withColumn(flag, F.col(flag) & F.coalesce(F.col("_there"), F.lit(False))).drop("_key", "_there")


def ledger_rows(sent: DataFrame, channel: Column, url: Column) -> DataFrame:
    """Rows of the delivery ledger: a row without a URL was never sent."""
    return sent.withColumn("channel_id", channel).withColumn("url_hash", F.sha2(url, 256)).where(F.col("url_hash").isNotNull())


def not_sent(items: DataFrame, ledger: DataFrame, item_key: str, ledger_key: str) -> DataFrame:
    """Items that the ledger doesn't have; items without a key stay."""
    return items.join(ledger.select(F.col(ledger_key).alias("_sent")).distinct(), F.col(item_key) == F.col("_sent"), "left_anti")


#: More channels than this aren't few any more.
MAX_CHANNELS = 10_000


def backfill(items: DataFrame, channels: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Ledger rows that are missing for items x channels, of which there may be ``MAX_CHANNELS``."""
    if channels.limit(MAX_CHANNELS + 1).count() > MAX_CHANNELS:
        raise ValueError(f"more than {MAX_CHANNELS} channels")
    return items.crossJoin(F.broadcast(channels)).join(ledger.select(*keys), keys, "left_anti")


def canonical(assets: DataFrame, key: str = "id", parent: str = "duplicate_of_id") -> DataFrame:
    """Each asset's canonical one, a single hop; itself where it has none or it is missing."""
    parents = assets.select(F.col(key).alias("_parent"))
    joined = assets.join(parents, F.col(parent) == F.col("_parent"), "left")
    return joined.withColumn("canonical_id", F.coalesce("_parent", key)).drop("_parent")


def duplicate_counts(assets: DataFrame, key: str = "id", parent: str = "duplicate_of_id") -> DataFrame:
    copies = assets.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.count("*").alias("copies"))
    return assets.join(copies, key, "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def pool(article: DataFrame, event: DataFrame, key: str = "asset_id") -> DataFrame:
    """Union of an article's and its event's assets; the article's row wins."""
    both = article.withColumn("_from", F.lit(0)).unionByName(event.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return first_by(both, ["news_id", key], [F.col("_from"), F.col("position").asc_nulls_last()]).drop("_from")


def attached(news: DataFrame, bridge: DataFrame, assets: DataFrame) -> DataFrame:
    """Articles with their assets, by position within each."""
    return news.join(bridge, "news_id").join(assets, "asset_id")


def merge_first_values(df: DataFrame, key: str, order: list[str], firsts: list[str], flags: list[str] = (), least: list[str] = ()) -> DataFrame:
    """Of each key, the first value that isn't null of some columns, any of the flags, the least of others."""
    place = F.struct(*order)
    found = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in firsts]
    return df.groupBy(key).agg(*found, *(F.bool_or(c).alias(c) for c in flags), *(F.min(c).alias(c) for c in least))


def stuck_jobs(jobs: DataFrame, queues: DataFrame, cutoff: int) -> DataFrame:
    """Waiting jobs past the cutoff, for each queue that there is; none is 0."""
    waiting = jobs.where(F.col("reserved_at").isNull() & (F.col("available_at") <= cutoff))
    counts = waiting.groupBy("queue").agg(F.count("*").alias("stuck"), F.max("attempts").alias("most_attempts"), F.min("available_at").alias("oldest"))
    return queues.join(counts, "queue", "left").withColumn("stuck", F.coalesce("stuck", F.lit(0)))


def best_per_group(assets: DataFrame, key: str, score: str) -> DataFrame:
    """Most of a score for each key, of usable assets."""
    return assets.groupBy(key).agg(F.max(score).alias("best"))


def best_candidate(articles: DataFrame, least_priority: float, candidate_limit: int = 100) -> DataFrame:
    """The article to publish next: priority, then quality (none is below 0), then the one ready first, then id."""
    waiting = articles.where(F.col("priority") >= least_priority).orderBy(F.col("ready_at").asc_nulls_last(), "id").limit(candidate_limit)
    return waiting.orderBy(F.desc("priority"), F.desc(F.coalesce("quality", F.lit(-1.0))), F.col("ready_at").asc_nulls_last(), "id").limit(1)


def gate(candidates: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """The first reason of an ordered cascade that a candidate is skipped for; null if it passes all."""
    reason = F.lit(None).cast("string")
    for name, refused in reversed(steps):
        reason = F.when(F.coalesce(refused, F.lit(False)), name).otherwise(reason)
    return candidates.withColumn("skip_reason", reason)


def shift_times(df: DataFrame, columns: list[str], seconds: int) -> DataFrame:
    return df.withColumns({c: F.col(c) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds))) for c in columns})


def reorder(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows of the given ids, numbered in the order of the list."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], f"place int, {key} {dict(rows.dtypes)[key]}")
    return rows.join(F.broadcast(wanted), key).orderBy("place")
