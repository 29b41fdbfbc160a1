"""Ingestion: the whole cascade of reasons, what becomes of extracted media, counters of feeds and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import settings
from quillspark.functions import scores, texts
from quillspark.operators.relations import first_by, gate, top_k


def ingest(candidates: DataFrame, stored: DataFrame, start: Column, end: Column, keywords: list[str] = settings.TOPIC_KEYWORDS, topic_filter: bool = True, order: str = "candidate_id") -> DataFrame:
    """Candidates with the first reason that they are skipped for; null where they become articles.

    candidates: candidate_id, canonical_url, prefilter_text, skip_prefilter,
    feed_date, html (null: it couldn't be fetched), summary, use_feed_content,
    parsed_date, title and publish of the analysis. stored: canonical_url. Dates
    are fresh in [start, end). Of candidates of one address that pass all else, the
    first by id becomes the article; the others lost the race to it.
    """
    known = stored.select("canonical_url").where("canonical_url is not null").distinct().withColumn("_known", F.lit(True))
    fresh = lambda date: (date >= start) & (date < end)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    date = F.coalesce("parsed_date", "feed_date")
    steps = [
        ("duplicate_canonical_url", F.col("_known")),
        ("prefilter_not_relevant", ~F.coalesce("skip_prefilter", F.lit(False)) & ~blank(F.col("prefilter_text")) & ~texts.is_on_topic(F.col("prefilter_text"), keywords, topic_filter)),
        ("feed_date_not_fresh", F.col("feed_date").isNotNull() & ~fresh(F.col("feed_date"))),
        ("article_unavailable", F.col("html").isNull() & (~F.coalesce("use_feed_content", F.lit(False)) | blank(F.col("summary")))),
        ("parsed_date_not_fresh", ~F.coalesce(fresh(date), F.lit(False))),
        ("analysis_missing_title", blank(F.col("title"))),
        ("analysis_not_publishable", ~F.coalesce("publish", F.lit(False)) if topic_filter else F.lit(False)),
    ]
    judged = gate(candidates.join(known, "canonical_url", "left"), steps).drop("_known")
    least = judged.where("skip_reason is null").groupBy("canonical_url").agg(F.min(order).alias("_first"))
    raced = judged.join(least, "canonical_url", "left")
    lost = F.col("skip_reason").isNull() & (F.col(order) != F.col("_first"))
    return raced.withColumn("skip_reason", F.when(lost, "duplicate_race").otherwise(F.col("skip_reason"))).drop("_first").select(*candidates.columns, "skip_reason")


def media_outcome(role: Column, visual: Column, known: Column, action: Column, kind: Column) -> Column:
    """What becomes of an extracted medium: rejected by role, already an asset, ignored, or one of the follow-ups of a new one."""
    return (
        F.when(visual & (role != "content"), F.concat(F.lit("rejected_"), role))
        .when(known, "existing")
        .when(action == "ignore", "ignored")
        .when(action == "download", "created_download")
        .when(kind.isin("video", "audio"), "created_video")
        .otherwise("created_ready")
    )


def outcome_counts(media: DataFrame, article: str = "news_id") -> DataFrame:
    """Counts of an article's extraction run: candidates, existing, created, ignored, ready references, follow-ups, and each rejected role."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(list(names)))
    rejected = F.col("outcome").startswith("rejected_")
    roles = media.where(rejected).groupBy(article, F.substring_index("outcome", "_", -1).alias("role")).agg(F.count("*").alias("n"))
    roles = roles.groupBy(article).agg(F.array_sort(F.collect_list(F.concat_ws(":", "role", F.col("n").cast("string")))).alias("rejected_roles"))
    counts = media.groupBy(article).agg(
        F.count("*").alias("candidates"),
        is_("existing").alias("existing"),
        F.count_if(F.col("outcome").startswith("created_")).alias("created"),
        F.count_if(rejected | (F.col("outcome") == "ignored")).alias("ignored"),
        is_("created_ready").alias("ready_references"),
        is_("created_download", "created_video").alias("follow_ups"),
    )
    return counts.join(roles, article, "left").withColumn("rejected_roles", F.coalesce("rejected_roles", F.array().cast("array<string>")))


def feed_counts(candidates: DataFrame, feed: str = "feed") -> DataFrame:
    """Candidates of each feed, and how many of them have no date."""
    return candidates.groupBy(feed).agg(F.count("*").alias("candidates"), F.count_if(F.col("published").isNull()).alias("without_date"))


def asset_counts(assets: DataFrame, article: str = "news_id") -> DataFrame:
    """Assets of each article, and how many of them are usable."""
    return assets.groupBy(article).agg(F.count("*").alias("assets"), F.count_if(F.col("status").isin("ready", "published")).alias("usable"))


def with_running_max(assets: DataFrame, attached: DataFrame, key: str = "asset_id", score: str = "score") -> DataFrame:
    """An asset's score is the most that it ever had, in its own row or where it is attached."""
    best = attached.groupBy(key).agg(F.max(score).alias("_best"))
    return assets.join(best, key, "left").withColumn(score, F.greatest(F.col(score), F.col("_best"))).drop("_best")


def fingerprint_candidates(ranked: DataFrame, k: int = 8) -> DataFrame:
    """The first assets of an article that are worth reading whole for a hash: visual ones among the first k."""
    return ranked.where((F.col("rank") <= k) & F.col("type").isin(settings.VISUAL_TYPES))


def readable_by_vision(kind: Column, storage_path: Column, size: Column, mime: Column, most: int = settings.MAX_VISION_BYTES) -> Column:
    """Whether an image can be shown to a model: visual, stored, not too large, and of an image's MIME type (none: taken for one)."""
    of_image = F.coalesce(F.nullif(mime, F.lit("")), F.lit("image/jpeg")).startswith("image/")
    return F.coalesce(kind.isin(settings.VISUAL_TYPES) & storage_path.isNotNull() & (size.isNull() | (size <= most)) & of_image, F.lit(False))


def vision_candidates(attached: DataFrame, least: float = 0.35, k: int = 3, article: str = "news_id") -> DataFrame:
    """An article's best assets for a look by a model: enough relevance, the first k by it."""
    fit = attached.where(F.col("score").isNotNull() & (F.col("score") >= least))
    return top_k(fit, [article], [F.desc("score"), F.col("asset_id")], k, "vision_rank")


def vision_rescored(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Candidates with their score blended with a model's reply (asset_id, reply 0 to 100 or null)."""
    joined = candidates.join(replies.select("asset_id", "reply"), "asset_id", "left")
    return joined.withColumn("score", scores.vision_blend(F.col("score"), scores.vision_score(F.col("reply"), F.col("score")))).drop("reply")


#: Variants by the longest width, and whether they are cut to a square.
VARIANTS = {"optimized": 1600, "thumbnail": 320, "telegram": 1280, "compressed": 1280}


def missing_variants(assets: DataFrame, variants: DataFrame, kinds: list[str]) -> DataFrame:
    """(asset_id, variant_type, width, height) of stored assets' variants that there aren't yet.

    assets: asset_id, storage_path, width, height; variants: asset_id, variant_type.
    """
    wanted = assets.where(F.coalesce("storage_path", F.lit("")) != "").select("asset_id", "width", "height", F.explode(F.array(*map(F.lit, kinds))).alias("variant_type"))
    missing = wanted.join(variants.select("asset_id", "variant_type"), ["asset_id", "variant_type"], "left_anti")
    most = F.create_map(*[F.lit(x) for pair in VARIANTS.items() for x in pair])[F.col("variant_type")]
    scale = F.least(F.lit(1.0), most / F.col("width"))
    square = F.col("variant_type") == "thumbnail"
    size = lambda c: F.when(most.isNull(), F.col(c)).when(square, most).otherwise(F.round(F.col(c) * scale).cast("int"))
    return missing.select("asset_id", "variant_type", size("width").alias("width"), size("height").alias("height"))


def merge_extracted(media: DataFrame, key: str, order: list[str], firsts: list[str], extra: str | None = None) -> DataFrame:
    """Equal media of several extractors as one row: first values, any hint, least position, and a map in which the first wins.

    Rows come back numbered by position (``place``).
    """
    from quillspark.operators.relations import merge_first_values

    merged = merge_first_values(media, key, order, firsts, ["featured"], ["position"])
    if extra:
        entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.map_entries(extra).alias("e")))), lambda x: x["e"]))
        found = media.groupBy(key).agg(entries.alias("_entries"))
        names = F.array_distinct(F.transform("_entries", lambda e: e["key"]))
        first = F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter("_entries", lambda e: e["key"] == n), F.lit(0))["value"]))
        merged = merged.join(found.select(key, first.alias(extra)), key)
    return merged


def numbered_by_position(media: DataFrame, article: str, tie: str) -> DataFrame:
    """An article's media in the order of their position."""
    from pyspark.sql import Window

    return media.withColumn("place", F.row_number().over(Window.partitionBy(article).orderBy(F.col("position").asc_nulls_last(), tie)))


def with_source(rows: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows with the columns of their source; a row without one keeps nulls."""
    own = sources.select(F.col("id").alias("_source"), *(F.col(c).alias(f"source_{c}") for c in sources.columns if c != "id"))
    return rows.join(own, F.col(key) == F.col("_source"), "left").drop("_source")


def attach(pivot: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (news_id, asset_id) pairs: a new pair is added, a known one takes the new attributes; of several the last by position."""
    latest = first_by(new, ["news_id", "asset_id"], [F.desc_nulls_last("position")])
    return pivot.join(latest.select("news_id", "asset_id"), ["news_id", "asset_id"], "left_anti").unionByName(latest)


def log_rows(rows: DataFrame, stage: str, status: Column, message: Column, at: Column, context: list[str] = ()) -> DataFrame:
    """Rows of the processing log, to be appended: ids, stage, status, message, context as JSON, attempt."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        has("asset_id").cast("string").alias("asset_id"), has("news_id").cast("string").alias("news_id"), F.lit(stage).alias("stage"), status.alias("status"), message.alias("message"),
        F.to_json(F.struct(*context)).alias("context") if context else F.lit(None).cast("string").alias("context"), (F.col("attempt") if "attempt" in rows.columns else F.lit(1)).cast("int").alias("attempt"), at.alias("at"),
    )
