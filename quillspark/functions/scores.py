"""Scores and decisions: Column -> Column. Scores are rounded after the weighted sum, as their parts are."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import settings
from quillspark.functions import texts, urls


def clamp(x: Column) -> Column:
    """Held to 0 to 1; null stays null (greatest and least pass over it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def priority(text: Column, signals: tuple = settings.PRIORITY_SIGNALS) -> Column:
    """Sum of the weights of the signals in a text, at most 1."""
    low = F.lower(text)
    parts = [F.when(low.rlike(f"(?U){pattern}"), F.lit(weight)).otherwise(F.lit(0.0)) for pattern, weight in signals]
    return F.coalesce(F.least(F.lit(1.0), F.round(reduce(lambda a, b: a + b, parts), 3)), F.lit(0.0))


def article_priority(title: Column, content: Column, chars: int = 4000) -> Column:
    body = F.substring(texts.strip_tags(F.coalesce(content, F.lit(""))), 1, chars)
    return priority(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), body))


def overlap(title: Column, text: Column) -> Column:
    """Share of the title's words that a caption has, of three at least; 0.2 where either has none."""

    def share(x: Column) -> Column:
        hits = F.size(texts.overlap_with_multiplicity(x["a"], x["b"]))
        empty = (F.coalesce(F.size(x["a"]), F.lit(0)) <= 0) | (F.coalesce(F.size(x["b"]), F.lit(0)) <= 0)
        return F.when(empty, 0.2).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.lit(3), F.size(x["a"]))))

    return texts.let(F.struct(texts.tokens(title).alias("a"), texts.distinct_tokens(text).alias("b")), share)


def position(at: Column, total: Column) -> Column:
    return F.when(total <= 1, 1.0).otherwise(F.lit(1.0) - at / total)


def trust(extractor: Column, featured: Column) -> Column:
    return F.when(featured, 1.0).when(extractor.isin(settings.HIGH_TRUST_EXTRACTORS), 0.85).when(extractor.isin(settings.MEDIUM_TRUST_EXTRACTORS), 0.6).otherwise(0.4)


def relevance(overlap_score: Column, position_score: Column, trust_score: Column) -> Column:
    w = settings.RELEVANCE_WEIGHTS
    return F.round(clamp(w["overlap"] * overlap_score + w["position"] * position_score + w["trust"] * trust_score), 4)


def resolution(width: Column, height: Column) -> Column:
    return F.when(F.coalesce((width > 0) & (height > 0), F.lit(False)), F.round(F.least(F.lit(1.0), width * height / settings.IDEAL_PIXELS), 4)).otherwise(0.4)


def size_fitness(kind: Column, size: Column) -> Column:
    steps = F.when(size < 8 * 1024, 0.2).when(size < 3 * 1024 * 1024, 1.0).when(size < 10 * 1024 * 1024, 0.7).otherwise(0.4)
    return F.when(F.coalesce(size, F.lit(0)) == 0, 0.6).when(~kind.isin("image", "gif"), 0.8).otherwise(steps)


def visual(failed: Column, sharp: Column, fitness: Column, watermark: Column) -> Column:
    score = F.coalesce(sharp, F.lit(0.7)) * 0.5 + fitness * 0.5 - F.when(F.coalesce(watermark, F.lit(False)), 0.3).otherwise(0.0)
    return F.when(F.coalesce(failed, F.lit(False)), 0.0).otherwise(F.round(clamp(score), 4))


def uniqueness(is_duplicate: Column, copies: Column) -> Column:
    return F.when(is_duplicate, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.lit(1.0) - 0.15 * F.coalesce(copies, F.lit(0))), 4))


def aspect(kind: Column, width: Column, height: Column) -> Column:
    known = F.coalesce((width > 0) & (height > 0) & (kind != "video"), F.lit(False))
    off = F.abs(F.log(width / height / F.lit(settings.IDEAL_ASPECT)))
    return F.when(known, F.round(F.greatest(F.lit(0.0), F.lit(1.0) - off / F.lit(math.log(4))), 4)).otherwise(0.7)


def reliability(score: Column) -> Column:
    return F.coalesce(clamp(score / 100), F.lit(0.5))


def platform_breaches(size: Column, width: Column, height: Column) -> Column:
    """Names of the limits that a photo breaks."""
    ratio = width / F.nullif(height, F.lit(0))
    sized = F.coalesce((width > 0) & (height > 0), F.lit(False))
    found = F.array(
        F.when(size > settings.MAX_PHOTO_BYTES, F.lit("too_many_bytes")),
        F.when(sized & (width + height > settings.MAX_EDGE_SUM), F.lit("edges_too_long")),
        F.when(sized & ((ratio < settings.MIN_PHOTO_RATIO) | (ratio > settings.MAX_PHOTO_RATIO)), F.lit("ratio_out_of_range")),
    )
    return F.array_compact(found)


def platform(kind: Column, size: Column, width: Column, height: Column) -> Column:
    photo = F.greatest(F.lit(0.0), F.lit(1.0) - 0.5 * F.size(platform_breaches(size, width, height)))
    return F.when(kind == "video", F.when(size > settings.MAX_VIDEO_BYTES, 0.4).otherwise(1.0)).when(kind.isin(settings.VISUAL_TYPES), photo).otherwise(1.0)


def quality(relevance_score: Column, resolution_score: Column, visual_score: Column, source: Column, platform_score: Column, unique: Column, aspect_score: Column) -> Column:
    w = settings.QUALITY_WEIGHTS
    parts = {"relevance": relevance_score, "resolution": resolution_score, "visual": visual_score, "source": source, "platform": platform_score, "uniqueness": unique, "aspect": aspect_score}
    return F.round(clamp(reduce(lambda a, b: a + b, [w[k] * c for k, c in parts.items()])), 4)


def contextual_relevance(in_article: Column, own: Column) -> Column:
    return F.coalesce(in_article, own, F.lit(0.5))


def vision_score(reply: Column, stored: Column) -> Column:
    """A model's 0 to 100 as a share; the stored score, or a half, without a reply."""
    return F.coalesce(clamp(reply / 100), stored, F.lit(0.5))


def vision_blend(rule: Column, model: Column) -> Column:
    return F.round(0.4 * rule + 0.6 * model, 4)


def is_publishable(on_topic: Column, score: Column, least: int = 55) -> Column:
    return F.coalesce(on_topic & (score >= least), F.lit(False))


def pacing_ceiling(backlog: Column, seconds: Column, min_minutes: int, max_minutes: int, saturation: int = 5, pace_to_end_of_day: bool = True) -> Column:
    """Most seconds to wait before the next post; the wait is drawn between the least and this."""
    low, high = 60 * min_minutes, 60 * max_minutes
    deadline = F.when((seconds > 0) & F.lit(pace_to_end_of_day), F.floor(seconds / (backlog + 1)))
    saturated = F.round(F.lit(high) - F.least(F.lit(1.0), backlog / F.lit(max(1, saturation))) * (high - low)).cast("long")
    return F.when(backlog <= 0, F.lit(high)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(deadline, saturated)))).cast("long")


def backlog_expires(backlog: Column, seconds: Column, min_minutes: int) -> tuple[Column, Column, Column]:
    """(whether posts will be left at the end, seconds needed, posts that still fit)."""
    needed = backlog * min_minutes * 60
    return F.coalesce((backlog > 0) & (needed > seconds), F.lit(False)), needed, F.floor(seconds / F.lit(max(1, min_minutes * 60))).cast("long")


def ingestion_action(kind: Column, provider: Column, width: Column, height: Column, url: Column, reuse: Column) -> Column:
    """ignore, reference or download; the first rule that fits."""
    small = kind.isin([t for t in settings.VISUAL_TYPES if t != "thumbnail"]) & ((width < settings.MIN_EDGE) | (height < settings.MIN_EDGE))
    return (
        F.when(kind.isin("embed", "video", "audio"), "reference")
        .when(provider.isin(settings.REFERENCE_ONLY_PROVIDERS), "reference")
        .when(width.isNotNull() & height.isNotNull() & small, "ignore")
        .when(urls.extension(url).isin(settings.UNPUBLISHABLE_FORMATS), "ignore")
        .when((~reuse) & (kind != "thumbnail"), "reference")
        .when(kind.isin([*settings.VISUAL_TYPES, "document"]), "download")
        .otherwise("reference")
    )


def video_plan(provider: Column, size: Column, reuse: Column) -> Column:
    """struct<download, thumbnail, transcode, reason> for a video."""
    case = lambda download, transcode, reason: F.struct(F.lit(download).alias("download"), F.lit(True).alias("thumbnail"), transcode.alias("transcode"), F.lit(reason).alias("reason"))
    no = F.lit(False)
    return (
        F.when(provider.isin(settings.REFERENCE_ONLY_PROVIDERS), case(False, no, "platform_video"))
        .when(~F.coalesce(reuse, F.lit(False)), case(False, no, "reuse_not_permitted"))
        .when(size.isNull(), case(False, no, "size_unknown"))
        .when(size > settings.MAX_VIDEO_DOWNLOAD_BYTES, case(False, no, "too_large"))
        .otherwise(case(True, size > settings.MAX_VIDEO_BYTES, "download"))
    )


def is_retryable(status: Column) -> Column:
    """Whether a failed fetch may be tried again: no status, 408, 425, 429, or 500 and above."""
    return status.isNull() | status.isin(408, 425, 429) | (status >= 500)


def send_outcome(ok: Column, status: Column, description: Column, retry_after: Column, message_id: Column) -> Column:
    """What became of a sent post."""
    # What a platform says of media that it can't take.
    rejected = F.lower(description).rlike("wrong file|failed to get http url content|wrong type of the web page|webpage_curl_failed|webpage_media_empty|photo_invalid_dimensions|media_empty|image_process_failed")
    return (
        F.when(status.isNull() | (status >= 500), "delivery_unknown")
        .when(retry_after.isNotNull() | (status == 429), "retry_later")
        .when(~F.coalesce(ok, F.lit(False)) & rejected, "media_rejected")
        .when(~F.coalesce(ok, F.lit(False)), "failed")
        .when(message_id.isNull() | (message_id <= 0), "invalid_receipt")
        .otherwise("sent")
    )
