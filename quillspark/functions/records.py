"""JSON records: dotted paths with defaults, channel rules, replies of models, payloads of interfaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import settings


def at_path(json: Column, path: str) -> Column:
    """The value at a dotted path, as text; null where it isn't."""
    return F.get_json_object(json, "$." + path)


def rule(rules: Column, name: str) -> Column:
    """A channel's rule, or the value where it states none, in that value's type."""
    value = settings.CHANNEL_RULES[name]
    kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, float) else "int"
    return F.coalesce(at_path(rules, name).try_cast(kind), F.lit(value))


def with_rule(rules: Column, name: str, old: int, new: int) -> Column:
    """Rules in which a number of a certain value is another one; other rules stay as they are."""
    return F.when(at_path(rules, name) == str(old), F.regexp_replace(rules, f'("{name}"\\s*:\\s*){old}(?=[\\s,}}])', f"$1{new}")).otherwise(rules)


def analysis(reply: Column) -> Column:
    """struct<on_topic, title, content, score> of an analyser's reply; the score is held to 0 to 100."""
    r = F.from_json(reply, "is_ai_related boolean, title string, content string, score double")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.round(r["score"]).cast("int"), F.lit(0))))
    return F.struct(F.coalesce(r["is_ai_related"], F.lit(False)).alias("on_topic"), F.nullif(F.trim(r["title"]), F.lit("")).alias("title"), F.nullif(F.trim(r["content"]), F.lit("")).alias("content"), score.alias("score"))


def ranking(reply: Column, shown: Column) -> Column:
    """struct<ranked, redundant> of a curator's reply on ``shown`` images, or null where it is malformed.

    Places must be those of shown images, each ranked once; a redundant set has two or more.
    """
    r = F.from_json(reply, "ranked array<int>, redundant array<array<int>>")
    inside = lambda places: F.forall(places, lambda p: (p >= 0) & (p < shown))
    redundant = F.coalesce(r["redundant"], F.array().cast("array<array<int>>"))
    fit = inside(r["ranked"]) & (F.size(F.array_distinct(r["ranked"])) == F.size(r["ranked"])) & F.forall(redundant, lambda s: inside(s) & (F.size(F.array_distinct(s)) >= 2))
    return F.when(F.coalesce(fit, F.lit(False)), F.struct(r["ranked"].alias("ranked"), redundant.alias("redundant")))


# Where interfaces put their pictures.
LIST_PATHS, SINGLE_PATHS = ("images", "media", "photos", "attachments"), ("image", "featured_image", "thumbnail")


def payload_media(payload: Column) -> Column:
    """array<struct<url, featured>> of an interface's payload: lists of addresses or of objects with one, then single paths."""
    entries = []
    for path in LIST_PATHS:
        listed = F.from_json(at_path(payload, path), "array<string>")
        address = lambda x: F.coalesce(F.get_json_object(x, "$.url"), F.get_json_object(x, "$.src"), F.when(~x.startswith("{"), x))
        entries.append(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.struct(address(x).alias("url"), F.lit(False).alias("featured"))))
    for path in SINGLE_PATHS:
        value = at_path(payload, path)
        entries.append(F.array(F.struct(F.coalesce(F.get_json_object(value, "$.url"), F.when(~value.startswith("{"), value)).alias("url"), F.lit(True).alias("featured"))))
    return F.filter(F.concat(*entries), lambda m: m["url"].startswith("http"))
