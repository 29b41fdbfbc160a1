"""Feeds and crawls as DataFrames; fetching itself stays behind an interface that the caller gives."""

from __future__ import annotations

from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import urls
from quillspark.sources import markup

_MEDIA = "struct<_url:string,_medium:string,_type:string,_width:int,_height:int,_duration:int,_isDefault:string>"
RSS_SCHEMA = (
    f"title string, link string, guid string, description string, `content:encoded` string, pubDate string, `dc:date` string, "
    f"`media:content` array<{_MEDIA}>, `media:thumbnail` array<struct<_url:string,_width:int,_height:int>>, enclosure array<struct<_url:string,_type:string>>"
)
ATOM_SCHEMA = "title string, id string, summary string, content string, published string, updated string, link array<struct<_href:string,_rel:string>>"


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files, with the file; a broken file gives no rows."""
    return spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(RSS_SCHEMA).load(path).withColumn("feed", F.input_file_name())


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema(ATOM_SCHEMA).load(path).withColumn("feed", F.input_file_name())


def _not_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def rss_candidates(items: DataFrame) -> DataFrame:
    """Candidates of RSS items: link, else guid; full content, else description; with their media."""
    media = F.transform(F.coalesce("media:content", F.array()), lambda m: F.struct(m["_url"].alias("url"), m["_medium"].alias("medium"), m["_type"].alias("mime"), m["_width"].alias("width"), m["_height"].alias("height"), m["_duration"].alias("duration"), (F.lower(m["_isDefault"]) == "true").alias("is_default")))
    thumbnails = F.transform(F.coalesce("media:thumbnail", F.array()), lambda m: F.struct(m["_url"].alias("url"), m["_width"].alias("width"), m["_height"].alias("height")))
    enclosures = F.transform(F.coalesce("enclosure", F.array()), lambda m: F.struct(m["_url"].alias("url"), m["_type"].alias("mime")))
    found = items.select(
        "feed", F.coalesce(_not_blank(F.col("link")), _not_blank(F.col("guid"))).alias("url"), _not_blank(F.col("title")).alias("title"),
        F.coalesce(_not_blank(F.col("`content:encoded`")), _not_blank(F.col("description"))).alias("summary"), F.coalesce("pubDate", "`dc:date`").alias("published"),
        media.alias("media"), thumbnails.alias("thumbnails"), enclosures.alias("enclosures"),
    )
    return found.where(F.col("url").startswith("http"))


def atom_candidates(entries: DataFrame) -> DataFrame:
    """Candidates of Atom entries: the first plain or alternate link, else the id; published, else updated."""
    plain = F.filter(F.coalesce("link", F.array()), lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    found = entries.select(
        "feed", F.coalesce(_not_blank(F.try_element_at(plain, F.lit(1))["_href"]), _not_blank(F.col("id"))).alias("url"), _not_blank(F.col("title")).alias("title"),
        F.coalesce(_not_blank(F.col("content")), _not_blank(F.col("summary"))).alias("summary"), F.coalesce("published", "updated").alias("published"),
    )
    return found.where(F.col("url").startswith("http"))


def typed_media(candidates: DataFrame) -> DataFrame:
    """A row for each medium of a candidate, typed by medium, MIME type or suffix."""
    one = F.explode(F.concat(
        F.transform("media", lambda m: F.struct(m["url"].alias("url"), F.coalesce(m["medium"], m["mime"]).alias("kind"), F.lit("rss_media_content").alias("extracted_by"))),
        F.transform("enclosures", lambda m: F.struct(m["url"].alias("url"), m["mime"].alias("kind"), F.lit("rss_enclosure").alias("extracted_by"))),
        F.transform("thumbnails", lambda m: F.struct(m["url"].alias("url"), F.lit("image").alias("kind"), F.lit("rss_media_thumbnail").alias("extracted_by"))),
    ))
    rows = candidates.select(F.col("url").alias("article"), one.alias("m"))
    suffix, kind = urls.extension(F.col("m.url")), F.lower(F.coalesce("m.kind", F.lit("")))
    named = F.when(kind.startswith("video") | suffix.isin("mp4", "webm", "mov"), "video").when(kind.startswith("audio") | suffix.isin("mp3", "m4a"), "audio")
    return rows.select("article", "m.url", named.when((suffix == "gif") | (kind == "image/gif"), "gif").otherwise("image").alias("type"), "m.extracted_by")


def newest(candidates: DataFrame, key: str, order: Column, k: int = 20) -> DataFrame:
    """At most k candidates of each feed."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= k).drop("_n")


def page_links(pages: DataFrame) -> DataFrame:
    """Links of pages (url, html) that look like articles of the page's own host, the first place of each."""
    found = pages.select(F.col("url").alias("page"), F.posexplode(markup.links_udf("html", "url")).alias("position", "link"))
    return found.where(urls.is_article_url(F.col("link"), F.array(urls.host(F.col("page"))), urls.first_segment(F.col("page")))).groupBy("page", "link").agg(F.min("position").alias("position"))


def crawl(fetch: Callable[[str], str | None], start: str, hosts: list[str], next_path: str | None, article_path: str = "//a[@href]", max_pages: int = 10, max_links: int = 20) -> list[str]:
    """Article links of a listing and its next pages, in order; the bounded loop that a driver runs."""
    found: dict[str, None] = {}
    seen: set[str] = set()
    url: str | None = start
    while url and url not in seen and len(seen) < min(10, max_pages) and len(found) < min(100, max_links):
        seen.add(url)
        page = fetch(url)
        if page is None:
            break
        for link in markup.links(page, url, article_path):
            found.setdefault(link)
        url = markup.next_page(page, url, hosts, next_path)
    return list(found)[:max_links]


FETCHERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rss": lambda spark, path: rss_candidates(read_rss(spark, path)).select("feed", "url", "title", "summary", "published"),
    "atom": lambda spark, path: atom_candidates(read_atom(spark, path)),
}


#: Sources are configured by hand, so they are few.
MAX_SOURCES = 10_000
#: Candidates that one fetch of a feed gives at most.
MAX_ITEMS = 20
SOURCES = "slug string, name string, fetch_type string, source_url string, reliability_score int, media_reuse_permitted boolean, fetch_options map<string,string>, is_active boolean"


def source_rows(spark: SparkSession, configured: list[dict]) -> DataFrame:
    """Configured sources as a relation, with what an entry doesn't state."""
    rows = [(c["slug"], c["name"], c.get("fetch_type", "rss"), c.get("url"), c.get("reliability_score", 50), c.get("media_reuse_permitted", False), {k: str(v) for k, v in c.get("fetch_options", {}).items()}, c.get("is_active", True)) for c in configured]
    return spark.createDataFrame(rows, SOURCES)


def active(sources: DataFrame) -> DataFrame:
    return sources.where("is_active")


def dispatched(sources: DataFrame, known: dict = FETCHERS) -> DataFrame:
    """Sources with the fetcher that takes them, or the error that none does."""
    fit = F.col("fetch_type").isin(list(known))
    return sources.withColumn("fetcher", F.when(fit, F.col("fetch_type"))).withColumn("error", F.when(~F.coalesce(fit, F.lit(False)), F.concat(F.lit("no fetcher for "), F.coalesce("fetch_type", F.lit("null")))))


@F.pandas_udf(StringType())
def _xml_error(content: pd.Series) -> pd.Series:
    def of(raw: bytes) -> str | None:
        try:
            ElementTree.fromstring(raw)
        except ElementTree.ParseError as broken:
            return str(broken)
        return None

    return content.map(of)


def feed_warnings(spark: SparkSession, path: str) -> DataFrame:
    """(feed, warning) of the feed files that aren't well-formed, which give no candidates."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("feed"), _xml_error("content").alias("warning")).where("warning is not null")


def fetch_all(spark: SparkSession, sources: list[tuple[str, str]], most: int = MAX_ITEMS) -> DataFrame:
    """Candidates of (fetch type, path) sources, the first ``most`` of each feed; a type without a fetcher gives none."""
    frames = [FETCHERS[kind](spark, path) for kind, path in sources if kind in FETCHERS]
    out = frames[0] if frames else spark.createDataFrame([], "feed string, url string, title string, summary string, published string")
    for f in frames[1:]:
        out = out.unionByName(f)
    return newest(out.withColumn("_place", F.monotonically_increasing_id()), "feed", F.col("_place"), most).drop("_place")


def fetch_active(spark: SparkSession, sources: DataFrame, most: int = MAX_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(candidates of the active sources, (slug, error) of those that no fetcher takes)."""
    found = dispatched(active(sources)).select("slug", "fetcher", "source_url", "error")
    rows = found.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return fetch_all(spark, [(r.fetcher, r.source_url) for r in rows if r.fetcher], most), found.where("error is not null").select("slug", "error")
