"""Rules that registered queries don't reach: literal expectations."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark import settings
from quillspark.functions import images, scores, texts, times, urls
from quillspark.operators import ingestion, publishing, relations, selection
from quillspark.sources import feeds, markup, responses, storage
from quillspark.streaming import flows, stages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def null(kind="string"):
    return F.lit(None).cast(kind)


def test_video_and_backlog(spark):
    plan = lambda *a: tuple(one(spark, scores.video_plan(*a)))
    assert plan(F.lit("youtube"), F.lit(1), F.lit(True)) == (False, True, False, "platform_video")
    assert plan(null(), F.lit(1), null("boolean")) == (False, True, False, "reuse_not_permitted")
    assert plan(null(), null("long"), F.lit(True)) == (False, True, False, "size_unknown")
    assert plan(null(), F.lit(300 * 2**20), F.lit(True)) == (False, True, False, "too_large")
    assert plan(null(), F.lit(60 * 2**20), F.lit(True)) == (True, True, True, "download")
    late, needed, fit = scores.backlog_expires(F.lit(10), F.lit(3600), 15)
    assert (one(spark, late), one(spark, needed), one(spark, fit)) == (True, 9000, 4)


def test_scores_of_context_and_platform(spark):
    assert one(spark, scores.contextual_relevance(null("double"), F.lit(0.3))) == 0.3 and one(spark, scores.contextual_relevance(null("double"), null("double"))) == 0.5
    assert one(spark, scores.vision_blend(F.lit(0.5), F.lit(1.0))) == 0.8
    breaches = one(spark, scores.platform_breaches(F.lit(11 * 2**20), F.lit(9000), F.lit(2000)))
    assert breaches == ["too_many_bytes", "edges_too_long"]
    assert one(spark, scores.platform(F.lit("image"), F.lit(11 * 2**20), F.lit(9000), F.lit(2000))) == 0.0
    assert one(spark, scores.platform(F.lit("video"), F.lit(60 * 2**20), null("int"), null("int"))) == 0.4


def test_images(spark):
    w, h = images.fitted(F.lit(3200), F.lit(1600), 1280)
    assert (one(spark, w), one(spark, h)) == (1280, 640)
    assert [one(spark, images.media_type(F.lit(m))) for m in ("image/gif", "image/png", "video/mp4", "audio/mp3", "text/plain")] == ["gif", "image", "video", "audio", "document"]
    assert [one(spark, images.unusable_dimensions(F.lit(a), F.lit(b))) for a, b in ((100, 900), (4000, 300), (800, 600), (0, 0), (9000, 4000))] == [True, True, False, False, True]
    near = one(spark, images.pieces(F.lit("30525656c4cc0e1e"), 3, 2))
    assert len(near) == len(set(near)) == (1 + 21 + 210) + (1 + 21 + 210) + (1 + 22 + 231)
    own = one(spark, images.pieces(F.lit("ffffffffffffffff"), 3))
    assert own == [((1 << 21) - 1) * 3, ((1 << 21) - 1) * 3 + 1, ((1 << 22) - 1) * 3 + 2]


def test_urls_and_texts(spark):
    keys = one(spark, urls.identity_keys(F.lit("ab"), F.lit(""), F.lit("youtube"), F.lit("x1"), F.lit("https://a.com/picture-name-600x400.jpg")))
    assert keys == ["phash:ab", "youtube:x1", "url:a.com|picture-name"]
    assert one(spark, urls.fingerprint(F.lit("youtube"), F.lit("x1"), F.lit("u"))) == "youtube:x1" and one(spark, urls.fingerprint(F.lit("youtube"), F.lit("0"), F.lit("u"))) == "u"
    assert one(spark, urls.article_link(F.lit("a.com/x"), F.lit("https://a.com/x"))) == "https://a.com/x"
    assert one(spark, urls.youtube_thumbnail(F.lit("x1"))) == "https://img.youtube.com/vi/x1/hqdefault.jpg"
    assert one(spark, urls.without_rendition_marks(F.lit("hero-name_600x400.width-200.format-webp"))) == "hero-name"
    assert one(spark, texts.escape_attribute(F.lit("a \"b\" 'c' & <d>"))) == "a &quot;b&quot; &#039;c&#039; &amp; &lt;d&gt;"
    assert one(spark, texts.fallback_markup(F.lit("a & b"), F.lit("<p>c</p>"))) == "<article><h1>a &amp; b</h1><p>c</p></article>"
    assert one(spark, texts.is_long_enough(F.lit("x" * 39))) is False and one(spark, texts.null_if_blank(F.lit("  "))) is None
    assert one(spark, texts.candidate_text(F.lit("a"), null())) == "a"
    assert one(spark, texts.strip_tags(F.lit("<p>a  b</p>\n<br>c"))) == "a b c"


def test_times(spark):
    at = F.lit("2026-09-12 09:00:00").cast("timestamp")
    assert str(one(spark, times.to_stored(at, "Asia/Tashkent"))) == "2026-09-12 14:00:00" and str(one(spark, times.to_utc(at, "Asia/Tashkent"))) == "2026-09-12 04:00:00"
    assert str(one(spark, times.from_epoch(F.lit(0)).cast("string"))) == "1970-01-01 00:00:00"


def test_relations(spark):
    news = spark.createDataFrame([(1, "n")], "news_id int, title string")
    bridge = spark.createDataFrame([(1, 7, 0), (2, 8, 0)], "news_id int, asset_id int, position int")
    assets = spark.createDataFrame([(7, "u"), (8, "v")], "asset_id int, url string")
    assert [(r.news_id, r.asset_id, r.url) for r in relations.attached(news, bridge, assets).collect()] == [(1, 7, "u")]
    assert [r.asset_id for r in relations.reorder(assets, [8, 7, 9], "asset_id").collect()] == [8, 7]
    with pytest.raises(ValueError):
        relations.backfill(news, spark.range(relations.MAX_CHANNELS + 1), news, ["news_id"])
    pivot = spark.createDataFrame([(1, 7, 0, 0.5), (1, 8, 1, 0.4)], "news_id int, asset_id int, position int, score double")
    new = spark.createDataFrame([(1, 8, 5, 0.9), (1, 9, 6, 0.1)], pivot.schema)
    assert sorted(map(tuple, ingestion.attach(pivot, new).collect())) == [(1, 7, 0, 0.5), (1, 8, 5, 0.9), (1, 9, 6, 0.1)]
    log = ingestion.log_rows(pivot, "extraction", F.lit("succeeded"), F.lit("2 found"), F.lit("2024-01-01").cast("timestamp"), ["position"]).orderBy("asset_id").first()
    assert (log.asset_id, log.news_id, log.stage, log.context, log.attempt) == ("7", "1", "extraction", '{"position":0}', 1)
    placed = ingestion.numbered_by_position(pivot, "news_id", "asset_id")
    assert [(r.asset_id, r.place) for r in placed.orderBy("place").collect()] == [(7, 1), (8, 2)]


def test_selection(spark):
    rows = [("n", 1, 0, 1, "aa", None, 0), ("n", 2, 0, 2, "ab", None, 0), ("n", 3, 0, 3, "ac", None, 2), ("n", 4, 1, 4, None, None, 0)]
    grouped = spark.createDataFrame(rows, "news_id string, asset_id int, picture int, rank int, phash string, duplicate_of_id int, copies int")
    assert [(r.asset_id, r.duplicate_of_id) for r in selection.resolved_duplicates(grouped).collect()] == [(2, 1)]
    assert {r.asset_id for r in selection.distinct_pictures(grouped, 1, 2).collect()} == {1, 2}
    ladder = spark.createDataFrame([("media_group",), ("video",), ("none",), ("single_image",)], "plan string").select(selection.send_ladder().alias("x"))
    assert [r.x for r in ladder.collect()] == [["album", "photo", "text"], ["video", "text"], ["text"], ["photo", "text"]]
    asset = ("image", "ready", None, "https://a.com/photo-of-city.jpg", None, 800, 600, 0.5)
    changed = [asset, ("image", "failed", *asset[2:]), (*asset[:2], 5, *asset[3:]), (*asset[:3], "https://a.com/x.svg", *asset[4:]), (*asset[:3], "https://a.com/logo.jpg", *asset[4:]), (*asset[:5], 90, *asset[6:]), (*asset[:7], 0.1)]
    df = spark.createDataFrame(changed, "type string, status string, duplicate_of_id int, url string, alt string, width int, height int, score double")
    assert selection.usable(df).count() == 1
    assert selection._groups_of([["url:a|x"], ["url:a|y"], ["url:a|y", "url:a|x"], [], ["url:a|y"]]) == [0, 1, 0, 2, 0]


def test_publishing(spark):
    assert [one(spark, publishing.claim_after(F.lit(o))) for o in ("sent", "delivery_unknown", "invalid_receipt", "retry_later", "failed")] == ["published", "held", "held", "released", "released"]
    assert [one(spark, publishing.pool_of(F.lit(q))) for q in ("news-fetch", "video-processing", "x")] == ["pipeline", "video", None]
    assert set(stages.queues()) == {q for names in settings.QUEUES.values() for q in names}


def test_headers_and_ranges(spark):
    got = F.create_map(*map(F.lit, ("Accept", "a", "X:y", "b", "ETag", "c\n", "accept", "d")))
    assert one(spark, responses.valid_headers(got)) == {"accept": "d"}
    merged = responses.merged_headers(F.create_map(F.lit("User-Agent"), F.lit("x"), F.lit("Accept"), F.lit("*")), null("map<string,string>"), F.create_map(F.lit("ACCEPT"), F.lit("text/html")))
    assert one(spark, merged) == {"user-agent": "x", "accept": "text/html"}
    headers = F.create_map(*map(F.lit, ("content-type", "Text/HTML; charset=utf-8", "content-length", "12", "content-range", "bytes 0-9/400")))
    assert tuple(one(spark, responses.head_info(headers))) == (12, "text/html") and one(spark, responses.total_size(F.lit(206), headers)) == 400
    assert one(spark, responses.total_size(F.lit(200), F.create_map(F.lit("content-length"), F.lit("9")))) == 9
    kept = one(spark, responses.conditional(F.lit(304), F.lit("b"), null(), null(), F.lit("e0"), F.lit("m0")))
    assert tuple(kept) == (None, "e0", "m0")
    assert bytes(one(spark, responses.first_bytes(F.lit("abcdef").cast("binary"), 3))) == b"abc"


def test_saved_bodies_and_stores(spark, tmp_path):
    assert responses.save([b"ab", b"c"], str(tmp_path / "a"), 3) == 3
    for chunks in ([b"abcd"], []):
        with pytest.raises(ValueError):
            responses.save(chunks, str(tmp_path / "b"), 3)
        assert not (tmp_path / "b").exists()
    store = storage.Store(spark, f"file://{tmp_path}/store", "https://cdn.example.com/")
    assert store.get("x/a.jpg") is None and store.put("x/a.jpg", b"\x00\xff") and not store.put("x/a.jpg", b"other")
    assert store.get("x/a.jpg") == b"\x00\xff" and store.url("x/a.jpg") == "https://cdn.example.com/x/a.jpg" and store.delete("x/a.jpg") and not store.exists("x/a.jpg")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a"))
    seen = files.select("path", F.sha2("content", 256).alias("content_hash"))
    assert responses.changed_only(files, seen).count() == 0 and responses.changed_only(files, seen.limit(0)).count() == 1 and responses.bounded(files, 2).count() == 0


ITEMS = "".join(f"<item><title>T{k}</title><link>https://a.com/{k}</link><pubDate>Wed, 10 Sep 2026 12:00:00 GMT</pubDate></item>" for k in range(30))
MEDIA = '<item><link>https://a.com/m</link><media:content url="https://a.com/c.mp4" medium="video" width="640"/><media:thumbnail url="https://a.com/t.gif" width="10"/></item>'


def test_sources(spark, tmp_path):
    (tmp_path / "rss.xml").write_text(f'<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>{ITEMS}</channel></rss>')
    (tmp_path / "media.xml").write_text(f'<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>{MEDIA}</channel></rss>')
    (tmp_path / "broken.xml").write_text("<rss><channel><item>")
    configured = [
        {"slug": "a", "name": "A", "url": str(tmp_path / "rss.xml"), "reliability_score": 90, "fetch_options": {"skip_prefilter": True}},
        {"slug": "b", "name": "B", "fetch_type": "html_crawl", "url": "https://b.com"},
        {"slug": "c", "name": "C", "url": "x", "is_active": False},
    ]
    sources = feeds.source_rows(spark, configured)
    assert {r.slug: (r.reliability_score, r.media_reuse_permitted, r.fetch_options) for r in sources.collect()} == {"a": (90, False, {"skip_prefilter": "True"}), "b": (50, False, {}), "c": (50, False, {})}
    candidates, problems = feeds.fetch_active(spark, sources)
    assert sorted(int(r.url.rsplit("/", 1)[1]) for r in candidates.collect()) == list(range(20))
    assert [tuple(r) for r in problems.collect()] == [("b", "no fetcher for html_crawl")]
    assert [r.feed.rsplit("/", 1)[1] for r in feeds.feed_warnings(spark, f"{tmp_path}/*.xml").collect()] == ["broken.xml"]
    media = feeds.typed_media(feeds.rss_candidates(feeds.read_rss(spark, str(tmp_path / "media.xml"))))
    assert {(r.url, r.type, r.extracted_by) for r in media.collect()} == {("https://a.com/c.mp4", "video", "rss_media_content"), ("https://a.com/t.gif", "gif", "rss_media_thumbnail")}
    spark.dataSource.register(storage.FeedSource)
    rows = spark.read.format("feed").option("paths", f"{tmp_path}/rss.xml,{tmp_path}/broken.xml").load()
    assert rows.count() == 20 and rows.where("published is null").count() == 0
    assert storage.feed_items(b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://a.com/s"/><link href="https://a.com/e"/><updated>2026</updated></entry></feed>') == [("https://a.com/e", "A", None, "2026")]


def test_pages_of_a_listing(spark):
    html = '<a href="/news/a-story">a</a><a href="/tag/x">t</a><a href="https://b.com/news/y">b</a><a href="/news/a-story">a</a>'
    pages = spark.createDataFrame([("https://a.com/news", html)], "url string, html string")
    assert [(r.link, r.position) for r in feeds.page_links(pages).collect()] == [("https://a.com/news/a-story", 0)]
    assert pages.select(markup.resolve_udf(F.lit("../x"), "url").alias("u")).first().u == "https://a.com/x"


PAGE = '<head><meta property="og:image" content="/og.jpg"></head><body><article><p>' + "word " * 60 + '</p><img src="/in.jpg"></article></body>'


def test_four_extractors_in_order_and_alone(spark):
    feed = [{"url": "https://a.com/e.mp4", "kind": "video/mp4", "extracted_by": "rss_enclosure"}]
    payload = [{"url": "https://a.com/p.jpg", "featured": True}]
    found, failed = markup.extracted(PAGE, "https://a.com/s", feed, payload)
    assert [(m["url"].rsplit("/", 1)[1], m["extracted_by"]) for m in found] == [("og.jpg", "og_meta"), ("e.mp4", "rss_enclosure"), ("p.jpg", "api_payload"), ("in.jpg", "html_img")] and failed == []
    broken = [("bad", lambda *a: 1 / 0), markup.EXTRACTORS[1]]
    found, failed = markup.extracted(PAGE, "https://a.com/s", feed, None, broken)
    assert len(found) == 1 and failed == ["bad"]
    row = spark.createDataFrame([(PAGE, "https://a.com/s", feed, None)], "html string, url string, feed array<struct<url:string,kind:string,extracted_by:string>>, payload array<struct<url:string,featured:boolean>>")
    assert [m.extracted_by for m in row.select(markup.extracted_udf("html", "url", "feed", "payload").alias("x")).first().x.media] == ["og_meta", "rss_enclosure", "html_img"]
    spark.udtf.register("media", markup.MediaTable)
    row.createOrReplaceTempView("a_page")
    assert spark.sql("select m.url from a_page, lateral media(html, url) m").count() == 2


def run(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    rows = [(1, "start", "t1"), (1, "tick", "t1"), (1, "tick", "t0"), (2, "tick", "t1")]
    source = str(tmp_path / "ticks")
    spark.createDataFrame(rows, "channel_id long, kind string, token string").coalesce(1).write.parquet(source)
    ticks = spark.readStream.schema("channel_id long, kind string, token string").parquet(source)
    run(flows.token_chain(ticks).writeStream.format("memory").queryName("chain").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert sorted((r.channel_id, r.token, r.live) for r in spark.table("chain").collect()) == [(1, "t0", False), (1, "t1", True), (1, "t1", True), (2, "t1", False)]
    events = spark.createDataFrame(pd.DataFrame({"k": ["a", "a", "b"], "t": pd.to_datetime(["2026-01-01 01:00", "2026-01-01 02:00", "2026-01-02 03:00"])}))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "events"))
    now = F.lit("2026-01-02 04:00:00").cast("timestamp")
    run(flows.distinct_candidates(stream, "k", "t").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert sorted(r.k for r in spark.table("once").collect()) == ["a", "b"]
    run(flows.fresh_only(stream, "t", now, 24).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c3")).start())
    assert [r.k for r in spark.table("fresh").collect()] == ["b"]
    run(flows.daily_counts(stream, "t", ["k"]).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c4")).start())
    assert sorted((r.k, r.n) for r in spark.table("days").collect()) == [("a", 2), ("b", 1)]
    seen = []
    query = stages.start(stream, "news-fetch", lambda batch, k: seen.append(batch.count()), str(tmp_path / "c5"), once=True)
    query.awaitTermination(120)
    assert seen == [3]
    with pytest.raises(ValueError):
        stages.start(stream, "unknown", lambda *a: None, str(tmp_path))
    assert [one(spark, flows.next_attempt(F.lit(k), *flows.RETRIES["news_fetch"])) for k in (1, 2, 3)] == [30, 120, None] and one(spark, flows.next_attempt(F.lit(1), *flows.RETRIES["publishing"])) is None
