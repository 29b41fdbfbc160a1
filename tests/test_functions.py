"""Pure functions against literal expectations."""

import pytest
from hypothesis import given, settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import images, scores, texts, times, urls
from quillspark.operators.selection import same_picture


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_normalise(spark):
    given_urls = ["HTTPS://u:p@Example.COM:8080/a/b/?utm_source=x&b=2&a=1&REF=y#f", "http://example.com", "http://example.com/?fbclid=1", "not a url/", None]
    assert each(spark, given_urls, urls.normalise) == ["example.com/a/b?a=1&b=2", "example.com/", "example.com/", "not a url", None]
    again = each(spark, [f"http://{u}" for u in ("example.com/a/b?a=1&b=2", "example.com/")], urls.normalise)
    assert again == ["example.com/a/b?a=1&b=2", "example.com/"]


def test_renditions(spark):
    pairs = [
        ("https://x.com/abcdefghijkl=w2000-h1260-n-nu", "https://x.com/abcdefghijkl=s800"),
        ("https://x.com/Hero_Image_4.max-600x600.format-webp.webp", "https://x.com/Hero_Image_4.width-2200.format-webp.webp"),
        ("https://x.com/picture-name-600x400.jpg", "https://x.com/picture-name-scaled.png"),
    ]
    for a, b in pairs:
        x, y = each(spark, [a, b], urls.rendition_key)
        assert x == y
    assert same_picture("url:x.com|sans_logotype_lo", "url:x.com|sans_logotype_log")
    assert not same_picture("url:x.com|love_rendered_inline", "url:x.com|love_rendered_inline_2")
    assert not same_picture("url:x.com|vla-chart", "url:x.com|synthetic-data-chart")
    assert same_picture("phash:30525656c4cc0e1e", "phash:30525656c4cc0e1f") and not same_picture("phash:0000000000001f00", "phash:0000000000001f01")


def test_video_ids(spark):
    found = each(spark, ["https://youtu.be/ab-1", "https://www.youtube.com/watch?a=1&v=cd", "https://youtube.com/shorts/ef", "https://notyoutube.com/watch?v=x"], urls.youtube_id)
    assert found == ["ab-1", "cd", "ef", None]


def test_article_urls(spark):
    links = ["https://a.com/news/big-story", "https://a.com/tag/x", "https://a.com/2024/05/story", "https://a.com/one-two-three-four", "https://b.com/news/x", "https://a.com/news/12", "https://a.com/"]
    assert each(spark, links, lambda c: urls.is_article_url(c, ["a.com"], F.lit(None).cast("string"))) == [True, False, True, True, False, False, False]
    assert each(spark, ["https://a.com/blog/x", "https://a.com/blog/y"], lambda c: urls.is_article_url(c, ["a.com"], F.lit("blog"), include=["*/blog/*"], exclude=["*y"])) == [True, False]


def test_logs(spark):
    assert one(spark, urls.without_secrets(F.lit("https://u:p@a.com/x?token=1#f"))) in ("https://a.com/x",)
    assert one(spark, urls.redact(F.lit("GET /bot12:AbC/x?api_key=1 Bearer abc.def"))) == "GET /bot[redacted]/x?api_key=[redacted] Bearer [redacted]"


def test_topic(spark):
    assert each(spark, ["New AI  model", "said again", "я ai я", "яai", "machine   Learning!", " ", None], texts.is_on_topic) == [True, False, True, False, True, False, False]


def test_captions(spark):
    assert one(spark, texts.sanitise(F.lit("a​  b\t c\n\n\n\nd\x07 😀😀😀😀😀 e "))) == "a b c\n\nd 😀😀😀 e"
    assert one(spark, texts.hashtags(F.array(*map(F.lit, ("#AI", "ai", "x", "Über_1!", "b b", "cc", "dd"))))) == "#ai #über_1 #bb #cc"
    assert one(spark, texts.truncate_at_word(F.lit("one two three four"), 12)) == "one two…"
    assert one(spark, texts.truncate_at_word(F.lit("😀" * 10), 8)) == "😀😀😀…"
    assert one(spark, texts.utf16_length(F.lit("😀a"))) == 3
    assert each(spark, ["abc", "абв", "12", None], lambda c: texts.matches_script(c, "Latin")) == [True, False, False, False]
    long = F.lit("word " * 400)
    no_title = F.lit(None).cast("string")
    section = lambda *pairs: F.array(*(F.struct(t.alias("title"), b.alias("body")) for t, b in pairs))
    out = one(spark, texts.caption(F.lit("H"), section((no_title, long)), F.lit("ha"), F.lit("link"), F.lit("#t")))
    assert len(out) <= 1000 and out.startswith("H\n\nword") and out.endswith("…\n\nlink")
    assert one(spark, texts.caption(F.lit("H"), section((no_title, F.lit("b"))), F.lit("ha"), F.lit("link"), F.lit("#t"))) == "H\n\nb\n\nha\n\nlink\n\n#t"
    # the link is last but the tags, and an empty row stands between a title and its body
    assert one(spark, texts.caption(no_title, section((F.lit("T"), F.lit(" b "))), no_title, F.lit("link"), F.lit("#t"))) == "T\n\nb\n\nlink\n\n#t"
    # tags go first, then humour
    body = F.lit("x" * 990)
    assert one(spark, texts.caption(F.lit("H"), section((no_title, body)), F.lit("ha"), F.lit("link"), F.lit("#t"))) == "H\n\n" + "x" * 990 + "\n\nlink"
    # two sections share what is left equally
    out = one(spark, texts.caption(F.lit("H"), section((F.lit("A"), long), (F.lit("B"), long)), no_title, F.lit("link"), no_title))
    parts = out.split("\n\n")
    assert len(out) <= 1000 and (parts[0], parts[-1]) == ("H", "link") and abs(len(parts[-2]) - len(parts[-3 if len(parts) == 4 else -4])) < 8
    # a header that is too long leaves the link alone
    assert one(spark, texts.caption(F.lit("H" * 2000), section((F.lit("A"), F.lit("b"))), no_title, F.lit("link"), no_title)) == "link"


def now():
    return F.lit("2026-09-12 09:00:00").cast("timestamp")


def test_dates(spark):
    values = ["Sep 10", "03-15", "2 days ago", "2025-09-10T14:07:07+0000", "Wed, 10 Sep 2026 12:00:00 GMT", "11 September 2026", "2026-09-10T13:58:09-08:00", "2026-09-11T02:00:00+05:00", "1999-01-01", "2027-01-01", None]
    found = [None if x is None else x.strftime("%Y-%m-%d %H:%M") for x in each(spark, values, lambda c: times.parse_date(c, now()))]
    assert found == [None, None, None, "2025-09-10 14:07", "2026-09-10 12:00", "2026-09-11 00:00", "2026-09-10 21:58", "2026-09-10 21:00", None, None, None]


def test_windows(spark):
    at = ["2026-09-11 18:59:59", "2026-09-11 19:00:00", "2026-09-12 18:59:59", "2026-09-12 19:00:00", None]
    assert each(spark, at, lambda c: times.is_fresh(c.cast("timestamp"), now(), "Asia/Tashkent")) == [False, True, True, False, False]
    assert one(spark, times.seconds_left(now(), "Asia/Tashkent")) == 36000


def test_hashes(spark):
    assert each(spark, ["30525656c4cc0e1e", "0000000000001f00", "0000000000003f00", "ffffffffffffffff", "", "30525656"], images.is_distinctive) == [True, False, True, False, False, False]
    assert one(spark, images.hamming(F.lit("0" * 16), F.lit("f" * 16))) == 64 and one(spark, images.hamming(F.lit("0" * 16), F.lit("0" * 15 + "1"))) == 1


@hypothesis_settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=8))
def test_near_hashes_share_a_band(value, flips):
    other = value
    for k in flips:
        other ^= 1 << k
    edges = [64 * k // 9 for k in range(10)]
    a, b = f"{value:064b}", f"{other:064b}"
    assert any(a[x:y] == b[x:y] for x, y in zip(edges, edges[1:], strict=False))


def test_roles(spark):
    rows = [("https://x.com/ali-kani-scaled-96x96.jpg", None, None, None), ("https://x.com/a-1280x680-1-960x540.jpg", None, None, None), ("https://x.com/a.gif", None, 1, 1), ("https://x.com/site-logo.png", None, 300, 80), ("https://x.com/product.jpg", None, 1200, 1200), ("https://x.com/ads/a.jpg", None, None, None), ("https://x.com/a.jpg", "Portrait of X", 900, 600)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, u string, a string, w int, h int")
    found = df.select("k", images.role(F.col("u"), F.col("a"), F.col("w"), F.col("h")).alias("r")).orderBy("k").collect()
    assert [r.r for r in found] == ["avatar", "content", "pixel", "chrome", "content", "promo", "avatar"]


def test_scores(spark):
    assert one(spark, scores.article_priority(F.lit("World-first AI breakthrough launches today"), F.lit(""))) >= 0.2
    assert one(spark, scores.article_priority(F.lit("Weekly developer documentation update"), F.lit(None).cast("string"))) == 0.0
    assert one(spark, scores.overlap(F.lit("big big cat"), F.lit("the big dog"))) == pytest.approx(2 / 3)
    assert one(spark, scores.overlap(F.lit("big"), F.lit(""))) == 0.2
    assert one(spark, scores.reliability(F.lit(None).cast("int"))) == 0.5 and one(spark, scores.vision_score(F.lit(None).cast("int"), F.lit(0.3))) == 0.3
    assert each(spark, [54, 55, 300, None], lambda c: scores.is_publishable(F.lit(True), c), "int") == [False, True, True, False]
    assert one(spark, scores.aspect(F.lit("image"), F.lit(1200), F.lit(630))) > 0.99


@pytest.mark.parametrize(("backlog", "seconds", "expected"), [(2, 14 * 3600, 2700), (10, 5.5 * 3600, 1800), (25, 2 * 3600, 276), (10, 1800, 180), (0, 100, 2700)])
def test_pacing(spark, backlog, seconds, expected):
    assert one(spark, scores.pacing_ceiling(F.lit(backlog), F.lit(int(seconds)), 3, 45)) == expected
