"""URL functions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import settings


def part(url: Column, name: str) -> Column:
    """A part of a URL (HOST, PATH, QUERY, PROTOCOL, ...); null where it can't be read."""
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def normalise(url: Column) -> Column:
    """Host, path and sorted query without tracking parameters; scheme, port, fragment and credentials go."""
    clean = F.trim(url)
    path = F.regexp_replace(F.coalesce(part(clean, "PATH"), F.lit("")), "/+$", "")
    pairs = F.filter(F.split(F.coalesce(part(clean, "QUERY"), F.lit("")), "&"), lambda p: p != "")
    tracking = "^(" + "|".join(settings.TRACKING_PREFIXES) + ")"
    kept = F.filter(pairs, lambda p: ~F.lower(p).rlike(tracking))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host(clean), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.coalesce(host(clean), F.lit("")) == "", F.regexp_replace(url, "/+$", "")).otherwise(whole)


def first_segment(url: Column) -> Column:
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "^/+|/+$", "")
    return F.when(path != "", F.lower(F.split(path, "/")[0]))


def file_name(url: Column) -> Column:
    """The last part of the path, or of the URL itself where it has no path."""
    return F.regexp_extract(F.coalesce(part(url, "PATH"), url), "([^/]*)/*$", 1)


def stem(url: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(url), "\\.[^.]*$", "")


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(url), "\\.([^.]*)$", 1))


def without_rendition_marks(name: Column) -> Column:
    """A picture's name without the marks of sizes and formats at its end, however many are chained.

    All marks stand at the end of what is left, so a run of them goes at once.
    """
    marks = "|".join(f"(?:{m.removesuffix('$')})" for m in settings.RENDITION_MARKERS)
    return F.regexp_replace(name, f"(?:{marks})+$", "")


def rendition_key(url: Column) -> Column:
    """``host|name`` that all renditions of a picture share; ``host|path`` where the name says little."""
    name = without_rendition_marks(F.regexp_replace(stem(url), "^(.[^=]*)=.*$", "$1"))
    path = F.lower(F.regexp_replace(F.coalesce(part(url, "PATH"), url), "^/+|/+$", ""))
    both = F.get(F.transform(F.array(F.struct(name.alias("name"), path.alias("path"))), lambda x: F.when(F.length(x["name"]) < settings.MIN_STEM, x["path"]).otherwise(F.lower(x["name"]))), F.lit(0))
    return F.concat(F.coalesce(host(url), F.lit("")), F.lit("|"), both)


def identity_keys(phash: Column, content_hash: Column, provider: Column, external_id: Column, url: Column) -> Column:
    """All keys of an asset; the first is its primary key."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.filter(
        F.array(
            F.concat(F.lit("phash:"), given(phash)),
            F.concat(F.lit("hash:"), given(content_hash)),
            F.concat(given(provider), F.lit(":"), given(external_id)),
            F.concat(F.lit("url:"), rendition_key(url)),
        ),
        lambda k: k.isNotNull(),
    )


def fingerprint(provider: Column, external_id: Column, url: Column) -> Column:
    truthy = lambda c: F.coalesce(~c.isin("", "0"), F.lit(False))
    return F.when(truthy(provider) & truthy(external_id), F.concat(provider, F.lit(":"), external_id)).otherwise(url)


def youtube_id(url: Column) -> Column:
    """The video's id from youtu.be/id, ?v=id, /embed/id, /v/id or /shorts/id."""
    name = F.regexp_replace(host(url), "^www\\.", "")
    short = F.when(name == "youtu.be", F.nullif(F.regexp_extract(part(url, "PATH"), "^/([^/]+)", 1), F.lit("")))
    query = F.nullif(F.regexp_extract(F.coalesce(part(url, "QUERY"), F.lit("")), "(?:^|&)v=([^&]+)", 1), F.lit(""))
    path = F.nullif(F.regexp_extract(F.coalesce(part(url, "PATH"), F.lit("")), "/(?:embed|v|shorts)/([\\w-]+)", 1), F.lit(""))
    video_site = name.rlike("(^|\\.)(youtube\\.com|youtube-nocookie\\.com)$")
    return F.coalesce(short, F.when(video_site, F.coalesce(query, path)))


def youtube_watch_url(video_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)


def youtube_thumbnail(video_id: Column) -> Column:
    return F.concat(F.lit("https://img.youtube.com/vi/"), video_id, F.lit("/hqdefault.jpg"))


def article_link(canonical: Column, url: Column) -> Column:
    """The first of the two that is a whole http(s) URL."""
    valid = lambda c: F.when(F.lower(part(c, "PROTOCOL")).isin("http", "https") & part(c, "HOST").isNotNull(), c)
    return F.coalesce(valid(canonical), valid(url))


def without_secrets(url: Column) -> Column:
    """Scheme, host and path only, for logs."""
    return F.concat(part(url, "PROTOCOL"), F.lit("://"), part(url, "HOST"), F.coalesce(part(url, "PATH"), F.lit("")))


def redact(text: Column) -> Column:
    """A log line without keys, tokens and credentials in URLs."""
    text = F.regexp_replace(text, "(?i)(bearer\\s+)[A-Za-z0-9._~+/-]+=*", "$1[redacted]")
    text = F.regexp_replace(text, "(?i)((?:api[_-]?key|token|secret|password|key)=)[^&\\s]+", "$1[redacted]")
    text = F.regexp_replace(text, "/bot[0-9]+:[A-Za-z0-9_-]+", "/bot[redacted]")
    return F.regexp_replace(text, "(https?://)[^/@\\s]+@", "$1[redacted]@")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob, in which * is any text."""
    import re

    return "(?s)^" + ".*".join(re.escape(x) for x in glob.split("*")) + "$"


def matches_any(url: Column, globs: list[str]) -> Column:
    return F.lit(False) if not globs else F.coalesce(url.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)), F.lit(False))


# Parts of paths that no article has, and sections that hold articles.
EXCLUDED_SEGMENTS = (
    "tag tags category categories label labels topic topics author authors about contact login signin signup register subscribe privacy terms terms-of-service search page "
    "wp-content wp-json feed rss atom account cart newsletter advertise careers jobs join inference department departments centers-labs-programs clp research-areas pricing "
    "products industry discord community magazines supertopic"
).split()
CONTENT_SECTIONS = "news blog blogs article articles press posts post stories story features insights".split()


def looks_like_article(segments: Column, source_segment: Column) -> Column:
    """Whether the parts of a path are those of an article's address."""
    last, first, depth = F.element_at(segments, -1), F.lower(segments[0]), F.size(segments)
    has_year = F.exists(F.slice(segments, 1, F.greatest(depth - 1, F.lit(0))), lambda s: s.rlike("^(19|20)[0-9]{2}$"))
    hyphens = F.length(segments[0]) - F.length(F.replace(segments[0], F.lit("-"), F.lit("")))
    return ~last.rlike("^[0-9]+$") & (
        has_year | (first.isin(CONTENT_SECTIONS) & (depth >= 2)) | (F.coalesce(first == source_segment, F.lit(False)) & (depth >= 2)) | ((depth == 1) & (hyphens >= 3))
    )


def is_article_url(url: Column, hosts: list[str] | Column, source_segment: Column, include: list[str] = (), exclude: list[str] = (), segments: list[str] = ()) -> Column:
    """Whether a resolved link leads to an article of the source."""
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "^/+|/+$", "")
    parts = F.split(path, "/")
    allowed = host(url).isin(hosts) if isinstance(hosts, list) else F.array_contains(hosts, host(url))
    barred = F.exists(parts, lambda s: F.lower(s).isin([*EXCLUDED_SEGMENTS, *(x.strip().lower() for x in segments)]))
    ok = allowed & (path != "") & ~barred & ~matches_any(url, list(exclude)) & looks_like_article(parts, source_segment)
    return F.coalesce(ok & matches_any(url, list(include)) if include else ok, F.lit(False))
