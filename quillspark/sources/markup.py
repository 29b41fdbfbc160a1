"""Articles, links and media in HTML: a small tree from the standard parser, and UDFs over it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED_END = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())}


class Node:
    """An element; children are nodes and strings."""

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def get(self, name: str) -> str:
        return self.attributes.get(name, "")

    def walk(self) -> Iterator[Node]:
        """Itself and all elements below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag in tags]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def remove(self, unwanted: Callable[[Node], bool]) -> None:
        """Take out all elements below that are unwanted."""
        for node in list(self.walk()):
            node.children = [c for c in node.children if isinstance(c, str) or not unwanted(c)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        for open_tag, closers in IMPLIED_END.items():
            if tag in closers:
                self._close(open_tag, stop=("article", "aside", "body", "div", "main", "section", "td", "blockquote", "li"))
        if tag in ("li", "td", "tr", "dd", "dt"):
            self._close(tag, stop=("ul", "ol", "table", "dl"))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self._close(tag)

    def _close(self, tag, stop=()):
        node = self.at
        while node is not self.root and node.tag not in stop:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def squeeze(text: str) -> str:
    return " ".join(text.split())


# Metadata that state a date, and forms of dates in visible text.
DATE_METADATA = ["article:published_time", "og:article:published_time", "datePublished", "publish-date", "publishdate", "date"]
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
VISIBLE_DATES = [rf"{_MONTH}\.? \d{{1,2}},? \d{{4}}(?!\d)", rf"(?<!\d)\d{{1,2}} {_MONTH}\.? \d{{4}}(?!\d)", r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"]
_YEAR = re.compile(r"(?<!\d)(?:19|20)\d{2}(?!\d)")


def json_records(root: Node) -> Iterator[dict]:
    """Objects of the page's JSON-LD, those of lists and graphs too."""

    def inside(data) -> Iterator[dict]:
        if isinstance(data, list):
            for x in data:
                yield from inside(x)
        elif isinstance(data, dict):
            yield data
            yield from inside(data.get("@graph") or [])

    for script in root.all("script"):
        if script.get("type").lower() == "application/ld+json":
            try:
                yield from inside(json.loads(script.text()))
            except ValueError:
                continue


def densest(root: Node, tags: tuple[str, ...], least: int = 200) -> Node | None:
    """The element with most paragraph text for each element in it; the first of equals."""
    best, most = None, 0.0
    for node in root.all(*tags):
        length = sum(len(p.text()) for p in node.all("p"))
        density = length / (1 + sum(1 for _ in node.walk()) - 1)
        if length > least and density > most:
            best, most = node, density
    return best


def published_texts(root: Node, title: str | None) -> list[str]:
    """All statements of a publish date, the most reliable first."""
    found = []
    metas = root.all("meta")
    for name in DATE_METADATA:
        found += [m.get("content") for m in metas if name in (m.get("property"), m.get("name"), m.get("itemprop"))][:1]
    found += [x for r in json_records(root) if isinstance(x := r.get("datePublished") or r.get("dateCreated"), str)]
    found += [t.get("datetime") for t in root.all("time")]
    body = next(iter(root.all("body")), None)
    if body is not None:
        body.remove(lambda n: n.tag in ("script", "style", "noscript", "template", "nav", "aside", "footer") or n.get("role") in ("navigation", "complementary"))
        text = squeeze(body.text())
        at = text.lower().find(title[:60].lower()) if title else -1
        text = text[max(at, 0) :][:2000]
        found += [m[0] for p in VISIBLE_DATES if (m := re.search(p, text))]
    return [x.strip() for x in found if x and _YEAR.search(x)]


def article(page: str) -> dict:
    """title, content and publish dates (as stated) of an article page."""
    root = parse(page)
    og = next((m.get("content").strip() for m in root.all("meta") if m.get("property") == "og:title"), "")
    named = next((t.text().strip() for t in root.all("title")), "")
    title = og or named or next((squeeze(h.text()) for h in root.all("h1")), "") or None
    dates = published_texts(root, title)
    root.remove(lambda n: n.tag in ("script", "style", "noscript", "template", "nav", "aside", "footer") or n.get("role") in ("navigation", "complementary"))
    container = next(iter(root.all("article")), None) or densest(root, ("div", "section", "main"))
    paragraphs = [t for p in (container.all("p") if container else []) if len(t := squeeze(p.text())) > 40]
    return {"title": title, "content": "\n\n".join(paragraphs)[:8000] or None, "published": dates}


def resolve(href: str, base: str, keep_fragment: bool = True) -> str | None:
    """An absolute http(s) address, or None."""
    href = (href or "").strip()
    if not href or not keep_fragment and href.startswith(("#", "mailto:", "javascript:")):
        return None
    try:
        url = urlsplit(urljoin(base, href))
    except ValueError:
        return None
    if url.scheme.lower() not in ("http", "https") or not url.hostname:
        return None
    return url.geturl() if keep_fragment else url._replace(fragment="").geturl()


_STEP = re.compile(r"(//?)([\w*-]+)((?:\[[^\]]*\])*)")
_TEST = re.compile(r"\[\s*(?:contains\(\s*@([\w:-]+)\s*,\s*(['\"])(.*?)\2\s*\)|@([\w:-]+)\s*(?:=\s*(['\"])(.*?)\5)?)\s*\]")


def select(root: Node, path: str) -> list[Node]:
    """Elements of an XPath of steps // and /, names, and tests of attributes; ValueError for other paths."""
    now, at = [root], 0
    for step in _STEP.finditer(path):
        if step.start() != at:
            raise ValueError(path)
        at = step.end()
        tests = list(_TEST.finditer(step[3]))
        if sum(len(t[0]) for t in tests) != len(step[3]):
            raise ValueError(path)
        found: dict[int, Node] = {}
        for node in now:
            below = (n for n in node.walk() if n is not node) if step[1] == "//" else (c for c in node.children if isinstance(c, Node))
            for n in below:
                if step[2] in ("*", n.tag) and all((t[3] in n.get(t[1])) if t[1] else (t[4] in n.attributes and (t[6] is None or n.get(t[4]) == t[6])) for t in tests):
                    found[id(n)] = n
        now = list(found.values())
    if at != len(path):
        raise ValueError(path)
    return now


def links(page: str, base: str, path: str = "//a[@href]") -> list[str]:
    """Addresses of the anchors that a path selects, in document order, each once."""
    try:
        nodes = select(parse(page), path)
    except ValueError:
        return []
    found = (resolve(n.get("href"), base, keep_fragment=False) for n in nodes if n.tag == "a")
    return list(dict.fromkeys(u for u in found if u))


def next_page(page: str, base: str, hosts: list[str], path: str | None) -> str | None:
    """The first selected anchor that stays on the hosts."""
    return next((u for u in links(page, base, path) if urlsplit(u).hostname in hosts), None) if path else None


# Attributes that hold an image's address, hosts of embedded videos, marks of containers beside the article.
SRCSETS = ["data-srcset", "srcset", "data-lazy-srcset"]
SOURCES = ["data-src", "data-original", "data-lazy-src", "data-lazy", "data-image", "data-hi-res-src", "data-full-src", "src"]
VIDEO_HOSTS = ["youtube.com", "youtube-nocookie.com", "player.vimeo.com", "dailymotion.com"]
BESIDE = "author byline contributor commenter comments avatar gravatar profile-pic profile-photo userpic".split()
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif")


def largest(srcset: str) -> str | None:
    """The widest candidate of a srcset; 1x counts as 100, the first of equals wins."""
    best, most = None, -1
    for candidate in srcset.split(","):
        words = candidate.split()
        if not words:
            continue
        size = re.fullmatch(r"(\d+)w|([\d.]+)x", words[1]) if len(words) > 1 else None
        width = int(size[1]) if size and size[1] else int(100 * float(size[2])) if size else 100 if len(words) == 1 else 0
        if width > most:
            best, most = words[0], width
    return best


def _beside(n: Node) -> bool:
    marked = ("-" + "-".join(n.get("class").split()) + "-", "-" + n.get("id") + "-")
    return n.tag in ("nav", "aside", "footer") or n.get("role") in ("navigation", "complementary") or any(f"-{m}-" in x for m in BESIDE for x in marked)


def content_media(page: str, base: str) -> list[dict]:
    """Pictures, images, videos and embeds of the article, by kind and then in document order."""
    root = parse(page)
    root.remove(_beside)
    body = densest(root, ("article", "main")) or densest(root, ("div", "section"))
    order = {id(n): k for k, n in enumerate(root.walk())}
    last = max(order[id(n)] for n in body.walk()) if body else len(order)
    found: list[dict] = []

    def add(url: str | None, kind: str, by: str, **more) -> None:
        if url and all(f["url"] != url for f in found):
            found.append({"url": url, "type": kind, "extracted_by": by, "alt": None, "width": None, "height": None, "thumbnail": None, "position": len(found)} | more)

    def image(img: Node, by: str = "html_img") -> None:
        src = next((u for a in SRCSETS if img.get(a).strip() and (u := largest(img.get(a)))), None) or next((img.get(a).strip() for a in SOURCES if img.get(a).strip()), "")
        number = lambda a: (int(m[0]) if (m := re.match(r"\d+", img.get(a).strip())) else 0) or None
        url = resolve(src, base)
        add(url, "gif" if url and url.lower().endswith(".gif") else "image", by, alt=img.get("alt") or None, width=number("width"), height=number("height"))

    def elsewhere(img: Node) -> bool:
        anchor = next((a for a in img.ancestors() if a.tag == "a" and "href" in a.attributes), None)
        url = resolve(anchor.get("href"), base) if anchor else None
        path = urlsplit(url).path if url else ""
        return bool(url) and not path.lower().endswith(IMAGE_SUFFIXES) and path.rstrip("/") != urlsplit(base).path.rstrip("/")

    inside = lambda *tags: [n for n in root.all(*tags) if order[id(n)] <= last]
    for picture in inside("picture"):
        url = next((u for s in picture.all("source") if s.get("srcset") and (u := resolve(largest(s.get("srcset")) or "", base))), None)
        if url:
            add(url, "image", "html_picture")
        elif picture.all("img"):
            image(picture.all("img")[0])
    for img in inside("img"):
        if not any(a.tag == "picture" for a in img.ancestors()) and not elsewhere(img):
            image(img)
    for video in inside("video"):
        poster = resolve(video.get("poster"), base)
        for src in dict.fromkeys(x for x in [video.get("src"), *(s.get("src") for s in video.all("source"))] if x):
            add(resolve(src, base), "video", "html_video", thumbnail=poster)
    for frame in inside("iframe"):
        url = resolve(frame.get("src"), base)
        name = (urlsplit(url).hostname or "").lower() if url else ""
        if any(name == h or name.endswith("." + h) for h in VIDEO_HOSTS):
            add(url, "embed", "html_iframe")
    return found


def metadata_media(page: str, base: str) -> list[dict]:
    """og:image and og:video (the last of several, with their sizes), card images, JSON-LD images."""
    root = parse(page)
    stated: dict[str, str] = {}
    for m in root.all("meta"):
        if name := (m.get("property") or m.get("name")).lower():
            stated[name] = m.get("content").strip()
    found: list[dict] = []

    def add(url: str | None, kind: str, by: str, size: tuple = (None, None)) -> None:
        if url and all(f["url"] != url for f in found):
            found.append({"url": url, "type": kind, "extracted_by": by, "alt": None, "width": size[0], "height": size[1], "thumbnail": None, "position": len(found)})

    for kind in ("image", "video"):
        size = tuple(int(x) if (x := stated.get(f"og:{kind}:{side}", "")).isdigit() else None for side in ("width", "height"))
        add(resolve(stated.get(f"og:{kind}:secure_url") or stated.get(f"og:{kind}", ""), base), kind, "og_meta", size)
    add(resolve(stated.get("twitter:image") or stated.get("twitter:image:src", ""), base), "image", "twitter_card")

    def images(value) -> Iterator[str]:
        if isinstance(value, str):
            yield value
        elif isinstance(value, list):
            for x in value:
                yield from images(x)
        elif isinstance(value, dict):
            yield from images(value.get("url") or value.get("contentUrl"))

    for record in json_records(root):
        for url in images(record.get("image")):
            add(resolve(url, base), "image", "json_ld")
    return found


_STRINGS = T.ArrayType(T.StringType())
ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("published", _STRINGS)])
MEDIA = T.StructType([T.StructField(n, T.IntegerType() if n in ("width", "height", "position") else T.StringType()) for n in "url type extracted_by alt width height thumbnail position".split()])


@F.pandas_udf(ARTICLE)
def article_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([article(h) for h in html], columns=["title", "content", "published"])


@F.pandas_udf(_STRINGS)
def links_udf(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([links(h, b or "") for h, b in zip(html, base, strict=True)])


@F.pandas_udf(T.StringType())
def resolve_udf(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(h, b or "") for h, b in zip(href, base, strict=True)])


def feed_media(entries: list[dict] | None, base: str) -> list[dict]:
    """Media that a feed's item states: dicts of url, kind (MIME type or medium) and extracted_by."""
    found = []
    for entry in entries or []:
        url, kind = resolve(entry["url"] or "", base), (entry["kind"] or "").lower()
        if url and all(f["url"] != url for f in found):
            of = "video" if kind.startswith("video") else "audio" if kind.startswith("audio") else "gif" if kind == "image/gif" else "image"
            found.append({"url": url, "type": of, "extracted_by": entry["extracted_by"], "alt": None, "width": None, "height": None, "thumbnail": None, "position": len(found)})
    return found


def payload_media(entries: list[dict] | None, base: str) -> list[dict]:
    """Media of an interface's payload: dicts of url and featured."""
    stated = [{"url": e["url"], "kind": "image", "extracted_by": "api_payload"} for e in entries or []]
    return feed_media(stated, base)


#: Extractors in the order in which their finds count, publishers' own data first.
EXTRACTORS = (
    ("metadata", lambda html, base, feed, payload: metadata_media(html, base) if html else []),
    ("feed", lambda html, base, feed, payload: feed_media(feed, base)),
    ("payload", lambda html, base, feed, payload: payload_media(payload, base)),
    ("content", lambda html, base, feed, payload: content_media(html, base) if html else []),
)


def extracted(html: str | None, base: str | None, feed: list[dict] | None = None, payload: list[dict] | None = None, extractors=EXTRACTORS) -> tuple[list[dict], list[str]]:
    """(finds of all extractors in order, names of those that failed); one that fails leaves the others' finds."""
    found: list[dict] = []
    failed: list[str] = []
    for name, run in extractors:
        try:
            found += run(html, base or "", feed, payload)
        except Exception:
            failed.append(name)
    return found, failed


EXTRACTED = T.StructType([T.StructField("media", T.ArrayType(MEDIA)), T.StructField("failed", _STRINGS)])


@F.pandas_udf(EXTRACTED)
def extracted_udf(html: pd.Series, base: pd.Series, feed: pd.Series, payload: pd.Series) -> pd.DataFrame:
    """struct<media, failed> of all four extractors; feed and payload are arrays of structs, or null."""
    rows = [extracted(*x) for x in zip(html, base, feed, payload, strict=True)]
    return pd.DataFrame({"media": [m for m, _ in rows], "failed": [f for _, f in rows]})


@F.pandas_udf(T.ArrayType(MEDIA))
def media_udf(html: pd.Series, base: pd.Series) -> pd.Series:
    """Media of metadata first, then of the content."""
    return pd.Series([metadata_media(h, b or "") + content_media(h, b or "") for h, b in zip(html, base, strict=True)])


@F.udtf(returnType=MEDIA)
class MediaTable:
    """SELECT * FROM media(html, url): a row for each medium of a page."""

    def eval(self, html: str, url: str):
        for m in metadata_media(html, url or "") + content_media(html, url or ""):
            yield tuple(m[c] for c in MEDIA.names)
