"""Main text of web pages by a linear-chain conditional random field.

A page becomes a list of leaf blocks: runs of text that no block element
divides, with the chain of elements around them. Features are the block's own
tag, its ancestors' tags, families of words in their class, id and role, and
signs of the text (length, links, sentence ends). The field labels the whole
list at once by Viterbi, so that a short line between article paragraphs is
judged with them. It is trained, by the gradient of the exact likelihood, on
labelled pages; ``labelled_pages`` makes such pages from many layouts.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"
TRAINING_PAGES = 400
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*\Z",
    re.DOTALL,
)
#: Elements whose content isn't text of the page: from their tag to their end tag. Without one, only scripts and styles run to the page's end.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in "script style noscript template title svg iframe select textarea object".split()}
_ENDLESS, _UNSEEN = ("script", "style"), ("script", "style", "noscript", "template")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES_SELF = frozenset("li dt dd tr td th option".split())
_SCOPE = frozenset("article aside body div footer form header main nav section table ul ol td blockquote".split())
_TAGS = "nav header footer aside article main form section ul ol table figure button label blockquote pre address dialog menu".split()
_FAMILIES = {
    "ad": r"ad|ads|advert\w*|adv|adsby\w*|adslot|sponsor\w*|promo\w*|banner|dfp|taboola|outbrain",
    "comment": r"comment\w*|disqus\w*|repl(?:y|ies)|respond|discussion|reader\w*|feedback|reviews?",
    "nav": r"nav\w*|menu\w*|breadcrumb\w*|crumbs?|pagination|pager|toolbar|topbar|tabs?|navigation|search|skip|links",
    "side": r"side\w*|widget\w*|rail|complementary|aside|column2",
    "foot": r"foot\w*|copyright|colophon|contentinfo|legal|bottom",
    "head": r"header|masthead|top|logo|brand\w*|site|hero",
    "notice": r"cookie\w*|consent|gdpr|notice\w*|alert\w*|warning|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|login|form|dialog",
    "extra": r"share|sharing|social|related|recommend\w*|trending|popular|latest|tags?|teaser\w*|more|also|author|byline|bio",
    "content": r"content|article\w*|post|entry|story|main|body|text|page|blog|prose|lead",
}
_FAMILY = {name: re.compile(rf"(?:^|[\W_])(?:{words})(?:$|[\W_])", re.IGNORECASE) for name, words in _FAMILIES.items()}
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")


class Block:
    """A leaf block: text, its own element, ancestor tags and families, characters inside of links."""

    __slots__ = ("families", "linked", "parts", "tag", "tags")

    def __init__(self, tag: str, tags: frozenset[str], families: frozenset[str]):
        self.tag, self.tags, self.families, self.parts, self.linked = tag, tags, families, [], 0


@lru_cache(4096)
def _families(attributes: str) -> frozenset[str]:
    found = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            found.add("hidden")
        elif name in ("class", "id", "role"):
            value = _CAMEL.sub(r"\1-\2", value)
            found |= {k for k, pattern in _FAMILY.items() if pattern.search(value)}
    return frozenset(found)


_NONE: frozenset[str] = frozenset()


def blocks(page: str) -> list[tuple[str, Block]]:
    """(text, block) of each leaf block with text, in page order."""
    # each entry: tag, ancestor tags with it, families of it and its ancestors, depth of links
    stack: list[tuple[str, frozenset, frozenset, int]] = [("", _NONE, _NONE, 0)]
    found: list[Block] = []
    now: Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            if text.isspace():
                return
            k = len(stack) - 1
            while k and stack[k][0] in _INLINE:
                k -= 1
            now = Block(stack[k][0], stack[-1][1], stack[-1][2])
            found.append(now)
        now.parts.append(text)
        if stack[-1][3]:
            now.linked += len(text)

    def pop_to(k: int) -> None:
        del stack[k:]

    unclosed: set[str] = set()
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
        if tag in _RAW and not closing:
            itself = attributes.rstrip().endswith("/")
            end = None if itself or tag in unclosed else _RAW[tag].search(page, at)
            if itself or end or tag in _ENDLESS:
                at = at if itself else end.end() if end else len(page)
                now = now if tag in _UNSEEN else None
                continue
            unclosed.add(tag)
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            now = None
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag not in _SCOPE and stack[k][0] in _SCOPE:
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P or tag in _CLOSES_SELF:
            same = "p" if tag in _CLOSES_P else tag
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == same or same == "p" and stack[k][0] in ("h1", "h2", "h3", "h4", "h5", "h6") and tag[0] == "h" and tag[1:].isdigit():
                    pop_to(k)
                    break
                if stack[k][0] in _SCOPE:
                    break
        _, tags, families, links = stack[-1]
        own = _families(attributes) if attributes.strip() else _NONE
        stack.append((tag, tags if tag in tags else tags | {tag}, families | own if own else families, links + (tag == "a")))
    add(page[at:])
    out = []
    for b in found:
        text = " ".join(html.unescape("".join(b.parts)).split())
        if text and "head" not in b.tags:
            out.append((text, b))
    return out


_ENDS = (".", "!", "?", "…", '."', ".”", ".»", "。")


def features(page: list[tuple[str, Block]]) -> list[list[str]]:
    """Names of the features that each block has."""
    out = []
    for k, (text, b) in enumerate(page):
        n_words = text.count(" ") + 1
        links = b.linked / max(1, sum(map(len, b.parts)))
        f = ["bias", "own:" + b.tag, "words:" + ("1" if n_words < 4 else "2" if n_words < 10 else "3" if n_words < 25 else "4")]
        f.append("links:" + ("0" if links == 0 else "1" if links < 0.35 else "2" if links < 0.75 else "3"))
        f += ["in:" + t for t in _TAGS if t in b.tags]
        f += ["of:" + x for x in b.families]
        if not b.tags & {"article", "main"} and "content" not in b.families:
            f.append("loose")
        bare = text.rstrip("*#$%&|<>")
        f.append("ends" if bare.endswith(_ENDS) else "open")
        if "©" in text or "(c)" in text.lower():
            f.append("copyright")
        if "·" in text or "|" in text or "»" in text or "›" in text:
            f.append("separators")
        if k == 0 or k == len(page) - 1:
            f.append("edge")
        out.append(f)
    return out


class Field:
    """Weights of a linear-chain field with two labels (0 other, 1 main text)."""

    def __init__(self, names: list[str], weights: np.ndarray, transitions: np.ndarray):
        # only the difference of a feature's two weights matters
        self.gain = dict(zip(names, (weights[:, 1] - weights[:, 0]).tolist(), strict=True))
        self.transitions = transitions.tolist()

    def decode(self, page: list[list[str]]) -> list[int]:
        """The best labels (Viterbi); of equals, 0."""
        (t00, t01), (t10, t11) = self.transitions
        low, high, back, gain = 0.0, 0.0, [], self.gain
        for k, names in enumerate(page):
            score = sum([gain.get(x, 0.0) for x in names])
            if not k:
                high = score
                continue
            from_low = (low + t00 >= high + t10, low + t01 >= high + t11)
            back.append(from_low)
            low, high = (low + t00 if from_low[0] else high + t10), (low + t01 if from_low[1] else high + t11) + score
        if not page:
            return []
        label, out = int(high > low), []
        for from_low in reversed(back):
            out.append(label)
            label = 0 if from_low[label] else 1
        out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Fit a field to pages of (features of blocks, labels) by Adam on the mean log likelihood."""
    pages = [p for p in pages if p[1]]
    names = sorted({x for page, _ in pages for f in page for x in f})
    index = {x: i for i, x in enumerate(names)}
    size, longest = len(pages), max(len(y) for _, y in pages)
    x = np.zeros((size, longest, len(names)), np.float32)
    y = np.zeros((size, longest), int)
    mask = np.zeros((size, longest), bool)
    for i, (page, labels) in enumerate(pages):
        for k, f in enumerate(page):
            x[i, k, [index[v] for v in f]] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    flat, pair = x[mask], mask[:, 1:] & mask[:, :-1]
    truth_w = np.stack([flat[y[mask] == c].sum(axis=0) for c in (0, 1)], axis=1)
    truth_t = np.array([[(pair & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    theta = np.zeros(len(names) * 2 + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        score = np.zeros((size, longest, 2))
        score[mask] = flat @ w
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for k in range(1, longest):
            forward[:, k] = np.logaddexp(forward[:, k - 1, :1] + t[0], forward[:, k - 1, 1:] + t[1]) + score[:, k]
        for k in range(longest - 2, -1, -1):
            ahead = backward[:, k + 1] + score[:, k + 1]
            value = np.logaddexp(ahead[:, :1] + t[:, 0], ahead[:, 1:] + t[:, 1])
            backward[:, k] = np.where(mask[:, k + 1, None], value, 0)
        total = np.logaddexp(*(forward + backward)[:, 0].T)
        share = np.exp(forward + backward - total[:, None, None])[mask]
        both = np.exp(np.minimum(0, forward[:, :-1, :, None] + t + (score + backward)[:, 1:, None, :] - total[:, None, None, None]))[pair].sum(axis=0)
        gradient = np.concatenate([(truth_w - flat.T @ share).ravel(), (truth_t - both).ravel()]) / len(flat) - ridge * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(names, theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[str, str]]:
    """Made pages and their main text: many layouts with menus, adverts, notices, forms, comments around an article.

    A stand-in for pages that reviewers have labelled.
    """
    r = random.Random(seed)
    parts = "ba ne lo ti ra su mi ko ve da por len sta min der al ish ing on ter".split()
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: phrase(3, 22).capitalize() + r.choice("....!?")
    prose = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'

    def menu() -> str:
        items = [link() for _ in range(r.randint(3, 9))]
        listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice([f"<nav>{listed}</nav>", f'<div class="menu">{listed}</div>', f'<ul id="main-nav">{listed[4:]}', f'<nav class="navbar">{" | ".join(items)}</nav>', f'<div role="navigation">{listed}</div>', f'<p class="breadcrumbs">{" » ".join(items[:3])}</p>'])

    def header() -> str:
        inner = r.choice([f"<p>{phrase(2, 6)}</p>", f"<h2>{phrase(1, 3)}</h2>", f'<a href="/">{phrase(1, 2)}</a>', f"<span>{sentence()}</span>"])
        return r.choice([f"<header>{inner}</header>", f'<div class="site-header">{inner}</div>', f'<div id="masthead">{inner}</div>'])

    def advert() -> str:
        text = r.choice([sentence, lambda: prose(1, 4), lambda: phrase(2, 6)])()
        text = r.choice([text, f"<p>{text}</p>", f'<a href="/x">{text}</a>'])
        return f"<!-- ad {r.randint(0, 99)} -->" * r.randint(0, 1) + r.choice([f'<div class="ad">{text}</div>', f'<div class="advert box">{text}</div>', f'<aside class="sponsored">{text}</aside>', f'<div id="ad-slot-{r.randint(1, 9)}">{text}</div>', f'<section class="promo">{text}</section>', f'<div class="banner-ad">{text}</div>'])

    def notice() -> str:
        text = f"<p>{prose(1, 3)}</p><button>{phrase(1, 2)}</button>"
        return r.choice([f'<div class="cookie-notice">{text}</div>', f'<div id="consent">{text}</div>', f'<div class="newsletter">{text}</div>', f'<div role="alert" class="notice">{prose(1, 2)}</div>', f'<div class="popup">{text}</div>', f"<dialog>{text}</dialog>"])

    def form() -> str:
        return f'<form action="/s"><label>{phrase(1, 3)}</label><input name="q"><p>{sentence()}</p><button>{phrase(1, 2)}</button></form>'

    def sidebar() -> str:
        inner = r.choice([f"<h3>{phrase(1, 3)}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<h3>{phrase(1, 3)}</h3><p>{prose(1, 3)}</p>", f"<p>{prose(1, 2)}</p>"])
        return r.choice([f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div id="side-rail" class="widget">{inner}</div>', f'<div class="related">{inner}</div>'])

    def comments() -> str:
        one = lambda: r.choice([f'<div class="comment"><b>{word()}</b><p>{prose(1, 4)}</p></div>', f'<li class="comment">{prose(1, 3)}</li>', f'<article class="comment"><p>{prose(1, 3)}</p></article>', f"<p>{prose(1, 3)}</p>"])
        inner = f"<h3>{phrase(1, 2)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6)))
        return r.choice([f'<section class="comments">{inner}</section>', f'<div id="comments">{inner}</div>', f'<ol class="comment-list">{inner}</ol>', f'<div class="reader-comments">{inner}</div>'])

    def footer() -> str:
        inner = r.choice([f"&copy; {word()}.example &middot; {prose(1, 2)}", f"<p>&copy; 2024 {phrase(1, 4)}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul><p>{sentence()}</p>", prose(1, 2)])
        return r.choice([f"<footer>{inner}</footer>", f'<div class="footer">{inner}</div>', f'<div id="footer" role="contentinfo">{inner}</div>'])

    def article() -> tuple[str, list[str]]:
        title, texts, inner = phrase(2, 10).capitalize() + r.choice(["", ".", "?"]), [], ""
        if r.random() < 0.9:
            texts.append(title)
            inner += r.choice([f"<h1>{title}</h1>", f"<h2>{title}</h2>", f'<h1 class="title">{title}</h1>'])
        for _ in range(r.randint(1, 9)):
            text = prose(1, 6) if r.random() < 0.85 else r.choice([phrase(1, 8), sentence()])
            kind = r.random()
            if kind < 0.72:
                inner += f"<p>{text}</p>"
            elif kind < 0.8:
                first, _, rest = text.partition(" ")
                inner += f'<p><b>{first}</b> <a href="/y">{rest}</a>' if len(rest) < 30 else f"<p><b>{text}<br>"
            elif kind < 0.87:
                inner += "<ul>" + f"<li>{text}</li></ul>"
            elif kind < 0.92:
                inner += f"<blockquote>{text}</blockquote>"
            elif kind < 0.96:
                inner += f"<h3>{text}</h3>"
            else:
                inner += f"<table><tr><td>{text}</td></tr></table>"
            texts.append(text)
            if r.random() < 0.08:
                inner += advert()
        open_tag, close = r.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ('<section class="story">', "</section>"), ('<div class="entry-content">', "</div>"), ("<div>", "</div>")])
        return open_tag + inner + close, texts

    made = []
    for _ in range(n):
        before = [f() for f in (header, menu, advert, notice, form, menu) if r.random() < 0.5]
        body, texts = article()
        after = [f() for f in (advert, sidebar, form, comments, notice, footer, footer) if r.random() < 0.45]
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{phrase(2, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        made.append((head + "".join(before) + body + "".join(after) + "</body></html>" * (r.random() < 0.9), " ".join(texts)))
    return made


def examples(pages: list[tuple[str, str]]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of labelled pages: the blocks that, in order, make up the main text."""
    out = []
    for page, text in pages:
        found, at, labels = blocks(page), 0, []
        for own, _ in found:
            # a block belongs to the text where it continues it
            fits = text.startswith(own, at) and (at + len(own) == len(text) or text[at + len(own)] == " ")
            labels.append(int(fits))
            at += (len(own) + 1) * fits
        out.append((features(found), labels))
    return out


@lru_cache(1)
def default_field() -> Field:
    return train(examples(labelled_pages()))


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    return " ".join(text for (text, _), label in zip(found, field.decode(features(found)), strict=True) if label)


def _extracted(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", field) for p in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars.

    pages: page_id, url, html; other columns are left out. A null or empty page
    has the text ''; so has one without main text. Repeated rows are extracted
    each by itself; pages of any length are taken whole; an empty table gives no
    rows.
    """
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(_extracted(field or default_field()), SCHEMA)
