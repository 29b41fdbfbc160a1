"""Text functions: Column -> Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import settings

EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}](?:\\x{FE0F}|[\\x{1F3FB}-\\x{1F3FF}])?"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def null_if_blank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def topic_pattern(keywords: list[str] = settings.TOPIC_KEYWORDS) -> str:
    """Any of the phrases as whole words, with any white space between their words."""
    phrases = "|".join("\\s+".join(re.escape(w) for w in k.split()) for k in keywords)
    return f"(?iuU)\\b(?:{phrases})\\b"


def is_on_topic(text: Column, keywords: list[str] = settings.TOPIC_KEYWORDS, enabled: bool = True) -> Column:
    """Blank text is off topic; with the filter off, all is on topic."""
    return F.coalesce((F.trim(text) != "") & text.rlike(topic_pattern(keywords)), F.lit(False)) if enabled else F.lit(True)


def candidate_text(title: Column, summary: Column) -> Column:
    return F.trim(F.concat_ws(" ", title, summary))


def tokens(text: Column, stopwords: list[str] = settings.STOPWORDS) -> Column:
    """Lower-cased words with their repetitions, without stopwords."""
    return F.filter(word_list(text), lambda w: (w != "") & ~w.isin(stopwords))


def word_list(text: Column) -> Column:
    """Lower-cased words, maybe with an empty one at an end."""
    return F.split(F.lower(text), "[^\\p{L}\\p{N}]+")


def distinct_tokens(text: Column, stopwords: list[str] = settings.STOPWORDS) -> Column:
    """The different words of ``tokens``, by a hashed set."""
    return F.array_except(word_list(text), F.array(*map(F.lit, ["", *stopwords])))


def overlap_with_multiplicity(left: Column, right: Column) -> Column:
    """The elements of left that right has too; repeated ones stay."""
    both = let(F.struct(left.alias("left"), F.array_intersect(left, right).alias("common")), lambda x: F.filter(x["left"], lambda w: F.array_contains(x["common"], w)))
    return F.when(right.isNotNull(), both)


def sanitise(text: Column, max_emoji: int = 3) -> Column:
    """No zero-width or control characters, single spaces, at most one empty line, few emoji."""
    text = F.regexp_replace(text, "[\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\uFEFF]", "")
    text = F.regexp_replace(text, "[\\p{Cc}&&[^\\n]]", "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.trim(cap_emoji(text, max_emoji))


def cap_emoji(text: Column, most: int = 3) -> Column:
    """Emoji beyond the first ones go: text is cut at them, and only the first come back."""

    def capped(x: Column) -> Column:
        joined = F.zip_with(x["rest"], x["found"], lambda t, e: F.concat(F.coalesce(t, F.lit("")), F.coalesce(e, F.lit(""))))
        tail = F.array_join(F.slice(x["rest"], most + 1, F.greatest(F.size(x["rest"]), F.lit(1))), "")
        return F.when(F.size(x["found"]) <= most, x["text"]).otherwise(F.concat(F.array_join(F.slice(joined, 1, most), ""), tail))

    def parts(t: Column) -> Column:
        return F.struct(t.alias("text"), F.regexp_extract_all(t, F.lit(f"({EMOJI})"), 1).alias("found"), F.split(t, EMOJI).alias("rest"))

    return let(text, lambda t: let(parts(t), capped))


def is_long_enough(text: Column, least: int = 40) -> Column:
    return F.coalesce(F.length(F.trim(text)) >= least, F.lit(False))


def count_of(text: Column, kind: str) -> Column:
    """How many characters of a kind (a Unicode property) a text has; runs go at once."""
    return F.length(text) - F.length(F.regexp_replace(text, f"\\p{{{kind}}}+", ""))


def is_of_script(letters: Column, of_script: Column, least: float = 0.5) -> Column:
    """Whether enough letters are of a script, from their numbers; without letters none are."""
    return F.coalesce((letters > 0) & (of_script / F.nullif(letters, F.lit(0)) >= least), F.lit(False))


def matches_script(text: Column, script: str | None, least: float = 0.5) -> Column:
    """Whether enough letters are of a script; without a script all texts match, without letters none."""
    return is_of_script(count_of(text, "L"), count_of(text, f"Is{script}"), least) if script else F.lit(True)


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def truncate_at_word(text: Column, most: Column | int) -> Column:
    """At most so many UTF-16 units: cut at the last space if that is past the half, an ellipsis behind."""
    most = F.lit(most) if isinstance(most, int) else most

    def at_space(x: Column) -> Column:
        space = F.length(x["cut"]) - F.length(F.regexp_extract(x["cut"], "([^ ]*)$", 1)) - 1
        cut = F.when((space >= 0) & (space > x["most"] / 2), F.substring(x["cut"], F.lit(1), space)).otherwise(x["cut"])
        return F.concat(F.regexp_replace(cut, "[ \\t\\n,;:—-]+$", ""), F.lit("…"))

    def cut(x: Column) -> Column:
        # a character of two units isn't cut in half
        half = F.hex(F.substring(x["units"], F.greatest(F.length(x["units"]) - 1, F.lit(1)), F.lit(1))).rlike("^D[89AB]$")
        whole = F.decode(F.substring(x["units"], F.lit(1), F.length(x["units"]) - F.when(half, 2).otherwise(0)), "UTF-16BE")
        return let(F.struct(whole.alias("cut"), x["most"].alias("most")), at_space)

    def short(x: Column) -> Column:
        units = F.substring(F.encode(x["text"], "UTF-16BE"), F.lit(1), 2 * F.greatest(x["most"] - 1, F.lit(0)))
        return let(F.struct(units.alias("units"), x["most"].alias("most")), cut)

    whole = F.struct(text.alias("text"), most.alias("most"))
    return let(whole, lambda x: F.when(x["most"] <= 1, "").when(utf16_length(x["text"]) <= x["most"], x["text"]).otherwise(short(x)))


def hashtags(tags: Column, most: int = 4) -> Column:
    """Letters, digits and _ of each tag, lower-cased, distinct, the first few joined; null if none is left."""
    bare = F.filter(F.transform(tags, lambda t: F.lower(F.regexp_replace(t, "[^\\p{L}\\p{N}_]", ""))), lambda t: F.length(t) >= 2)
    return F.nullif(F.array_join(F.transform(F.slice(F.array_distinct(bare), 1, most), lambda t: F.concat(F.lit("#"), t)), " "), F.lit(""))


def escape(text: Column) -> Column:
    """HTML's & < > in a text."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_attribute(text: Column) -> Column:
    return F.replace(F.replace(escape(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#039;"))


def strip_tags(markup: Column) -> Column:
    """Text without tags, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), "\\s+", " "))


def excerpt(text: Column, most: int = 500) -> Column:
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…")))


def fallback_markup(title: Column, body: Column) -> Column:
    """A page made of a feed's own content."""
    return F.concat(F.lit("<article><h1>"), escape(F.coalesce(title, F.lit(""))), F.lit("</h1>"), F.coalesce(body, F.lit("")), F.lit("</article>"))


MEDIA_LIMIT, TEXT_LIMIT, MARGIN = 1024, 4096, 24


def caption(header: Column, sections: Column, humour: Column, link: Column, tags: Column, limit: int = MEDIA_LIMIT, margin: int = MARGIN) -> Column:
    """The longest form that fits the limit.

    sections: array<struct<title, body>>. All parts; then without tags, without
    humour, with bodies cut to equal shares of what is left, without titles; at
    last the link alone. All parts are plain text, so the visible length is the
    text's own. A null or blank part is left out; a body that is null is empty.
    """
    budget = limit - margin
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    block = lambda title, body: F.concat_ws("\n\n", F.nullif(blank(title), F.lit("")), F.nullif(blank(body), F.lit("")))

    def join(x: Column, blocks: Column, *behind: Column) -> Column:
        parts = F.concat(F.array(x["header"]), blocks, F.array(*behind))
        return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (F.trim(p) != "")), "\n\n")

    fits = lambda text: utf16_length(text) <= budget
    no_title = F.lit(None).cast("string")

    def trimmed(x: Column) -> Column:
        bare = join(x, F.transform(x["sections"], lambda s: block(s["title"], no_title)), x["link"])
        share = F.floor(F.greatest(F.lit(0), F.lit(budget) - utf16_length(bare)) / F.greatest(F.lit(1), F.size(x["sections"]))).cast("int")
        return let(F.struct(share.alias("share"), x.alias("x")), lambda y: F.transform(y["x"]["sections"], lambda s: F.struct(s["title"].alias("title"), truncate_at_word(blank(s["body"]), y["share"]).alias("body"))))

    def shortened(x: Column, cut: Column) -> Column:
        titled = join(x, F.transform(cut, lambda s: block(s["title"], s["body"])), x["link"])
        untitled = join(x, F.transform(cut, lambda s: block(no_title, s["body"])), x["link"])
        return let(titled, lambda t: F.when(fits(t), t).otherwise(let(untitled, lambda u: F.when(fits(u), u).otherwise(x["link"]))))

    def chosen(x: Column) -> Column:
        blocks = F.transform(x["sections"], lambda s: block(s["title"], s["body"]))
        forms = F.array(join(x, blocks, x["humour"], x["link"], x["tags"]), join(x, blocks, x["humour"], x["link"]), join(x, blocks, x["link"]))
        first = let(forms, lambda f: F.try_element_at(F.filter(f, fits), F.lit(1)))
        return let(first, lambda f: F.when(f.isNotNull(), f).otherwise(let(trimmed(x), lambda cut: shortened(x, cut))))

    given = F.struct(header.alias("header"), sections.alias("sections"), humour.alias("humour"), link.alias("link"), tags.alias("tags"))
    return let(given, chosen)
