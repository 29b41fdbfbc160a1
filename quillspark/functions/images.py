"""Image functions: hashes, sizes, roles."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import settings
from quillspark.functions import texts, urls


def _half(hash64: Column, k: int) -> Column:
    return F.conv(F.substring(hash64, 8 * k + 1, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; 64 where their lengths differ."""
    bits = sum((F.bit_count(_half(a, k).bitwiseXOR(_half(b, k))) for k in (1,)), F.bit_count(_half(a, 0).bitwiseXOR(_half(b, 0))))
    return F.when((F.length(a) == 16) & (F.length(b) == 16), bits).otherwise(F.lit(64))


def is_distinctive(hash64: Column, least: int = 6) -> Column:
    """Whether a 64-bit hash has enough bits of the rarer kind."""
    ones = F.bit_count(_half(hash64, 0)) + F.bit_count(_half(hash64, 1))
    return F.coalesce(F.when(F.length(hash64) == 16, F.least(ones, F.lit(64) - ones) >= least), F.lit(False))


def match_confidence(distance: Column, threshold: int = settings.HAMMING_THRESHOLD) -> Column:
    return F.round(F.lit(1.0) - distance / F.lit(max(1, 2 * threshold)), 2)


def pieces(hash64: Column, count: int, near: int = 0) -> Column:
    """The 64 bits in ``count`` pieces, as array<long>, each with its number; and all that differ from one in at most ``near`` bits."""
    value = F.conv(hash64, 16, -10).cast("long")

    def piece(k: int) -> Column:
        a, b = 64 * k // count, 64 * (k + 1) // count
        flips = [sum(1 << x for x in chosen) for n in range(near + 1) for chosen in itertools.combinations(range(b - a), n)]
        own = F.shiftrightunsigned(value, 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1))
        masks = F.from_json(F.lit(json.dumps(flips)), "array<bigint>")
        return F.get(F.transform(F.array(own), lambda x: F.transform(masks, lambda flip: x.bitwiseXOR(flip) * F.lit(count) + F.lit(k))), F.lit(0))

    return F.concat(*map(piece, range(count)))


def _grey(image: pd.DataFrame) -> list[np.ndarray | None]:
    """Grey planes of rows of Spark's image source (BGR)."""
    planes = []
    for height, width, channels, data in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True):
        if data is None or height <= 0:
            planes.append(None)
            continue
        pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
        planes.append(pixels[:, :, 0] if channels == 1 else pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299]))
    return planes


def shrink(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas (the nearest pixel where an area is smaller than one)."""
    rows = [np.arange(int(plane.shape[0] * k / height), max(int(plane.shape[0] * k / height) + 1, int(plane.shape[0] * (k + 1) / height))) for k in range(height)]
    columns = [np.arange(int(plane.shape[1] * k / width), max(int(plane.shape[1] * k / width) + 1, int(plane.shape[1] * (k + 1) / width))) for k in range(width)]
    return np.array([[plane[np.ix_(r, c)].mean() for c in columns] for r in rows])


def difference_hash(plane: np.ndarray) -> str:
    """64 bits: whether each of 8 pixels in 8 rows is darker than its right neighbour."""
    small = shrink(plane, 8, 9)
    bits = (small[:, :-1] < small[:, 1:]).ravel()
    return np.packbits(bits).tobytes().hex()


def sharpness(plane: np.ndarray) -> float:
    """Mean step between neighbours in a row of a 64 x 64 reduction, 25 or more being 1."""
    small = shrink(plane, 64, 64)
    return round(min(1.0, float(np.abs(np.diff(small, axis=1)).mean()) / 25), 4)


@F.pandas_udf(T.StringType())
def image_hash(image: pd.DataFrame) -> pd.Series:
    return pd.Series([None if p is None else difference_hash(p) for p in _grey(image)])


@F.pandas_udf(T.DoubleType())
def image_sharpness(image: pd.DataFrame) -> pd.Series:
    return pd.Series([None if p is None else sharpness(p) for p in _grey(image)])


def name_dimensions(url: Column) -> tuple[Column, Column]:
    """Width and height in the last WxH of the file's name; null without one."""
    last = lambda k: F.try_element_at(F.regexp_extract_all(urls.stem(url), F.lit("(\\d{2,5})x(\\d{2,5})"), k), F.lit(-1)).cast("int")
    return last(1), last(2)


def _holds(text: Column, markers: list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m)), F.lit(False))


def role(url: Column, alt: Column, width: Column, height: Column) -> Column:
    """pixel, avatar, promo, chrome or content; the first that fits.

    A URL's parts are bound once, so that they aren't read again for each marker.
    """
    edge = lambda c: F.coalesce((c > 0) & (c <= settings.PIXEL_MAX_EDGE), F.lit(False))
    path = F.lower(F.concat(F.coalesce(urls.part(url, "PATH"), url), F.lit("?"), F.coalesce(urls.part(url, "QUERY"), F.lit(""))))
    site, caption = F.coalesce(urls.host(url), F.lit("")), F.lower(F.trim(F.coalesce(alt, F.lit(""))))
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    in_name = name_dimensions(url)
    size = F.struct(F.when(known, width).otherwise(F.coalesce(in_name[0], width)).alias("w"), F.when(known, height).otherwise(F.coalesce(in_name[1], height)).alias("h"))

    def square(x: Column) -> Column:
        w, h = x["w"], x["h"]
        return F.coalesce((w > 0) & (h > 0) & (F.greatest(w, h) <= settings.SQUARE_MAX_EDGE) & (F.abs(w / F.nullif(h, F.lit(0)) - 1) <= settings.SQUARE_TOLERANCE), F.lit(False))

    def by_text(x: Column) -> Column:
        return (
            F.when(_holds(x["site"], settings.AVATAR_HOSTS) | _holds(x["path"], settings.AVATAR_URL_MARKERS) | _holds(x["caption"], settings.AVATAR_ALT_MARKERS), "avatar")
            .when(_holds(x["path"], settings.PROMO_URL_MARKERS), "promo")
            .when(_holds(x["path"], settings.CHROME_URL_MARKERS) | _holds(x["caption"], settings.CHROME_ALT_MARKERS), "chrome")
        )

    parts = F.struct(site.alias("site"), path.alias("path"), caption.alias("caption"))
    return F.when(edge(width) | edge(height), "pixel").otherwise(F.coalesce(texts.let(parts, by_text), F.when(texts.let(size, square), "avatar").otherwise("content")))


def media_type(mime: Column) -> Column:
    m = F.lower(mime)
    return F.when(m == "image/gif", "gif").when(m.startswith("image/"), "image").when(m.startswith("video/"), "video").when(m.startswith("audio/"), "audio").otherwise("document")


def unusable_dimensions(width: Column, height: Column) -> Column:
    """Too small, too long, or too large a picture; unknown sizes pass."""
    ratio = width / F.nullif(height, F.lit(0))
    bad = (width < settings.MIN_EDGE) | (height < settings.MIN_EDGE) | (ratio < 0.25) | (ratio > 4.0) | (width + height > settings.MAX_EDGE_SUM)
    return F.coalesce((width > 0) & (height > 0) & bad, F.lit(False))


def fitted(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size of a variant whose width is at most ``most``."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / width)
    return F.round(width * scale).cast("int"), F.round(height * scale).cast("int")
