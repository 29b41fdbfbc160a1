"""What a bounded HTTP client knows and keeps, as columns and rows; the request itself is the caller's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_headers(headers: Column) -> Column:
    """Header map without entries that hold line ends or a colon in their name, names lower-cased; of equal names the last."""
    fit = F.map_filter(headers, lambda k, v: ~k.rlike("[\\r\\n:]") & ~v.rlike("[\\r\\n]") & (F.trim(k) != ""))
    return merged_headers(fit)


def merged_headers(*maps: Column) -> Column:
    """Header maps as one with lower-cased names; a later map's value replaces an earlier one's, whatever the case."""
    entries = F.concat(*(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def last_wins(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda e: e["key"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(found, lambda e: e["key"] == n), -1)["value"]))

    return F.get(F.transform(F.array(lowered), last_wins), F.lit(0))


def head_info(headers: Column) -> Column:
    """struct<content_length, content_type> of a response's headers (lower-cased names), the type without parameters."""
    kind = F.nullif(F.trim(F.substring_index(F.lower(F.try_element_at(headers, F.lit("content-type"))), ";", 1)), F.lit(""))
    return F.struct(F.try_element_at(headers, F.lit("content-length")).try_cast("long").alias("content_length"), kind.alias("content_type"))


def total_size(status: Column, headers: Column) -> Column:
    """Size of the whole file behind a range request: from Content-Range, else Content-Length where the whole was sent."""
    ranged = F.regexp_extract(F.coalesce(F.try_element_at(headers, F.lit("content-range")), F.lit("")), "/(\\d+)\\s*$", 1)
    return F.when(ranged != "", ranged.try_cast("long")).when(status == 200, F.try_element_at(headers, F.lit("content-length")).try_cast("long"))


def first_bytes(content: Column, most: int) -> Column:
    """The part of a body that a range request asks for, also where a server sends all of it."""
    return F.substring(content, F.lit(1), F.lit(most))


def conditional(status: Column, body: Column, etag: Column, modified: Column, old_etag: Column, old_modified: Column) -> Column:
    """struct<body, etag, last_modified>: an unchanged feed (304) has no body and keeps its validators."""
    same = status == 304
    return F.struct(F.when(~same, body).alias("body"), F.when(same, old_etag).otherwise(etag).alias("etag"), F.when(same, old_modified).otherwise(modified).alias("last_modified"))


def changed_only(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of the binaryFile source whose content wasn't seen at their path: (path, content_hash) of ``seen``."""
    return files.withColumn("content_hash", F.sha2("content", 256)).join(seen.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def bounded(files: DataFrame, most: int) -> DataFrame:
    """Rows of the binaryFile source that are neither empty nor too large."""
    return files.where(F.col("length").between(1, most))


def save(chunks: Iterable[bytes], path: str, most: int) -> int:
    """Write a body to a file chunk by chunk; one that is empty or larger than allowed raises and leaves no file."""
    import os

    size = 0
    try:
        with open(path, "wb") as out:
            for chunk in chunks:
                size += len(chunk)
                if size > most:
                    raise ValueError(f"more than {most} bytes")
                out.write(chunk)
        if not size:
            raise ValueError("an empty body")
    except BaseException:
        if os.path.exists(path):
            os.remove(path)
        raise
    return size
