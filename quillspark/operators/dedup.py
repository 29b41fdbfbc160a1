"""Deduplication ladder: URL, content hash, perceptual hash, embedding."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import settings
from quillspark.functions import images, urls
from quillspark.operators.relations import first_by, top_k


def by_key(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Each row's canonical row: the least id with equal keys; a null key has no copies."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    least = df.where(known).groupBy(*keys).agg(F.min(id_column).alias("canonical"))
    return df.join(least, keys, "left").withColumn("canonical", F.coalesce("canonical", id_column)).withColumn("is_duplicate", F.col("canonical") != F.col(id_column))


def by_url(df: DataFrame, url: str, kind: str, id_column: str) -> DataFrame:
    return by_key(df.withColumn("canonical_url", urls.normalise(F.col(url))), ["canonical_url", kind], id_column)


def by_content(df: DataFrame, content: str, id_column: str) -> DataFrame:
    return by_key(df.withColumn("content_hash", F.sha2(content, 256)), ["content_hash"], id_column)


def nearest_hash(new: DataFrame, known: DataFrame, threshold: int = settings.HAMMING_THRESHOLD) -> DataFrame:
    """For each new row (id, kind, hash) the known row with the nearest perceptual hash; of equals the least id.

    Of two hashes that differ in at most ``threshold`` bits, one of three pieces of
    about 21 bits differs in a third of that at most. So each new hash looks for all
    pieces so near to its own, in an equi-join on pieces that have two million
    values each, and all pairs are found. Only different hashes meet, each with the
    two least ids that have it; two, as a row doesn't match its own id.
    """
    fit = lambda df: df.where(images.is_distinctive(F.col("hash")))
    banded = lambda df, near: df.withColumn("band", F.explode(images.pieces(F.col("hash"), 3, near)))
    mine = fit(new).select("id", "kind", "hash")
    theirs = fit(known).select(F.col("id").alias("match_id"), "kind", "hash").where("match_id is not null").distinct()
    two = top_k(theirs, ["kind", "hash"], [F.col("match_id")], 2)
    groups = two.groupBy("kind", "hash").agg(F.collect_list("match_id").alias("ids"))
    a = banded(mine.select("kind", "hash").distinct(), threshold // 3)
    b = banded(groups, 0).withColumnRenamed("hash", "match_hash")
    near = a.join(b, ["kind", "band"]).withColumn("distance", images.hamming(F.col("hash"), F.col("match_hash"))).where(F.col("distance") <= threshold)
    near = near.select("kind", "hash", "distance", F.explode("ids").alias("match_id")).groupBy("kind", "hash", "match_id").agg(F.min("distance").alias("distance"))
    nearest = top_k(near, ["kind", "hash"], [F.col("distance"), F.col("match_id")], 2).groupBy("kind", "hash").agg(F.array_sort(F.collect_list(F.struct("distance", "match_id"))).alias("nearest"))
    others = F.filter("nearest", lambda x: x["match_id"] != F.col("id"))
    best = mine.join(nearest, ["kind", "hash"]).withColumn("best", F.try_element_at(others, F.lit(1))).where("best is not null").groupBy("id").agg(F.min("best").alias("best"))
    return best.select("id", "best.match_id", F.col("best.distance").alias("distance"), images.match_confidence(F.col("best.distance"), threshold).alias("confidence"))


def nearest_known_hash(new: DataFrame, assets: DataFrame, now, days: int = settings.LOOKBACK_DAYS, kinds: list[str] = settings.VISUAL_TYPES, threshold: int = settings.HAMMING_THRESHOLD) -> DataFrame:
    """``nearest_hash`` against the visual assets of the last days that are no copies themselves.

    assets: id, kind, hash, duplicate_of_id, created_at.
    """
    recent = F.col("created_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")
    originals = assets.where(recent & F.col("duplicate_of_id").isNull() & F.col("kind").isin(kinds))
    return nearest_hash(new.where(F.col("kind").isin(kinds)), originals, threshold)


def piece_bits(n: int) -> int:
    """Bits in a piece of a vector: so many that about 64 vectors share one, and 14 at least."""
    return max(14, min(24, n.bit_length() - 6))


def cells(bits: int) -> list[int]:
    """Projections in each hash of a piece. A hash names the strongest of its projections and its sign: of 64, seven bits."""
    return [64] * (bits // 7) + ([1 << (bits % 7 - 1)] if bits % 7 else [])


@functools.cache
def meeting(projections: int, threshold: float, draws: int = 40000) -> float:
    """The probability that two vectors at the threshold have one hash, from draws; three standard errors less, so that it holds."""
    r = np.random.default_rng(92)
    a = r.standard_normal((draws, projections))
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * r.standard_normal((draws, projections))
    p = float((_strongest(a) == _strongest(b)).mean())
    return p - 3 * math.sqrt(p * (1 - p) / draws)


def piece_count(bits: int, threshold: float, recall: float = 0.999) -> int:
    """Pieces with which a pair at the threshold shares one with that probability."""
    return math.ceil(math.log(1 - recall) / math.log1p(-min(math.prod(meeting(c, threshold) for c in cells(bits)), 1 - 1e-9)))


def _strongest(projected: np.ndarray) -> np.ndarray:
    at = np.abs(projected).argmax(axis=1)
    return at * 2 + (projected[np.arange(len(at)), at] > 0)


def _pieces(bits: int, count: int, size: int):
    """(id, key, vector) -> (piece, id, key, vector): a row for each piece."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.random.default_rng(92)
        planes = [[r.standard_normal((size, c)) for c in cells(bits)] for _ in range(count)]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = part.column(2).flatten().to_numpy().reshape(-1, size)
                for k, hashes in enumerate(planes):
                    value = np.zeros(len(x), np.int64)
                    for plane in hashes:
                        value = value * 2 * plane.shape[1] + _strongest(x @ plane)
                    yield pa.RecordBatch.from_arrays([pa.array(value * count + k), *part.columns], ["piece", *part.schema.names])

    return rows


def _nearest_of_piece(x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, cosine) of the two most similar others of each row, the first of equals, where similar enough."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    unit = np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)
    for at in range(0, len(x), 512):
        near = unit[at : at + 512] @ unit.T
        own = np.arange(len(near))
        near[own, own + at] = np.nan
        hit = near >= threshold - 1e-6
        rows = own[hit.any(axis=1)]
        if len(rows):
            found = np.where(hit[rows], np.round(near[rows], 6), -2.0)
            for _ in range(2):
                best = found.argmax(axis=1)
                good = found[np.arange(len(rows)), best] > -2
                a, b = x[rows[good] + at], x[best[good]]
                # sums in the vectors' order, as SQL has them
                dot, aa, bb = (np.cumsum(p * q, axis=1)[:, -1] for p, q in ((a, b), (a, a), (b, b)))
                yield rows[good] + at, best[good], dot / (np.sqrt(aa) * np.sqrt(bb))
                found[np.arange(len(rows)), best] = -2.0


def _nearest_in_pieces(size: int, threshold: float):
    """Rows of ``_pieces`` in the order of piece and id -> (key, other, similarity); a piece is held at a time."""

    def matched(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        piece, keys = rows.column(0).to_numpy(), rows.column(2).combine_chunks()
        x = rows.column(3).combine_chunks().flatten().to_numpy().reshape(-1, size)
        starts = np.flatnonzero(np.diff(piece, prepend=piece[0] - 1))
        ends = np.append(starts[1:], len(piece))
        several = ends - starts > 1
        for start, end in zip(starts[several], ends[several], strict=True):
            for mine, other, similarity in _nearest_of_piece(x[start:end], threshold):
                if len(mine):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(mine + start)), keys.take(pa.array(other + start)), pa.array(similarity)], ["key", "other", "similarity"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.RecordBatch] = []
        for batch in batches:
            found.append(batch)
            if sum(b.num_rows for b in found) >= 10000:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
                found = []
        if found:
            yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            piece = batch.column(0).to_numpy()
            cut = int(np.searchsorted(piece, piece[-1]))
            if held and (cut or held[-1].column(0)[-1].as_py() != piece[-1]):
                yield from matched(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from matched(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from matched(pa.Table.from_batches(held))

    return lambda batches: together(whole(batches))


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest_vector(vectors: DataFrame, threshold: float = settings.EMBEDDING_THRESHOLD) -> DataFrame:
    """For each vector (id, vector) the most similar other one (of equals the least id), where it is similar enough.

    Candidates share a piece, which has about a 64th as many values as there are
    vectors, and there are as many pieces as find a pair at the threshold with
    probability 0.999. Vectors go to their pieces, and of each piece only the two
    nearest others of a vector come back: what moves grows with the vectors and not
    with their pairs, however many are similar. Equal vectors are one, with the two
    least ids that have it. Vectors that are null, empty, hold a null or have
    another length than most are left out, as are null ids.
    """
    known = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x))")
    n, size = known.agg(F.count("*"), F.mode(F.size("vector"), True)).first()
    if not n:
        return known.select("id", F.col("id").alias("match_id"), F.lit(0.0).alias("similarity"))
    text = F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")
    fit = known.where(F.size("vector") == size).withColumn("key", F.substring(F.unhex(F.sha2(text, 256)), 1, 16))
    two = top_k(fit.select("key", "id").distinct(), ["key"], [F.col("id")], 2).groupBy("key").agg(F.collect_list("id").alias("ids"))
    one = fit.groupBy("key").agg(F.min("id").alias("id"), F.min_by("vector", "id").alias("vector")).select("id", "key", "vector")
    bits = piece_bits(n)
    kind = one.schema["id"].dataType.simpleString()
    pieces = one.mapInArrow(_pieces(bits, piece_count(bits, threshold), size), f"piece long, id {kind}, key binary, vector array<double>")
    met = pieces.repartition("piece").sortWithinPartitions("piece", "id").mapInArrow(_nearest_in_pieces(size, threshold), "key binary, other binary, similarity double")
    both = met.groupBy("key", "other").agg(F.round(F.max("similarity"), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    # the two least of the most similar others, and its own other id where a vector is repeated
    near = both.join(two.withColumnRenamed("key", "other"), "other").select("key", F.explode("ids").alias("match_id"), "similarity")
    near = near.unionByName(two.select("key", F.explode("ids").alias("match_id"), F.lit(1.0).alias("similarity")))
    best = top_k(near, ["key"], [F.desc("similarity"), F.col("match_id")], 2).groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "match_id"))).alias("best"))
    found = fit.select("id", "key").distinct().join(best, "key").withColumn("m", F.try_element_at(F.filter("best", lambda x: x["match_id"] != F.col("id")), F.lit(1))).where("m is not null")
    return found.groupBy("id").agg(F.min("m").alias("m")).select("id", "m.match_id", (-F.col("m.far")).alias("similarity"))


def distinct_first(df: DataFrame, key: str, order: list) -> DataFrame:
    return first_by(df, [key], order)
