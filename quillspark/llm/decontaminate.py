"""Benchmark decontamination by a prefix-filtered set join.

An item is a set of windows of consecutive words, and a window is a set of
shingles of three words with their places in it. A window only occurs in a
document that holds all of its shingles, so by the prefix principle (for
containment 1 the prefix is one element long) it is enough to join on the
window's rarest shingle. Rarity is counted over all documents. A joined place
must leave room for the whole window in the document (position and length
bounds), then all of the window's words are compared by hash and at last
letter by letter.

Only the benchmark's side travels, in blocks of at most ``BLOCK_CHARS``
characters (one item more at most); each block meets all documents in a scan,
without a shuffle of texts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.quality import per_text
from quillspark.llm.textbytes import ALNUM, U, Words, mix, powers, ragged, slices, windows, words

WINDOW = 8
SHINGLE = 3
MIN_ITEMS = 2
BLOCK_CHARS = 4_000_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_HITS = "doc_id long, text_key string, n_words long, starts array<long>, sizes array<long>, items array<string>"
_MIX = U(0xD6E8FEB86659FD93)


@dataclass
class Block:
    """Windows of some items, sorted by their prefix shingle."""

    shingles: dict[int, np.ndarray]  # all shingles by size, sorted
    size: np.ndarray
    prefix: np.ndarray
    offset: np.ndarray
    whole: np.ndarray  # hash of all words
    text: list[bytes]  # words, each with a space behind
    items: list[list[str]]


def _joined(w: Words, first: int, size: int) -> bytes:
    return b"".join(w.data[a:b].tobytes() + b" " for a, b in zip(w.starts[first : first + size], w.ends[first : first + size], strict=True))


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in h whose value is in the sorted keys, place of each in keys)."""
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    filter_bits = np.zeros(1 << 20, bool)
    filter_bits[(keys >> U(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(filter_bits[(h >> U(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    same = keys[at] == h[maybe]
    return maybe[same], at[same]


def build(items: list[tuple[object, str | None]], window: int = WINDOW, shingle: int = SHINGLE) -> tuple[Block, np.ndarray, np.ndarray]:
    """A block whose prefixes aren't chosen yet, with each window's shingles (a row for each window, padded by repetition) and how many it has."""
    texts: dict[tuple[int, bytes], list[str]] = defaultdict(list)
    sizes, wholes, rows = [], [], []
    for item_id, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        w = words(data, np.array([0, len(data)]), ALNUM, lower=True)
        n = len(w.hashes)
        size = min(window, n)
        if not n:
            continue
        small = windows(w, min(shingle, size))[1]
        wholes_here = windows(w, size)[1]
        for k in range(n - size + 1):
            key = (size, _joined(w, k, size))
            if key not in texts:
                sizes.append(size)
                wholes.append(wholes_here[k])
                own = small[k : k + size - min(shingle, size) + 1]
                rows.append(np.concatenate([own, np.full(window - len(own), own[0], np.uint64)]))
            if str(item_id) not in texts[key][-1:]:
                texts[key].append(str(item_id))
    size = np.array(sizes, np.int64)
    member = np.array(rows, np.uint64).reshape(len(rows), window)
    count = size - np.minimum(shingle, size) + 1
    of_size = {s: np.unique(member[np.minimum(shingle, size) == s]) for s in {int(x) for x in np.minimum(shingle, size)}}
    none = np.zeros(0, np.int64)
    return Block(of_size, size, none, none, np.array(wholes, np.uint64), [t for _, t in texts], list(texts.values())), member, count


def choose(block: Block, member: np.ndarray, count: np.ndarray, rarity: dict[int, int]) -> Block:
    """Takes each window's rarest shingle (the first of equals) as its prefix."""
    often = np.array([rarity.get(int(x), 0) for x in member.view(np.int64).ravel()], np.int64).reshape(member.shape)
    often[np.arange(member.shape[1]) >= count[:, None]] = np.iinfo(np.int64).max
    offset = often.argmin(axis=1) if len(often) else np.zeros(0, np.int64)
    prefix = member[np.arange(len(member)), offset] if len(member) else np.zeros(0, np.uint64)
    order = np.argsort(prefix, kind="stable")
    return Block(block.shingles, block.size[order], prefix[order], offset[order], block.whole[order], [block.text[k] for k in order], [block.items[k] for k in order])


def _counted(shingles: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros(len(keys), np.int64) for s, keys in shingles.items()}
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                w = words(data, offsets, ALNUM, lower=True)
                for s, keys in shingles.items():
                    total[s] += np.bincount(_found(keys, windows(w, s)[1])[1], minlength=len(keys))
        for s, keys in shingles.items():
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total[s])], ["shingle", "n"])

    return run


def occurrences(w: Words, block: Block, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of each occurrence of a window in the texts."""
    found = []
    row = w.rows()
    small = np.minimum(block.size, shingle)
    for s in block.shingles:
        own = np.flatnonzero(small == s)
        prefix = block.prefix[own]
        keys, begin, n = np.unique(prefix, return_index=True, return_counts=True)
        place, h = windows(w, s)
        at, key = _found(keys, h)
        first = np.repeat(place[at], n[key])
        window = own[ragged(begin[key], n[key])]
        begins, size = first - block.offset[window], block.size[window]
        ok = (begins >= 0) & (begins + size <= len(w.hashes))
        begins, size, window, first = begins[ok], size[ok], window[ok], first[ok]
        ok = (row[begins] == row[first]) & (row[begins + size - 1] == row[first])
        begins, size, window = begins[ok], size[ok], window[ok]
        whole = np.zeros(len(begins), np.uint64)
        power = powers(WINDOW)
        with np.errstate(over="ignore"):
            for k in range(int(size.max(initial=0))):
                longer = size > k
                whole[longer] += w.hashes[begins[longer] + k] * power[k]
            whole = mix(whole + size.astype(np.uint64) * _MIX)
        ok = whole == block.whole[window]
        begins, window = begins[ok], window[ok]
        ok = np.array([_joined(w, a, int(block.size[x])) == block.text[x] for a, x in zip(begins.tolist(), window.tolist(), strict=True)], bool)
        found.append((begins[ok], window[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _verdict(items: set[str], least: int) -> tuple[int, str, bool]:
    return len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= least


def _deal(items: DataFrame, block_chars: int) -> list[DataFrame]:
    """The items in blocks of at most ``block_chars`` characters, but for an item that is longer by itself.

    Items are hashed into many small buckets; the driver gets a sum for each,
    and lays buckets together while they fit.
    """
    sized = items.select("item_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    if total <= block_chars:
        return [items]
    n = 64 * -(-int(total) // block_chars)
    while True:
        bucket = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))
        sums = sized.groupBy(bucket.alias("bucket")).agg(F.sum("size"), F.count("*")).collect()
        if all(size <= block_chars or many == 1 for _, size, many in sums) or n >= 1 << 20:
            break
        n *= 4
    blocks, room = [[]], block_chars
    for k, size, _ in sorted(map(tuple, sums)):
        if size > room and blocks[-1]:
            blocks.append([])
            room = block_chars
        blocks[-1].append(k)
        room -= size
    return [items.where(bucket.isin(own)) for own in blocks]


def _items_of(block: Block, rows: np.ndarray, window: np.ndarray, n: int, least_words: int = 0) -> list[set[str]]:
    """The items of each of n texts, of windows of at least so many words."""
    items: list[set[str]] = [set() for _ in range(n)]
    fit = block.size[window] >= least_words
    for r, x in zip(rows[fit].tolist(), window[fit].tolist(), strict=True):
        items[r].update(block.items[x])
    return items


def _filtered(shared, at: int, last: bool):
    """Whole rows with what a block adds to the ids of their items; the last block's pass leaves contaminated rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(at)):
                w = words(data, offsets, ALNUM, lower=True)
                begins, window = occurrences(w, block)
                rows = w.rows()[begins]
                own = batch.slice(first, end - first)
                whole, known = own.columns[:-2], [x or [] for x in own.column(own.num_columns - 2).to_pylist()]
                full = np.asarray(own.column(own.num_columns - 1).to_pylist(), bool) | (np.bincount(rows[block.size[window] >= WINDOW], minlength=end - first) > 0)
                items = [sorted({*x, *y}) for x, y in zip(known, _items_of(block, rows, window, end - first), strict=True)]
                out = pa.RecordBatch.from_arrays([*whole, pa.array(items, pa.list_(pa.string())), pa.array(full)], own.schema.names)
                yield out.filter(pa.array([not f and len(x) < MIN_ITEMS for f, x in zip(full.tolist(), items, strict=True)])) if last else out

    return run


def _scanned(shared, least: int, keyed: bool):
    """Final rows, or with ``keyed`` the hits of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                w = words(data, offsets, ALNUM, lower=True)
                begins, window = occurrences(w, block)
                size = block.size[window]
                rows = w.rows()[begins]
                ids, n_words = batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(w.counts)
                items = _items_of(block, rows, window, end - first)
                if keyed:
                    keys = [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in batch.column(1).slice(first, end - first).to_pylist()]
                    order = np.argsort(rows, kind="stable")
                    bounds = np.searchsorted(rows[order], np.arange(end - first + 1)).tolist()
                    local, sizes = (begins - w.first[rows])[order].tolist(), size[order].tolist()
                    lists = [[x[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] for x in (local, sizes)]
                    columns = [ids, pa.array(keys, pa.string()), n_words, *(pa.array(x, pa.list_(pa.int64())) for x in lists), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _HITS.split(", ")])
                    continue
                covered = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(covered, begins, 1)
                np.add.at(covered, begins + size, -1)
                n_hit = per_text(np.cumsum(covered)[:-1] > 0, w.first)
                verdicts = list(zip(*(_verdict(x, least) for x in items), strict=True))
                columns = [ids, n_words, pa.array(n_hit), pa.array(verdicts[0], pa.int64()), pa.array(verdicts[1], pa.string()), pa.array(verdicts[2], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _merged(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                covered: set[int] = set()
                for starts, sizes in zip(x["starts"], x["sizes"], strict=True):
                    for a, n in zip(starts, sizes, strict=True):
                        covered.update(range(a, a + n))
                verdict = _verdict({i for block in x["items"] for i in block}, least)
                rows += [(x["doc_id"], x["n_words"], len(covered), *verdict)] * x["copies"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (*[pa.int64()] * 4, pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _blocks(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> list:
    """The benchmark as broadcast blocks, whose windows' prefixes are their rarest shingles in all documents."""
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull())
    found = []
    for own in _deal(items, block_chars):
        block, member, count = build([tuple(x) for x in own.collect()])
        counts = docs.select("text").mapInArrow(_counted(block.shingles), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        block = choose(block, member, count, dict(map(tuple, counts.collect())) if block.shingles else {})
        found.append(docs.sparkSession.sparkContext.broadcast(block))
    return found


def leave_out(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that hold a whole window of an item, or the windows of ``MIN_ITEMS`` items.

    A window of ``WINDOW`` words speaks for itself. An item of fewer words is a
    window too, but may be a common phrase, so that one such item alone isn't
    enough. docs: text and any other columns, which stay as they are; rows
    are judged each by itself, repeated ids and rows too. A null or empty text
    holds nothing and stays. Texts of any length are taken whole. Without items
    all rows stay; an empty table stays empty. No row leaves its task.
    """
    blocks = _blocks(docs, benchmark, block_chars)
    items, full = (next(n for k in range(len(docs.columns) + 1) if (n := f"{name}{k}") not in docs.columns) for name in ("items", "full"))
    found = docs.withColumn(items, F.expr("cast(array() as array<string>)")).withColumn(full, F.lit(False))
    at, schema = docs.columns.index("text"), found.schema
    for k, shared in enumerate(blocks, 1):
        found = found.mapInArrow(_filtered(shared, at, k == len(blocks)), schema)
    return found.drop(items, full)


def scan(docs: DataFrame, benchmark: DataFrame, least_items: int = MIN_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Words, hit words and items of each document.

    docs: doc_id, text; benchmark: item_id, text; other columns are left out.
    Null and empty texts have no words, and an item without words no window;
    items with a null id are left out. Repeated rows of documents are judged
    each by itself; repeated item ids are one item. Texts of any length are
    taken whole. Without items nothing is hit; without documents there are no
    rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = _blocks(docs, benchmark, block_chars)
    n_blocks = len(blocks)
    scans = [texts.mapInArrow(_scanned(shared, least_items, n_blocks > 1), SCHEMA if n_blocks == 1 else _HITS) for shared in blocks]
    if n_blocks == 1:
        return scans[0]
    # rows that are equal in id and text have equal results, so they may be merged and given out again
    hits = scans[0].withColumn("block", F.lit(0))
    for k, more in enumerate(scans[1:], 1):
        hits = hits.unionByName(more.withColumn("block", F.lit(k)))
    merged = hits.groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"), F.collect_list("starts").alias("starts"), F.collect_list("sizes").alias("sizes"), F.collect_list("items").alias("items"), F.count(F.when(F.col("block") == 0, 1)).alias("copies")
    )
    return merged.mapInArrow(_merged(least_items), SCHEMA)
