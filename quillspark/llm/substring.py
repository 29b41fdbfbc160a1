"""Substring deduplication by sliding sentence spans.

A text is cut into sentences at places that its own marks define: after any of
. ! ? , ; : with the signs behind it and white space, and at line ends. Cutting at
the marks inside of long sentences too lets a passage that begins or ends within
a sentence be found. Every run of ``SPAN`` consecutive sentences is hashed by its
words; a text with fewer sentences is one run. Runs are joined globally: of equal
runs the one with the least document and place is the first, and every sentence
that any other covers is removed. ``SPAN`` is the only guard of short phrases.

Counting runs is a sum before the shuffle. Only runs that occur twice meet the
runs again, as a written table, so that the join can be split where a run is very
common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import Workspace
from quillspark.llm.textbytes import NOT_SPACE, U, Words, mix, powers, ragged, slices, words

SPAN = 5
SCHEMA = "doc_id long, n_sentences long, n_removed long, n_words long, n_words_removed long, text string"
_END = re.compile(rb"[.!?,;:][\"')\]}*#$%&|<>!?.,;:]*\s+|\n+")
_ODD, _MIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def sentences(w: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, text) of each sentence that has a word."""
    ends = np.fromiter((m.end() for m in _END.finditer(data.tobytes())), np.int64)
    first = np.unique(np.searchsorted(w.starts, np.concatenate([offsets[:-1], ends])))
    first = first[first < len(w.hashes)]
    if not len(first):
        return first, np.zeros(0, np.uint64), first
    size = np.diff(np.append(first, len(w.hashes)))
    place = np.arange(len(w.hashes)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        h = mix(np.add.reduceat(w.hashes * powers(int(size.max()))[place], first) + size.astype(np.uint64) * _MIX)
    return first, h, w.rows()[first]


def spans(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, number of sentences, hash) of each run."""
    n = len(h)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, n))
    of_row = np.minimum(count, size)
    starts = ragged(begin, count - of_row + 1)
    length = np.repeat(of_row, count - of_row + 1)
    total = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            more = length > k
            total[more] += h[starts[more] + k] * powers(size)[k]
        return starts, length, mix(total + length.astype(np.uint64) * _MIX)


def _runs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in slices(batch.column(1)):
                w = words(data, offsets, NOT_SPACE)
                _, h, row = sentences(w, data, offsets)
                starts, _, key = spans(h, row, size)
                place = starts - np.searchsorted(row, row[starts])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[first + row[starts]].astype(np.int64)), pa.array(place.astype(np.int32))], ["run", "doc_id", "place"])

    return run


def _cleaned(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again = batch.column(2)
            of_row, found = pc.list_parent_indices(again).to_numpy(), pc.list_flatten(again)
            places, runs = found.field("place").to_numpy(zero_copy_only=False), found.field("run").to_numpy(zero_copy_only=False)
            for first, end, data, offsets in slices(batch.column(1)):
                w = words(data, offsets, NOT_SPACE)
                head, h, row = sentences(w, data, offsets)
                starts, length, key = spans(h, row, size)
                n_words = np.diff(np.append(head, len(w.hashes)))
                bounds, span_bounds = np.searchsorted(row, np.arange(end - first + 1)), np.searchsorted(row[starts], np.arange(end - first + 1))
                own = np.flatnonzero((of_row >= first) & (of_row < end))
                at, upto = span_bounds[of_row[own] - first] + places[own], span_bounds[of_row[own] - first + 1]
                own, at = own[at < upto], at[at < upto]
                # a row that shares its id with another text only takes what fits its own
                at = at[key[at].view(np.int64) == runs[own]]
                covered = np.zeros(len(head) + 1, np.int64)
                np.add.at(covered, starts[at], 1)
                np.add.at(covered, starts[at] + length[at], -1)
                gone = np.cumsum(covered)[:-1] > 0
                texts = []
                for k in range(end - first):
                    a, b = bounds[k], bounds[k + 1]
                    lost = np.flatnonzero(gone[a:b]) + a
                    if not len(lost):
                        texts.append(data[offsets[k] : offsets[k + 1]].tobytes())
                        continue
                    cuts = np.append(w.starts[head[a:b]], offsets[k + 1])
                    cuts[0] = offsets[k]
                    keep = [data[cuts[i - a] : cuts[i - a + 1]].tobytes() for i in range(a, b) if not gone[i]]
                    texts.append(b"".join(keep).rstrip())
                raw = pa.array(texts, pa.binary()).cast(pa.string())
                text = pc.if_else(batch.column(1).slice(first, end - first).is_valid(), raw, pa.scalar(None, pa.string()))
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, n_words, n_words * gone)]
                counts = [bounds[1:] - bounds[:-1], *(x[bounds[1:]] - x[bounds[:-1]] for x in sums)]
                columns = [batch.column(0).slice(first, end - first), *(pa.array(c.astype(np.int64)) for c in counts), text]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Each document without its repeated sentences, and what was removed.

    docs: doc_id, text; other columns are left out. A null text stays null and
    an empty one empty. Rows that repeat an id and text are one document: none
    counts as a repetition of the other. A row with a null id keeps its text.
    A text of which all is repeated becomes empty. Texts of any length are taken
    whole; an empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "substring")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = texts.where(F.col("doc_id").isNotNull()).mapInArrow(_runs(span), "run long, doc_id long, place int")
    runs = space.save(runs, "runs")
    repeated = runs.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("at")).where("n > 1")
    repeated = space.save(repeated.select("run", F.col("at.doc_id").alias("first_id"), F.col("at.place").alias("first_place")), "repeated")
    again = runs.join(repeated, "run").where((F.col("doc_id") != F.col("first_id")) | (F.col("place") != F.col("first_place")))
    again = space.save(again.groupBy("doc_id").agg(F.collect_set(F.struct("place", "run")).alias("again")), "again")
    space.drop("runs", "repeated")
    return texts.join(again, "doc_id", "left").mapInArrow(_cleaned(span), SCHEMA)
