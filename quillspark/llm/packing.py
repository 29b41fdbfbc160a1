"""Harmonic packing of token ids into fixed-length sequences.

A piece of L ids belongs to class k = capacity // L, and a bin of class k takes
k pieces, whatever their exact lengths, so no bin ever has to be searched. Each
worker fills the bins of each class by itself, in one pass and without a
shuffle. A piece that would leave more than ``max_waste`` of such a bin empty
is cut: its head gets the reciprocal length capacity // (k + 1), which fills
its bins but for a few ids, and the tail is classed again. The pieces of bins
that are still open at a worker's end (less than one bin for each class) are
laid end to end into full sequences and at last into sequences of the powers
of two that make up the rest, so that they need no padding.

A worker holds at most one open bin for each of about 2 * sqrt(capacity)
classes, besides the text slice it is at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillspark.llm.textbytes import slices
from quillspark.llm.tokens import default_path, encoder

CAPACITY = 4096
MAX_WASTE = 0.02
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
_ARROW = pa.schema([(name.split()[0], pa.int64()) for name in SCHEMA.split(", ")])


def cuts(n: int, capacity: int = CAPACITY, max_waste: float = MAX_WASTE) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order; they sum to n."""
    found = [capacity] * (n // capacity)
    left = n % capacity
    while left:
        k = capacity // left
        if capacity - k * left > max_waste * capacity:
            found.append(capacity // (k + 1))
        else:
            found.append(left)
        left -= found[-1]
    return found


class Packer:
    """Bins of one worker."""

    def __init__(self, worker: int, capacity: int = CAPACITY, max_waste: float = MAX_WASTE):
        self.capacity, self.max_waste = capacity, max_waste
        self.next_sequence = worker << 40
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Cut a document and put its pieces into bins."""
        start, n = 0, len(ids)
        for length in cuts(n, self.capacity, self.max_waste):
            k = self.capacity // length
            held = self.open.setdefault(k, [])
            held.append((doc_id, start, ids[start : start + length], n))
            if len(held) == k:
                self._close(self.open.pop(k), self.capacity)
            start += length

    def _close(self, pieces: list[tuple], padded: int) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), n, self.next_sequence, offset, padded))
            offset += len(ids)
        self.next_sequence += 1

    def keep(self) -> None:
        """Copy what open bins hold, so that they don't hold whole slices."""
        for held in self.open.values():
            held[:] = [(d, s, ids if ids.base is None else ids.copy(), n) for d, s, ids, n in held]

    def finish(self) -> None:
        """Lay the pieces of open bins end to end."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]][::-1]
        total = sum(len(p[2]) for p in pieces)
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length(), -1, -1) if total % self.capacity >> b & 1]
        for size in sizes:
            own, room = [], size
            while room:
                doc_id, start, ids, n = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc_id, start + room, ids[room:], n))
                    ids = ids[:room]
                own.append((doc_id, start, ids, n))
                room -= len(ids)
            self._close(own, size)
        self.open = {}

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(_ARROW))], schema=_ARROW)


def _packed(path: str, end_id: int, capacity: int, max_waste: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = encoder(path), Packer(TaskContext.get().partitionId(), capacity, max_waste)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                ids, at = tokens.encode(data, offsets)
                ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4", copy=False)
                at = at + np.arange(len(at))
                for k, doc_id in enumerate(batch.column(0).slice(first, end - first).to_pylist()):
                    packer.add(doc_id, ids[at[k] : at[k + 1]])
                packer.keep()
                if packer.rows:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, max_waste: float = MAX_WASTE) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    docs: doc_id, text; other columns are left out. Each row is packed by
    itself, repeated rows and repeated ids too. A null or empty text is the end
    id alone; a null doc_id stays null. A text of any length is taken whole. An
    empty table gives no rows. ``padded_length`` is the length of the piece's
    sequence with its padding. Sequences of different input partitions have
    different ids; a partition that is computed again gives the same rows.
    """
    path = tokenizer or default_path()
    return docs.select("doc_id", "text").mapInArrow(_packed(path, end_id, capacity, max_waste), SCHEMA)
