"""Token ids in wavelet matrix files, a file for each shard.

A wavelet matrix keeps one bit-plane for each bit of an id. The ids of a plane
are stably parted by their bit before the next plane is made. With the number
of ones before each block of 512 bits, a plane answers rank by one block and
select by a binary search, and so the file gives the id at a place, the count of
an id before a place, and the places of an id, without the ids themselves.

File: magic, a header (number of ids, planes, documents, frames), the length of each
frame, then zstandard frames: document ids, whether an id is null, ids by document,
zeros of each plane, and for each plane its block ranks and its bits in chunks of
``CHUNK`` bytes. A lookup opens one chunk and the ranks of each plane, no more.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import Workspace
from quillspark.llm.textbytes import slices
from quillspark.llm.tokens import default_path, encoder

MAGIC = b"WVM2"
BLOCK = 512
#: Bytes of a plane in one frame, a multiple of a block's.
CHUNK = 1 << 15
SHARD_TOKENS = 4_000_000
END_ID = 1
MANIFEST = "part long, shard long, n_docs long, n_tokens long"
READ = "part long, shard long, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


class Frames:
    """An array in compressed frames, each of which is opened when something of it is read."""

    def __init__(self, frames: list[memoryview], kind, chunk: int):
        self.frames, self.kind, self.chunk, self.opened = frames, kind, chunk, {}

    def _frame(self, k: int) -> np.ndarray:
        if k not in self.opened:
            self.opened[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[k]), self.kind)
        return self.opened[k]

    def __getitem__(self, at):
        if not isinstance(at, slice):
            return self._frame(int(at) // self.chunk)[int(at) % self.chunk]
        first, end = at.start // self.chunk, min(-(-at.stop // self.chunk), len(self.frames))
        parts = [self._frame(k) for k in range(first, end)]
        return np.concatenate(parts)[at.start - first * self.chunk : at.stop - first * self.chunk] if parts else np.zeros(0, self.kind)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        parts = [self._frame(k) for k in range(len(self.frames))]
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)


class WaveletMatrix:
    """Planes from the highest bit down; ``ranks`` has the ones before each block."""

    def __init__(self, n: int, planes: list[np.ndarray | Frames], zeros: list[int], ranks: list[np.ndarray | Frames]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits_needed = max(1, int(ids.max(initial=0)).bit_length())
        now, planes, zeros, ranks = ids.astype(np.uint32), [], [], []
        for bit in range(bits_needed - 1, -1, -1):
            ones = (now >> np.uint32(bit) & np.uint32(1)).astype(bool)
            low = now[~ones]
            now = np.concatenate([low, now[ones]])
            packed = np.packbits(ones, bitorder="little")
            planes.append(packed)
            zeros.append(len(low))
            padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            in_block = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(in_block, dtype=np.uint32)]).astype("<u4"))
        return cls(len(ids), planes, zeros, ranks)

    def _ones(self, plane: int, at: int) -> int:
        """Ones before a place."""
        block = at // BLOCK
        bits = np.unpackbits(self.planes[plane][block * BLOCK // 8 : -(-at // 8)], bitorder="little")
        return int(self.ranks[plane][block]) + int(bits[: at - block * BLOCK].sum())

    def _bit(self, plane: int, at: int) -> int:
        return int(self.planes[plane][at // 8]) >> at % 8 & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, at), self._ones(k, at)
            value = value << 1 | bit
            at = self.zeros[k] + ones if bit else at - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's copies among the first ``end`` ids stand in the last order."""
        if token >> len(self.planes):
            return 0, 0
        a, b = 0, end
        for k in range(len(self.planes)):
            x, y = self._ones(k, a), self._ones(k, b)
            bit = token >> len(self.planes) - 1 - k & 1
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if bit else (a - x, b - y)
        return a, b

    def rank(self, token: int, end: int) -> int:
        """How often a token is among the first ``end`` ids."""
        a, b = self._range(token, min(max(end, 0), self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of a kind in a plane."""
        ranks = np.asarray(self.ranks[plane]).astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) copy of a token."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for plane in range(len(self.planes) - 1, -1, -1):
            bit = token >> len(self.planes) - 1 - plane & 1
            at = self._select_bit(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids, by undoing the partings from the last plane up."""
        now = np.zeros(self.n, np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(np.asarray(self.planes[k]), count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(now)
            before[~ones], before[ones] = now[: self.zeros[k]], now[self.zeros[k] :] | np.uint32(1 << len(self.planes) - 1 - k)
            now = before
        return now


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """One file: the wavelet matrix of all ids, and its documents."""
    wm = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    null = np.array([d is None for d in doc_ids], np.uint8)
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), null, np.asarray(counts, "<i8"), np.array(wm.zeros, "<i8")]
    for ranks, plane in zip(wm.ranks, wm.planes, strict=True):
        parts += [ranks, *(plane[at : at + CHUNK] for at in range(0, len(plane), CHUNK))]
    frames = [pack(x.tobytes()) for x in parts]
    return MAGIC + struct.pack("<QQQQ", wm.n, len(wm.planes), len(doc_ids), len(frames)) + struct.pack(f"<{len(frames)}Q", *map(len, frames)) + b"".join(frames)


def from_bytes(raw: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(matrix, document ids, ids by document) of a file; planes are opened where they are read."""
    if raw[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    n, n_planes, _, n_frames = struct.unpack_from("<QQQQ", raw, 4)
    sizes = struct.unpack_from(f"<{n_frames}Q", raw, 36)
    ends = np.cumsum([36 + 8 * n_frames, *sizes]).tolist()
    frames = [memoryview(raw)[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    docs, null, counts, zeros = (Frames([f], kind, 1) for f, kind in zip(frames[:4], ("<i8", np.uint8, "<i8", "<i8"), strict=True))
    of_plane = -(-(-(-n // 8)) // CHUNK)
    planes, ranks = [], []
    for k in range(n_planes):
        at = 4 + k * (of_plane + 1)
        ranks.append(Frames(frames[at : at + 1], "<u4", n // BLOCK + 2))
        planes.append(Frames(frames[at + 1 : at + 1 + of_plane], np.uint8, CHUNK))
    ids = [None if x else d for d, x in zip(np.asarray(docs).tolist(), np.asarray(null).tolist(), strict=True)]
    return WaveletMatrix(n, planes, np.asarray(zeros).tolist(), ranks), ids, np.asarray(counts)


def _put(root: str, name: str, raw: bytes) -> None:
    """Write under another name, then move: a task that runs twice leaves one whole file.

    A file that is there already came from an earlier attempt at the same rows, so
    it stays; some stores refuse to move onto it.
    """
    fs, folder = pafs.FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)
    there = lambda: fs.get_file_info(f"{folder}/{name}").type == pafs.FileType.File
    if there():
        return
    other = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(other) as out:
        out.write(raw)
    try:
        fs.move(other, f"{folder}/{name}")
    except OSError:
        if not there():
            raise
        fs.delete_file(other)


def _written(path: str, root: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        held_ids: list[np.ndarray] = []
        held_docs: list[int | None] = []
        held_counts: list[np.ndarray] = []
        total, rows = 0, []

        def close() -> None:
            nonlocal total, shard, held_ids, held_docs, held_counts
            counts = np.concatenate(held_counts)
            _put(root, f"part-{part:06d}-{shard:06d}.wvm", to_bytes(np.concatenate(held_ids), held_docs, counts))
            rows.append((part, shard, len(held_docs), total))
            total, shard, held_ids, held_docs, held_counts = 0, shard + 1, [], [], []

        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                ids, at = tokens.encode(data, offsets)
                held_ids.append(np.insert(ids, at[1:], np.uint32(end_id)).astype(np.uint32, copy=False))
                held_counts.append(np.diff(at) + 1)
                held_docs += batch.column(0).slice(first, end - first).to_pylist()
                total += len(held_ids[-1])
                if total >= shard_tokens:
                    close()
        if held_docs:
            close()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in MANIFEST.split(", ")])

    return run


def write(docs: DataFrame, root: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write all documents in ascending doc_id order; gives a row for each shard (run it once: it writes).

    root: a URI of a folder that all executors share, of a kind that pyarrow
    opens. docs: doc_id, text; other columns are left out. A null or empty text
    is the end id alone; a null doc_id comes first. Rows that share a doc_id
    stand in the order of their text. A shard is closed at the first slice of
    text that fills it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(_written(tokenizer or default_path(), root, end_id, shard_tokens), MANIFEST)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _, part, shard = path.rsplit("/", 1)[1].split(".")[0].split("-")
            wm, docs, counts = from_bytes(raw.as_buffer().to_pybytes())
            ids = wm.ids().astype("<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            columns = [np.full(len(docs), int(part)), np.full(len(docs), int(shard)), np.arange(len(docs)), docs, ends - counts, counts, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in READ.split(", ")])


def read(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    Ids before a shard: those of earlier partitions (a sum for each partition,
    on the driver) and of the partition's earlier shards.
    """
    before, sums = 0, []
    for part, n in sorted(map(tuple, manifest.groupBy("part").agg(F.sum("n_tokens")).collect())):
        sums.append((part, before))
        before += n
    parts = spark.createDataFrame(sums, "part long, before long")
    earlier = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = manifest.join(parts, "part").select("part", "shard", (F.col("before") + earlier).alias("shard_start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(root) if sums else None
    if files is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = files.select("path", "content").mapInArrow(_opened, READ)
    return rows.join(at, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents into files of the shared folder and read the files back."""
    space = Workspace(docs.sparkSession, "wavelet")
    root = space.path("shards")
    manifest = space.save(write(docs, root, tokenizer), "manifest")
    return read(docs.sparkSession, root, manifest)
