"""MinHash near-duplicate groups with odd sketches.

1. Each document's set of word shingles gives MinHash samples, band keys, and an
   odd sketch: a bitmap whose bit is the parity of the samples folded onto it.
   The number of ones in the XOR of two sketches tells how many samples differ,
   precisely for high similarities. Documents with equal sets become one node.
2. Documents that share a band key form a bucket. Each bucket's documents are
   first held against one of them (a star); sketches pick each document's best
   partner, which is confirmed on the full sets.
3. Buckets whose documents are still in several components are dealt into tiles
   of bounded size. Each tile gives the forest of its most similar pairs that
   joins its components (fewer pairs than documents), which are confirmed on the
   full sets.
4. In buckets that are still open after that, all documents outside of the
   commonest component are compared with all of the bucket, again in tiles, now
   with finer sketches (more samples, made only for documents in buckets), and
   every pair that may be a link is confirmed on the full sets. A bucket that would
   be copied into too many tiles is first split by longer bands of those samples,
   so that documents which only share a passage rarely meet.
5. Components of the confirmed links.

No pairs within a bucket are written out, only partners that pass the sketch
and aren't in one component yet. With 32 bands of 4 samples a pair with
similarity 0.75 misses all bands with probability 5e-6, and its sketch fails
the floor with a similar one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import Workspace
from quillspark.llm.textbytes import NOT_SPACE, U, Words, mix, powers, slices, windows, words

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: Sketches that estimate less than this aren't confirmed: 4.7 standard deviations below 0.75.
SKETCH_FLOOR = 0.52
#: The finer sketches: samples, bits, and the floor, 4.5 standard deviations below 0.75.
FINE_SAMPLES, FINE_BITS, FINE_FLOOR = 1024, 4096, 0.685
TILE = 512
#: Bands of the finer samples, 8 each: a pair at 0.75 misses all of them with probability 1e-6.
FINE_BANDS = FINE_SAMPLES // 8
#: A bucket of which each document would be copied into more tiles is split by those bands.
MOST_COPIES = FINE_BANDS
#: Bits for each row in the map of rows that may go, and the most bits of such a map (8 MB).
MAP_BITS, MOST_BITS = 16, 1 << 26
_ODD, _MIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SKETCHED = "doc_id long, text_key long, n_shingles long, set1 long, set2 long, sketch array<long>, bands array<long>"


def most_differing_bits(floor: float = SKETCH_FLOOR, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """Ones in the XOR of two sketches at which the estimated similarity is the floor."""
    return int(bits / 2 * (1 - np.exp(-4 * samples * (1 - floor) / bits)))


def shingle_sets(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, sorted; a shorter text is one shingle of all its words."""
    first, h = windows(w, size)
    row = w.rows()[first] if len(first) else first
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size - 1):
                more = w.counts[short] > k
                total[more] += w.hashes[w.first[short[more]] + k] * powers(size)[k]
            h = np.concatenate([h, mix(total + w.counts[short].astype(np.uint64) * _MIX)])
        row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _constants(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(samples)
    return rng.integers(1, 1 << 63, samples, dtype=np.uint64) | U(1), rng.integers(0, 1 << 63, samples, dtype=np.uint64)


def _samples(h: np.ndarray, begin: np.ndarray, samples: int) -> Iterator[np.ndarray]:
    """MinHash samples of each set, whose hashes begin at the given places."""
    for k, (factor, shift) in enumerate(zip(*_constants(samples), strict=True)):
        with np.errstate(over="ignore"):
            yield mix(np.minimum.reduceat(h * factor + shift, begin) + U(k) * _MIX)


def _as_longs(bits: np.ndarray) -> pa.ListArray:
    rows, size = bits.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * (size // 64), pa.int32()), pa.array(np.packbits(bits, axis=1).ravel().view(np.int64)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(2)):
            row, h = shingle_sets(words(data, offsets, NOT_SPACE, lower=True))
            rows = end - first
            n = np.bincount(row, minlength=rows)
            full = np.flatnonzero(n)
            begin = np.concatenate([[0], np.cumsum(n[full])[:-1]]).astype(np.int64)
            bits = np.zeros((rows, SKETCH_BITS), bool)
            bands = np.zeros((len(full), BANDS), np.uint64)
            sets = np.zeros((2, rows), np.uint64)
            if len(full):
                with np.errstate(over="ignore"):
                    sets[0, full] = np.add.reduceat(mix(h), begin)
                    sets[1, full] = np.add.reduceat(mix(h ^ _ODD), begin)
                    for k, sample in enumerate(_samples(h, begin, BANDS * ROWS)):
                        bits[full, (sample % U(SKETCH_BITS)).astype(np.int64)] ^= True
                        bands[:, k // ROWS] = (bands[:, k // ROWS] + sample) * _ODD
            bands = mix(bands)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), pa.array(bands.ravel().view(np.int64)))
            columns = [batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(n.astype(np.int64)), pa.array(sets[0].view(np.int64)), pa.array(sets[1].view(np.int64)), _as_longs(bits), keys]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SKETCHED.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1)):
            row, h = shingle_sets(words(data, offsets, NOT_SPACE, lower=True))
            bounds = np.searchsorted(row, np.arange(end - first + 1))
            full = np.flatnonzero(np.diff(bounds))
            bits = np.zeros((end - first, FINE_BITS), bool)
            if len(full):
                for sample in _samples(h, bounds[full], FINE_SAMPLES):
                    bits[full, (sample % U(FINE_BITS)).astype(np.int64)] ^= True
            raw = pa.py_buffer(np.ascontiguousarray(h, "<u8").tobytes())
            shingles = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer((bounds * 8).astype(np.int64).tobytes()), raw]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), shingles, _as_longs(bits)], ["doc", "shingles", "fine"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of the finer samples."""
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1)):
            row, h = shingle_sets(words(data, offsets, NOT_SPACE, lower=True))
            bounds = np.searchsorted(row, np.arange(end - first + 1))
            full = np.flatnonzero(np.diff(bounds))
            bands = np.zeros((len(full), FINE_BANDS), np.uint64)
            if len(full):
                with np.errstate(over="ignore"):
                    for k, sample in enumerate(_samples(h, bounds[full], FINE_SAMPLES)):
                        bands[:, k * FINE_BANDS // FINE_SAMPLES] = (bands[:, k * FINE_BANDS // FINE_SAMPLES] + sample) * _ODD
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * FINE_BANDS, pa.int32()), pa.array(mix(bands).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).take(pa.array(full)), keys], ["doc", "subs"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                common = int((b[at] == a).sum()) if len(b) else 0
                ok[k] = 100 * common >= percent * (len(a) + len(b) - common)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    left, right = sets.select(F.col("doc").alias("u"), F.col("shingles").alias("su")), sets.select(F.col("doc").alias("v"), F.col("shingles").alias("sv"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(_confirmed(percent), "u long, v long")


def _forest(bucket: int, comp: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the pairs that join a tile's components by the fewest differing bits (Prim)."""
    n = len(comp)
    nearest, by = np.full(n, most + 1), np.zeros(n, np.int64)
    out = np.ones(n, bool)
    at, a, b = 0, [], []
    for _ in range(n - 1):
        out[at] = False
        bits = np.bitwise_count(sketch ^ sketch[at]).sum(axis=1, dtype=np.int64)
        bits[comp == comp[at]] = -1
        closer = out & (bits < nearest)
        nearest[closer], by[closer] = bits[closer], at
        at = int(np.where(out, nearest, most + 2).argmin())
        if 0 <= nearest[at] <= most:
            a.append(by[at])
            b.append(at)
    return np.array(a, np.int64), np.array(b, np.int64)


def _passing(bucket: int, comp: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of all pairs of a tile in different components that pass the sketch.

    Behind its sketch each document has its band keys; a pair is given by the
    first bucket that both are in, so once.
    """
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sketch, bands = sketch[:, :-BANDS], sketch[:, -BANDS:]
    for at in range(len(comp) - 1):
        other = np.flatnonzero(comp[at + 1 :] != comp[at]) + at + 1
        hit = other[np.bitwise_count(sketch[other] ^ sketch[at]).sum(axis=1, dtype=np.int64) <= most]
        first = (bands[hit] == bands[at]).argmax(axis=1)
        hit = hit[bands[at][first] == np.uint64(bucket)]
        a.append(np.full(len(hit), at))
        b.append(hit)
    return np.concatenate(a), np.concatenate(b)


def _tiled(most: int, choose):
    """Rows sorted by tile; gives the pairs that ``choose`` finds in each tile."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            key = mix(batch.column(0).to_numpy().view(np.uint64) + _ODD * batch.column(1).to_numpy().astype(np.uint64) + _MIX * batch.column(2).to_numpy().astype(np.uint64))
        return [batch.column(0).to_numpy().view(np.uint64), batch.column(3).to_numpy(), batch.column(4).to_numpy(), key, batch.column(5).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)]

    def out(bucket: np.ndarray, doc: np.ndarray, comp: np.ndarray, tile: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        edges = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]]) if len(tile) else np.zeros(1, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = [(doc[:0], doc[:0])]
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            a, b = choose(int(bucket[x]), comp[x:y], sketch[x:y], most) if y > x else (doc[:0], doc[:0])
            found.append((doc[x:y][a], doc[x:y][b]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            before = np.flatnonzero(now[3] != now[3][-1])
            cut = int(before[-1]) + 1 if len(before) else 0
            held = [x[cut:] for x in now]
            yield out(*(x[:cut] for x in now))
        if held is not None:
            yield out(*held)

    return run


def _opened(named: DataFrame) -> DataFrame:
    """Members of the buckets (bucket, sub) that hold several components, with their number, that outside of the commonest component, and the latter."""
    key = ["bucket", "sub"]
    counts = named.groupBy(*key, "component").agg(F.count("*").alias("n"))
    main = counts.groupBy(*key).agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main")).where(F.col("main.n") < F.col("all"))
    return named.join(main.select(*key, "all", F.col("main.component").alias("main"), (F.col("all") - F.col("main.n")).alias("rest")), key)


def _tile_pairs(members: DataFrame, comps: DataFrame, sketches: DataFrame, tile: int, found_by, space: Workspace, name: str, chosen: DataFrame | None) -> DataFrame:
    """Pairs in different components, from the buckets that hold several components.

    With ``chosen`` (doc, text) every such pair of a bucket meets; without it each
    document is in one tile of its bucket.
    """
    named = members.join(comps.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    named = space.save(_opened(named.withColumn("sub", F.lit(0).cast("long"))), name)
    tiles = lambda count: F.ceil(count / F.lit(tile)).cast("long")
    if chosen is not None:
        wide = tiles(F.col("rest")) > MOST_COPIES
        split = named.where(wide).select("bucket", "doc", "component")
        if not split.isEmpty():
            subs = chosen.join(split.select("doc").distinct(), "doc", "left_semi").mapInArrow(_finer, "doc long, subs array<long>")
            split = _opened(split.join(subs, "doc").select("bucket", "doc", "component", F.explode("subs").alias("sub")))
            named = named.where(~wide).unionByName(space.save(split, f"{name}-split"))
    spread = lambda count, seed: F.pmod(F.xxhash64("doc", "bucket", "sub", F.lit(seed)), tiles(count)).cast("long")
    named = named.withColumn("i", spread(F.col("all"), 1)).withColumn("j", spread(F.col("rest"), 2))
    if chosen is not None:
        upto = lambda count: F.sequence(F.lit(0).cast("long"), tiles(count) - 1)
        as_member = named.select("bucket", "sub", "i", F.explode(upto(F.col("rest"))).alias("j"), "doc", "component")
        as_rest = named.where((F.col("component") != F.col("main")) & (F.col("all") > tile)).select("bucket", "sub", F.explode(upto(F.col("all"))).alias("i"), "j", "doc", "component")
        rows = as_member.unionByName(as_rest)
    else:
        # each document in one tile of its bucket; other buckets mix the documents anew
        rows = named.select("bucket", "sub", "i", F.lit(0).cast("long").alias("j"), "doc", "component")
    # one number for the place of a tile in its bucket
    rows = rows.withColumn("i", F.when(F.col("sub") == 0, F.col("i")).otherwise(F.xxhash64("sub", "i")))
    rows = rows.join(sketches, "doc").select("bucket", "i", "j", "doc", "component", "sketch")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc")
    return rows.mapInArrow(found_by, "u long, v long").where("u != v").distinct()


def _joined(comps: DataFrame, links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """Components (node, component) with more links: only the components that these join are worked on."""
    if links.isEmpty():
        return comps
    label = lambda end: comps.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label"))
    ends = links.join(label("u"), "u", "left").join(label("v"), "v", "left")
    between = ends.select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    merged = components(between, space, name).select(F.col("node").alias("component"), F.col("component").alias("root"))
    # a component's least node, and a node without links before, has no row of its own in comps
    moved = comps.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return space.save(moved.unionByName(merged.select(F.col("component").alias("node"), F.col("root").alias("component"))), f"{name}-comps")


def groups(docs: DataFrame, percent: int = PERCENT, tile: int = TILE, floor: float = SKETCH_FLOOR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    docs: doc_id, text; other columns are left out. A null, empty or blank text
    has an empty set and is linked with nothing; a null doc_id is linked with
    nothing and kept, with a null component. Repeated rows have the same set and
    component. If a doc_id stands for several texts, each row is linked by its own
    text; a row is kept where its id is its component's least one, so that two
    texts of one id may both be kept. Texts of any length are taken whole; an
    empty table gives no rows.
    """
    found = _grouped(docs, percent, tile, floor, Workspace(docs.sparkSession, "neardup"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group: that with the least doc_id, and of its texts that with the least hash.

    All columns stay as they are. A row without words or id is in no group and
    stays; of rows that repeat an id and a text one stays, the least by its
    columns. An empty table stays empty.
    """
    space = Workspace(docs.sparkSession, "kept")
    key = ["doc_id", "text_key"]
    found = space.save(_grouped(docs, percent, TILE, SKETCH_FLOOR, space), "found").where("n_shingles > 0 and doc_id is not null")
    marks = found.groupBy(*key).agg(F.count("*").alias("n"), F.bool_and("first").alias("first")).where("n > 1 or not first")
    marks = space.save(marks.select(F.col("doc_id").alias("_marked"), F.col("text_key").alias("_key"), "first"), "marks")
    here = (F.col("doc_id").cast("long") == F.col("_marked")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key"))
    apart, near = _told_apart(docs, marks, space, "marks")
    single = apart.unionByName(near.join(marks, here, "left_anti"))
    repeated = space.save(marks.where("first"), "repeated")
    if repeated.isEmpty():
        return single
    again = _told_apart(docs, repeated, space, "repeated")[1].join(repeated, here, "left_semi")
    again = again.groupBy(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return single.unionByName(again.select("_row.*"))


def _told_apart(docs: DataFrame, marks: DataFrame, space: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that are surely not marked (_marked, _key), and those that may be: all marked ones and few others.

    A broadcast map of the marks' hashes tells them apart where they are, so that
    only the texts of the latter move in a join with the marks. The map has a bound;
    with more marks than it has room for, more of the others move.
    """
    size = min(max(MAP_BITS * marks.count(), 1), MOST_BITS)
    place = lambda doc_id, key: F.pmod(F.xxhash64(doc_id, key), F.lit(size)) + 1
    of_mark, of_row = place("_marked", "_key"), place(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    parts = marks.groupBy(F.bitmap_bucket_number(of_mark).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(of_mark)).alias("_bits"))
    parts = F.broadcast(space.save(parts, f"{name}-map"))
    at = F.bitmap_bit_position(of_row)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    mapped = docs.join(parts, F.bitmap_bucket_number(of_row) == F.col("_part"), "left")
    return mapped.where(~hit).drop("_part", "_bits"), mapped.where(hit).drop("_part", "_bits")


def _grouped(docs: DataFrame, percent: int, tile: int, floor: float, space: Workspace) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, and first: whether a row is its component's first (each without a set is)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketched = space.save(texts.select("doc_id", "text_key", "text").mapInArrow(_sketched, SKETCHED), "sketched")
    whole = ["n_shingles", "set1", "set2"]
    sets_known = sketched.where("n_shingles > 0 and doc_id is not null")
    # a set is a node of its own, as a doc_id may stand for several texts
    nodes = sets_known.groupBy(*whole).agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    # the least id names a node, as small numbers shrink well; where several sets have the same, their hashes do
    shared = nodes.groupBy(F.col("least.doc_id").alias("id")).agg(F.count("*").alias("sets")).where("sets > 1")
    nodes = nodes.join(shared, F.col("least.doc_id") == F.col("id"), "left")
    nodes = space.save(nodes.select(*whole, "least", F.when(F.col("id").isNull(), F.col("least.doc_id")).otherwise(F.xxhash64(*whole)).alias("doc")), "nodes")
    own = sets_known.join(nodes.select(*whole, "doc", "least.doc_id", "least.text_key"), [*whole, "doc_id", "text_key"])
    own = space.save(own.dropDuplicates([*whole, "doc_id", "text_key"]).select("doc", "doc_id", "text_key", "sketch", "bands"), "own")
    banded = own.select("doc", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("doc").alias("order"), "doc")).alias("first")).where("n > 1").select("bucket", F.col("first.doc").alias("pivot"))
    members = space.save(banded.join(buckets, "bucket"), "members")
    # written, so that joins know their sizes: where few ids are wanted no other text has to move
    wanted = space.save(own.select("doc", "doc_id", "text_key").join(members.select("doc").distinct(), "doc", "left_semi"), "wanted")
    ids = space.save(wanted.select("doc_id").distinct(), "ids")
    chosen = texts.join(ids, "doc_id", "left_semi").join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc", "text")
    sets = space.save(chosen.mapInArrow(_sets, "doc long, shingles binary, fine array<long>"), "sets")
    sketches = own.select("doc", "sketch")

    star = members.where("doc != pivot").select("doc", "pivot").distinct()
    star = star.join(sketches, "doc").join(sketches.select(F.col("doc").alias("pivot"), F.col("sketch").alias("other")), "pivot")
    star = star.withColumn("bits", _differing("sketch", "other")).where(F.col("bits") <= most_differing_bits(floor))
    best = star.groupBy("doc").agg(F.min(F.struct("bits", "pivot")).alias("best")).select(F.col("doc").alias("u"), F.col("best.pivot").alias("v"))
    links = space.save(_confirm(best, sets, percent), "star")
    comps = components(links, space, "first")
    buckets_of = members.select("bucket", "doc")
    for step, found_by, own_sketches in (
        ("forest", _tiled(most_differing_bits(floor), _forest), sketches),
        ("rest", _tiled(most_differing_bits(FINE_FLOOR, FINE_SAMPLES, FINE_BITS), _passing), sets.join(own.select("doc", "bands"), "doc").select("doc", F.concat("fine", "bands").alias("sketch"))),
    ):
        pairs = space.save(_tile_pairs(buckets_of, comps, own_sketches, tile, found_by, space, f"{step}-open", chosen if step == "rest" else None), f"{step}-pairs")
        more = space.save(_confirm(pairs, sets, percent), f"{step}-links")
        comps = _joined(comps, more, space, step)
        space.drop(f"{step}-open", f"{step}-open-split", f"{step}-pairs")
    # a component's least node has no row of its own among them
    of_all = comps.select(F.col("node").alias("doc"), "component").unionByName(comps.select(F.col("component").alias("doc"), "component").distinct())
    linked = nodes.join(of_all, "doc")
    roots = space.save(linked.groupBy("component").agg(F.min("least").alias("root")), "roots")
    named = linked.join(roots, "component").select(*whole, "root")
    named = space.save(nodes.select(*whole, "least").join(named, whole, "left").select(*whole, F.coalesce("root", "least").alias("root")), "named")
    space.drop("members", "wanted", "ids", "sets", "own", "nodes", "roots")
    found = sketched.select("doc_id", "text_key", *whole).join(named, whole, "left")
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root.doc_id", "doc_id")))
    first = F.coalesce((F.col("doc_id") == F.col("root.doc_id")) & (F.col("text_key") == F.col("root.text_key")), F.lit(True))
    return found.select("doc_id", "text_key", "n_shingles", "component_id", first.alias("first"))


def _differing(a: str, b: str):
    """Ones in the XOR of two sketches."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, SKETCH_BITS // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
