"""Quality rules by distribution divergence.

For each language, a pass over all documents counts how many of them have which
share of each character class, whose medians make the reference (so that junk
doesn't shift it), and finds the words that may be common; a second pass counts
those exactly. A document is
compared with the reference of its language by the Jensen-Shannon distance of
two histograms: character classes, and the common words with all other words as
one class. The divergence that a sample of that length has by chance, about
(classes - 1) / (8 n ln 2) bits, is taken off before the root, and each
histogram is only judged from a least length on; so short documents are not
rejected for being short.

Common words: a word that makes up a share s of a language's words makes up at
least s / 2 of some blocks of words which together hold s / 2 of them. So
each task keeps only the words that are that frequent in one of its blocks, and
no word with a share of ``WORD_SHARE`` or more is missed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import Workspace
from quillspark.llm.textbytes import ALNUM, NOT_SPACE, Words, byte_set, slices, windows, words

MIN_WORDS = 50
#: A word's least share of a language's words, and how many of the commonest words make the reference.
WORD_SHARE = 0.002
COMMON_WORDS = 32
BLOCK_WORDS = 1 << 17
#: Steps of a document's share of a character class.
SHARE_BINS = 1000
#: Largest Jensen-Shannon distances, and the least code points or words for which they are judged.
MAX_CHAR_DISTANCE = 0.18
MAX_WORD_DISTANCE = 0.35
#: A language with fewer long documents has no reference; its documents are held against those of the others.
MIN_REFERENCE_DOCS = 20
MIN_CHARS_JUDGED = 200
MIN_WORDS_JUDGED = 50

_CONTINUES = byte_set((0x80, 0xBF))
_SYMBOL = byte_set(*((ord(c), ord(c)) for c in "#*$%&|<>"))
_NOT_LINE_END = ~byte_set((0x0A, 0x0A))
#: lower case, upper case, digit, blank, line end, sentence sign, symbol, other sign, control, letter of two bytes, of more
N_CLASSES = 11
_CHAR_CLASS = np.full(256, 8, np.uint8)
_CHAR_CLASS[0x21:0x7F] = 7
_CHAR_CLASS[0x61:0x7B], _CHAR_CLASS[0x41:0x5B], _CHAR_CLASS[0x30:0x3A] = 0, 1, 2
_CHAR_CLASS[[0x20, 0x09]], _CHAR_CLASS[[0x0A, 0x0D]] = 3, 4
_CHAR_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CHAR_CLASS[_SYMBOL] = 6
_CHAR_CLASS[0xC0:0xE0], _CHAR_CLASS[0xE0:] = 9, 10

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double"
)
_COUNTS = "lang string, kind int, key long, n long"
_TOTAL, _CHARS, _WORD = 0, 1, 2


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of true flags in each text."""
    before = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return before[offsets[1:]] - before[offsets[:-1]]


def char_histogram(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of character classes, a row for each text."""
    rows = len(offsets) - 1
    lead = ~_CONTINUES[data]
    row = np.repeat(np.arange(rows, dtype=np.int64) * N_CLASSES, np.diff(offsets))
    return np.bincount(row[lead] + _CHAR_CLASS[data[lead]], minlength=rows * N_CLASSES).reshape(rows, N_CLASSES)


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines: Words = words(data, offsets, _NOT_LINE_END)
    has_word = np.diff(np.concatenate([[0], np.cumsum(NOT_SPACE[data], dtype=np.int64)])[np.stack([lines.starts, lines.ends])], axis=0)[0] > 0
    row, h = lines.rows()[has_word], lines.hashes[has_word]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    again = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    return np.bincount(row[1:][again], minlength=len(offsets) - 1)


def repeated_words(w: Words, size: int = 3) -> np.ndarray:
    """Words in windows of ``size`` words that their text holds twice or more."""
    first, h = windows(w, size)
    row = w.rows()[first]
    order = np.lexsort((h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(first), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(w.hashes) + size, np.int64)
    np.add.at(covered, first[twice], 1)
    np.add.at(covered, first[twice] + size, -1)
    return per_text(np.cumsum(covered)[: len(w.hashes)] > 0, w.first)


def _counted(wanted: dict[str, np.ndarray] | None):
    """wanted: for each language the sorted hashes to count; without it, candidates and character classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        held: dict[str, list[np.ndarray]] = defaultdict(list)

        def block(lang: str) -> None:
            keys, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            often = n >= WORD_SHARE / 2 * n.sum()
            for key, count in zip(keys[often].view(np.int64).tolist(), n[often].tolist(), strict=True):
                total[lang, _WORD, key] += count

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, end, data, offsets in slices(batch.column(0)):
                w = words(data, offsets, ALNUM, lower=True)
                own = langs[first:end]
                rows = w.rows()
                chars = char_histogram(data, offsets) if wanted is None else None
                for lang in {x for x in own if x is not None}:
                    mine = np.array([x == lang for x in own])
                    h = w.hashes[mine[rows]]
                    if wanted is not None:
                        keys = wanted.get(lang, np.zeros(0, np.uint64))
                        if len(keys) and len(h):
                            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                            n = np.bincount(at[keys[at] == h], minlength=len(keys))
                            for key, count in zip(keys.view(np.int64).tolist(), n.tolist(), strict=True):
                                total[lang, _WORD, key] += count
                        continue
                    total[lang, _TOTAL, 0] += len(h)
                    long = chars[mine & (chars.sum(axis=1) >= MIN_CHARS_JUDGED)]
                    bins = np.rint(long / long.sum(axis=1, keepdims=True) * SHARE_BINS).astype(np.int64) + np.arange(N_CLASSES) * (SHARE_BINS + 1)
                    for key, n in zip(*map(np.ndarray.tolist, np.unique(bins, return_counts=True)), strict=True):
                        total[lang, _CHARS, key] += n
                    held[lang].append(h)
                    if sum(map(len, held[lang])) >= BLOCK_WORDS:
                        block(lang)
        for lang in list(held):
            block(lang)
        rows_out = [(*key, n) for key, n in total.items()]
        columns = list(zip(*rows_out, strict=True)) if rows_out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["lang", "kind", "key", "n"])

    return run


class References:
    """Histograms of the languages: shares of character classes; common words (sorted hashes) and their shares."""

    def __init__(self, chars: dict[str, np.ndarray], common: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.chars, self.common = chars, common


def learn(docs: DataFrame) -> References:
    """References of all languages, counted over all documents with a language.

    The driver gets sums only: for a language, its classes and at most
    2 / WORD_SHARE words.
    """
    texts = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    space = Workspace(docs.sparkSession, "quality")
    sums = space.save(texts.mapInArrow(_counted(None), _COUNTS).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "sums")
    # a row for each language, of which there are few
    totals = dict(sums.where(F.col("kind") == _TOTAL).select("lang", "n").collect())
    least = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, WORD_SHARE / 2 * n)]) if totals else F.create_map().cast("map<string,double>")
    sums = sums.where((F.col("kind") != _WORD) | (F.col("n") >= F.try_element_at(least, F.col("lang"))))
    spread: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(N_CLASSES * (SHARE_BINS + 1)))
    maybe: dict[str, list[int]] = defaultdict(list)
    n_words: dict[str, int] = {}
    for lang, kind, key, n in sums.collect():
        if kind == _TOTAL:
            n_words[lang] = n
        elif kind == _CHARS:
            spread[lang][key] = n
        else:
            maybe[lang].append(key)
    wanted = {lang: np.sort(np.array(keys, np.int64).view(np.uint64)) for lang, keys in maybe.items()}
    exact: dict[str, list[tuple[int, int]]] = defaultdict(list)
    if wanted:
        for lang, key, n in texts.mapInArrow(_counted(wanted), _COUNTS).groupBy("lang", "key").agg(F.sum("n").alias("n")).collect():
            if n >= WORD_SHARE * n_words[lang]:
                exact[lang].append((n, key))
    common = {}
    for lang, found in exact.items():
        top = sorted(sorted(found, key=lambda x: (-x[0], x[1]))[:COMMON_WORDS], key=lambda x: np.int64(x[1]).view(np.uint64))
        common[lang] = (np.array([k for _, k in top], np.int64).view(np.uint64), np.array([n for n, _ in top]) / n_words[lang])
    space.drop("sums")
    medians = {lang: m for lang, n in spread.items() if (m := _medians(n.reshape(N_CLASSES, -1))) is not None}
    return References(medians, {lang: x for lang, x in common.items() if lang in medians})


def _medians(spread: np.ndarray) -> np.ndarray | None:
    """The median share of each class, from counts of documents by share; they are made to sum to 1. None of too few documents."""
    below = np.cumsum(spread, axis=1)
    found = (below < below[:, -1:] / 2).sum(axis=1) / SHARE_BINS
    return found / found.sum() if below[0, -1] >= MIN_REFERENCE_DOCS and found.sum() > 0 else None


def excess_distance(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of shares p to q, without what a sample of n has by chance."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)).sum(axis=1) / 2
    return np.sqrt(np.maximum(0, bits - (p.shape[1] - 1) / (8 * np.log(2) * np.maximum(n, 1))))


def _distances(references: References, lang: str, chars: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_chars, n_words = chars.sum(axis=1), np.diff(first)
    char_d = excess_distance(chars / np.maximum(n_chars, 1)[:, None], references.chars[lang], n_chars)
    word_d = np.zeros(len(n_words))
    if lang in references.common:
        keys, share = references.common[lang]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        at[keys[at] != h] = len(keys)
        row = np.repeat(np.arange(len(n_words)), n_words)
        hist = np.bincount(row * (len(keys) + 1) + at, minlength=len(n_words) * (len(keys) + 1)).reshape(len(n_words), -1)
        word_d = excess_distance(hist / np.maximum(n_words, 1)[:, None], np.append(share, max(0.0, 1 - share.sum())), n_words)
    return np.where(n_chars >= MIN_CHARS_JUDGED, char_d, 0), np.where(n_words >= MIN_WORDS_JUDGED, word_d, 0)


def _scored(references: References):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for first, end, data, offsets in slices(batch.column(1)):
                w = words(data, offsets, NOT_SPACE)
                lowered = words(data, offsets, ALNUM, lower=True)
                chars = char_histogram(data, offsets)
                n, repeat = w.counts, repeated_words(w)
                failed = (n < MIN_WORDS) | (100 * repeat > 50 * n)
                own = [x if x in references.chars else None for x in langs[first:end]]
                char_d, word_d = np.zeros(end - first), np.zeros(end - first)
                for lang in references.chars:
                    # a document without a known language is compared with all of them, and the nearest counts
                    mine = np.flatnonzero([x == lang or x is None for x in own])
                    if not len(mine):
                        continue
                    keep = np.zeros(end - first, bool)
                    keep[mine] = True
                    h = lowered.hashes[keep[lowered.rows()]]
                    c, d = _distances(references, lang, chars[mine], h, np.concatenate([[0], np.cumsum(lowered.counts[mine])]))
                    unset = np.array([own[k] is not None or lang == next(iter(references.chars)) for k in mine], bool)
                    nearer = unset | (np.maximum(c / MAX_CHAR_DISTANCE, d / MAX_WORD_DISTANCE) < np.maximum(char_d[mine] / MAX_CHAR_DISTANCE, word_d[mine] / MAX_WORD_DISTANCE))
                    char_d[mine[nearer]], word_d[mine[nearer]] = c[nearer], d[nearer]
                kept = ~failed & (char_d <= MAX_CHAR_DISTANCE) & (word_d <= MAX_WORD_DISTANCE)
                columns = (n, per_text(NOT_SPACE[data] & ~_CONTINUES[data], offsets), per_text(_SYMBOL[data], offsets), repeated_lines(data, offsets), repeat, failed, kept, char_d, word_d)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), *map(pa.array, columns)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def judge(docs: DataFrame, references: References | None = None) -> DataFrame:
    """Counts, distances and verdict of each document.

    docs: doc_id, text, lang; other columns are left out. A null or empty text
    has no words, so it fails the base rule. A document whose language is null,
    or has fewer than ``MIN_REFERENCE_DOCS`` long documents, is held against the
    nearest of all references; without any reference only the base rule counts. Each row is judged by itself, repeated
    rows and ids too; texts of any length are taken whole; an empty table gives
    no rows.
    """
    references = references or learn(docs)
    return docs.select("doc_id", "text", "lang").mapInArrow(_scored(references), SCHEMA)
