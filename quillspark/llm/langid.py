"""Language identification by words first, with a fall back to character n-grams.

The model knows the words that its training documents use at least twice, with
their log frequency in each language. A word that it doesn't know is read from
each of its places by the longest n-gram it knows (4, 3, 2, then 1 characters,
word ends marked), with the n-grams' log frequencies. A document's score is the
sum over its words; the answer is the best language.

Training uses at most ``DOCS_PER_LANGUAGE`` different labelled documents of each
language, those with the least hash of their id and text, and all of their words.
So the model's size has a bound for each language, and it may travel to every
worker. Words and n-grams are kept as sorted 64-bit hashes beside a table of logs,
so that a slice of text is scored without an object for each word.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.quality import per_text
from quillspark.llm.textbytes import ALNUM, U, byte_set, mix, powers, ragged, slices, words

DOCS_PER_LANGUAGE = 600
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
#: Mean word scores count as those of at most this many words in the confidence.
CONFIDENT_WORDS = 10
MAX_CACHED = 1_000_000
UNKNOWN = "und"
_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_WIDE = byte_set((0x80, 0xFF))


def _points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of ^word$ for each word, word of each)."""
    size = ends - starts
    begin = np.cumsum(size + 2) - size - 2
    marked = np.empty(int((size + 2).sum()), np.uint8)
    marked[begin], marked[begin + size + 1] = ord("^"), ord("$")
    marked[ragged(begin + 1, size)] = data[ragged(starts, size)]
    points = np.frombuffer(marked.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, np.cumsum(points == ord("^")) - 1


def _grams(points: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places where an n-gram of ``size`` begins within its word, its hash)."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(word[:n] == word[size - 1 :])
    power, h = powers(size), np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h += points[at + k] * power[k]
        return at, mix(h + U(size) * power[1])


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the rows of each."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros((len(distinct), counts.shape[1]))
    np.add.at(total, inverse, counts)
    return distinct, total


class Model:
    """Words and n-grams with a log frequency for each language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        known = sorted({w for of_lang in counts.values() for w in of_lang})
        rows = np.array([[counts[lang].get(w, 0) for lang in self.langs] for w in known], float).reshape(len(known), len(self.langs))
        # each word is one run of a word's bytes, so that its hash is that of the word in a text
        data = np.frombuffer(" ".join(known).encode(), np.uint8)
        w = words(data, np.array([0, len(data)]), ALNUM)
        often = rows.sum(axis=1) >= 2
        order = np.argsort(w.hashes[often], kind="stable")
        self.words = w.hashes[often][order]
        self.word_logs = self._logs(rows[often], rows.sum(axis=0))[order]
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        points, word = _points(w.data, w.starts, w.ends)
        for size in ORDERS:
            at, h = _grams(points, word, size)
            keys, total = _sums(h, rows[word[at]])
            self.grams.append((keys, self._logs(total, total.sum(axis=0))))

    @staticmethod
    def _logs(rows: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.log((rows + SMOOTHING) / (total + SMOOTHING * max(1, len(rows)))).astype(np.float32)

    def logs_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Each word's log frequency in each language, or that of its n-grams at the mean."""
        out = np.zeros((len(hashes), len(self.langs)), np.float32)
        at = _lookup(self.words, hashes)
        out[at >= 0] = self.word_logs[at[at >= 0]]
        unseen = np.flatnonzero(at < 0)
        if not len(unseen):
            return out
        points, word = _points(data, starts[unseen], ends[unseen])
        total, n, done = np.zeros((len(unseen), len(self.langs))), np.zeros(len(unseen)), np.zeros(len(points), bool)
        for size, (keys, logs) in zip(ORDERS, self.grams, strict=True):
            place, h = _grams(points, word, size)
            place, h = place[~done[place]], h[~done[place]]
            found = _lookup(keys, h)
            place, found = place[found >= 0], found[found >= 0]
            done[place] = True
            np.add.at(n, word[place], 1)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(word[place], weights=logs[found, k], minlength=len(unseen))
        out[unseen] = total / np.maximum(n, 1)[:, None]
        return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        langs = batch.column(1).to_pylist()
        for first, _, data, offsets in slices(pc.utf8_lower(batch.column(0))):
            w = words(data, offsets, ALNUM)
            raw = w.data.tobytes()
            for row, a, b in zip(w.rows().tolist(), w.starts.tolist(), w.ends.tolist(), strict=True):
                counts[langs[first + row], raw[a:b].decode()] += 1
        rows = [(*key, n) for key, n in counts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])


def _chosen(labelled: DataFrame, most: int) -> dict[str, int]:
    """For each language the hash up to which its documents are learned from: that of ``most`` different ones.

    As hashes are even, a share of each language's rows holds enough of them; the
    driver gets those few hashes, and widens the share where copies left too few.
    """
    share = {lang: 4 * most / n for lang, n in map(tuple, labelled.groupBy("lang").count().collect())}
    cut: dict[str, int] = {}
    while share:
        upto = {lang: (1 << 63) - 1 if x >= 1 else int(x * (1 << 64)) - (1 << 63) for lang, x in share.items()}
        found: dict[str, list[int]] = defaultdict(list)
        for lang, h in labelled.where(_upto(upto)).select("lang", "h").distinct().collect():
            found[lang].append(h)
        for lang in list(share):
            if len(found[lang]) >= most or share[lang] >= 1:
                cut[lang] = sorted(found[lang])[:most][-1]
                del share[lang]
            else:
                share[lang] *= 4
    return cut


def _upto(cut: dict[str, int]) -> F.Column:
    of_lang = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]) if cut else None
    return F.lit(False) if of_lang is None else F.coalesce(F.col("h") <= F.try_element_at(of_lang, F.col("lang")), F.lit(False))


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """A model of the documents with a language that aren't held out.

    Copies of a chosen document's row are learned from as often as they stand
    there. A column of languages has few values.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    chosen = labelled.where(_upto(_chosen(labelled, docs_per_language))).select("text", "lang")
    counts = chosen.mapInArrow(_words_of, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_lang: dict[str, dict[str, int]] = defaultdict(dict)
    for batch in counts.toArrow().to_batches():
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_lang[lang][word] = n
    return Model(by_lang)


class Scorer:
    """Scores of distinct words, kept between slices."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.logs = np.zeros((0, len(self.model.langs)), np.float32)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the words' logs by text and language, words by text) of lowered texts."""
        w = words(data, offsets, ALNUM)
        out = np.zeros((len(offsets) - 1, len(self.model.langs)))
        if not len(w.hashes):
            return out, w.counts
        keys, index, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > MAX_CACHED:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inner = at < len(self.keys)
        new[inner] = self.keys[at[inner]] != keys[inner]
        if new.any():
            own = index[new]
            logs = self.model.logs_of(w.data, w.starts[own], w.ends[own], keys[new])
            self.keys, self.logs = np.insert(self.keys, at[new], keys[new]), np.insert(self.logs, at[new], logs, axis=0)
            at = np.searchsorted(self.keys, keys)
        full = np.flatnonzero(w.counts)
        out[full] = np.add.reduceat(self.logs[at[inverse]].astype(np.float64), w.first[full], axis=0)
        return out, w.counts


def _predicted(shared, at: int):
    """Adds lang_pred and score; ``at`` is the text's column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        scorer, names = Scorer(model), pa.array([*model.langs, UNKNOWN])
        for batch in batches:
            for first, end, data, offsets in slices(pc.utf8_lower(batch.column(at))):
                letters = per_text(_LETTER[data], offsets) > 0
                for k in np.flatnonzero(~letters & (per_text(_WIDE[data], offsets) > 0)):
                    letters[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode())
                best, score = np.full(end - first, len(model.langs)), np.zeros(end - first)
                if model.langs:
                    total, n = scorer.scores(data, offsets)
                    mean = total / np.maximum(n, 1)[:, None]
                    share = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(n, CONFIDENT_WORDS)[:, None])
                    share /= share.sum(axis=1, keepdims=True)
                    best[letters], score[letters] = share.argmax(axis=1)[letters], share.max(axis=1)[letters]
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*own.columns, names.take(pa.array(best)), pa.array(score)], [*own.schema.names, "lang_pred", "score"])

    return run


def predict_rows(docs: DataFrame, model: Model) -> DataFrame:
    """docs with two more columns, lang_pred and score; see ``predict``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predicted(shared, docs.columns.index("text")), schema)


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language and confidence of each document.

    docs: doc_id, text, and lang where the model is to be learned from them;
    other columns are left out, and a prediction reads the text alone. A null
    text, or one without letters, is ``und`` with score 0; so is every text when
    there was nothing to learn from. Each row is judged by itself; texts of any
    length are taken whole; an empty table gives no rows.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict_rows(chosen, model or train(docs)).select("doc_id", "held_out", "lang_pred", "score")
