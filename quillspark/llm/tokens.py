"""Token ids of whole texts by a public tokenizer, computed once per distinct word.

The tokenizer splits at white space, between letters, single digits and other
signs, and merges only inside such a run. So a text is cut at places where a
split is certain (ASCII white space; between a letter, a digit and an ASCII
sign), each distinct piece is encoded once by the tokenizers library, and the
ids of a text are gathered from those of its pieces. Pieces that hold signs
with a meaning for the tokenizer (an apostrophe, < | >, most characters outside
of ASCII) are left whole and given to the library as they are.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from quillspark.llm.textbytes import LOWER, ragged, run_hashes

#: The cache of pieces starts anew beyond this many.
MAX_PIECES = 1_500_000
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = 0, 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[ord(c) for c in "'<|>"]] = _OTHER


def default_path() -> str:
    """The vocabulary file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _classes(data: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    # letters U+00C0 to U+00FF, but for the two signs among them
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


class Encoder:
    """Encodes slices of text; keeps the ids of pieces between calls."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) > MAX_PIECES:
            self._clear()
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = [e.ids for e in batch(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
        at = np.searchsorted(self.keys, keys)
        self.place = np.insert(self.place, at, len(self.pool) + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.keys = np.insert(self.keys, at, keys)
        self.pool = np.concatenate([self.pool, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text and the number of all)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _classes(data)
        cut = np.ones(len(data) + 1, bool)  # whether a piece may not run over the place before a byte
        a, b = kind[:-1], kind[1:]
        cut[1:-1] = ((a != b) & (a < _OTHER) & (b < _OTHER)) | (a == _SPACE) | (b == _SPACE) | ((a == _DIGIT) & (b == _DIGIT))
        cut[offsets] = True
        inside = kind != _SPACE
        starts = np.flatnonzero(inside & cut[:-1])
        ends = np.flatnonzero(inside & cut[1:]) + 1
        if b"<|" not in data.tobytes():
            # upper case is lowered early, but not before a character that may compose with it
            plain = np.append(kind[1:] != _OTHER, True)
            data = np.where(plain, LOWER[data], data)
        h = run_hashes(data, starts, ends)
        keys, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        if not len(keys):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inner = at < len(self.keys)
        new[inner] = self.keys[at[inner]] != keys[inner]
        if new.any():
            if len(self.keys) > MAX_PIECES:
                self._clear()
                new[:] = True
            raw = data.tobytes()
            self._learn(keys[new], [raw[starts[i] : ends[i]].decode() for i in index[new]])
            at = np.searchsorted(self.keys, keys)
        slot = at[inverse]
        count = self.count[slot]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[ragged(self.place[slot], count)]
        return ids, before[np.searchsorted(starts, offsets)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python process."""
    return Encoder(path)
