"""Texts to token ids through a bounded index of words, on Arrow and numpy arrays.

The vocabulary's pattern always cuts before a space that a non-space follows,
whatever stands before it.  So a text can first be cut at such spaces, and a
word with its space in front has the same ids in every text.  A slice's words
are dictionary-encoded; only words that the index has not met are split by the
pattern and encoded, in one batch, and the ids of whole texts are gathered from
one flat array.

The index is bounded: a worker starts over when it holds ``max_words`` words or
``max_ids`` ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

MAX_WORDS = 1_500_000
MAX_IDS = 12_000_000
#: Texts are handed over in slices of about this many bytes.
SLICE_BYTES = 6 << 20

#: A space before more white space or the end of the text (RE2 syntax).
UNEVEN = r" (?:[\x09-\x0d\x1c-\x1f\x{85}\p{Z}]|\z)"


def gather(store: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``store`` one after another, and the n + 1 places where they begin and end."""
    total = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(start - total[:-1], size)
    take += np.arange(total[-1])
    return store[take], total


class WordIds:
    """``encode(pieces: list[str]) -> (ids of all pieces in one array, number of ids of each)`` behind the index."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: str = "<u4",
                 max_words: int = MAX_WORDS, max_ids: int = MAX_IDS):
        self.max_words, self.max_ids = max_words, max_ids
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile(r" (?=\S)").split
        self.space = regex.compile(r"\s").search
        self.encode, self.dtype = encode, dtype
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, self.dtype)
        self.ends = np.zeros(1, np.int64)  # ends[i + 1]: where word i ends in flat

    def by_pattern(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of texts that are split by the pattern: each distinct piece is encoded once."""
        parts = [self.split(t) for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        return self._of_pieces([x for p in parts for x in p], counts)

    def _of_pieces(self, pieces: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        flat, sizes = self.encode(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()
        ends = np.cumsum(sizes)
        ids, total = gather(flat, (ends - sizes)[at], sizes[at])
        step = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[step])

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words with a space in front."""
        single = np.array([bool(w) and self.space(w) is None for w in words], bool)
        easy = [w for w, s in zip(words, single) if s]
        # one pass of the pattern over all of them: a line end between words is a piece by itself
        pieces = self.split(" " + "\n ".join(easy)) if easy else []
        marks = np.flatnonzero(np.array([p == "\n" for p in pieces], bool))
        counts = np.diff(np.concatenate([[-1], marks, [len(pieces)]])) - 1 if easy else np.zeros(0, np.int64)
        ids, sizes = self._of_pieces([p for p in pieces if p != "\n"], counts)
        if single.all():
            return ids, sizes
        hard, hard_sizes = self.by_pattern([" " + w for w, s in zip(words, single) if not s])
        size, start = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[single], start[single] = sizes, np.cumsum(sizes) - sizes
        size[~single], start[~single] = hard_sizes, len(ids) + np.cumsum(hard_sizes) - hard_sizes
        return gather(np.concatenate([ids, hard]), start, size)[0], size

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets) of an Arrow array of strings without nulls."""
        if len(self.known) > self.max_words or len(self.flat) > self.max_ids:
            self.clear()
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, UNEVEN)
        if pc.any(odd).as_py():
            where = odd.to_numpy(zero_copy_only=False)
            cut = [self.cut(t) for t in texts.filter(odd).to_pylist()]
            some = pa.array(cut, pa.list_(pa.string()))
            even = pc.split_pattern(texts.filter(pc.invert(odd)), " ").cast(pa.list_(pa.string()))
            order = np.empty(len(texts), np.int64)
            order[np.concatenate([np.flatnonzero(where), np.flatnonzero(~where)])] = np.arange(len(texts))
            lists = pa.concat_arrays([some, even]).take(pa.array(order))
        else:
            lists = pc.split_pattern(texts, " ").cast(pa.list_(pa.string()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets, words = offsets - offsets[0], lists.flatten()
        coded = words.dictionary_encode()
        number = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        head = offsets[:-1]
        head_flat, head_sizes = self.by_pattern(words.take(pa.array(head)).to_pylist())
        start, size = self.ends[number], np.diff(self.ends)[number]
        start[head], size[head] = len(self.flat) + np.cumsum(head_sizes) - head_sizes, head_sizes
        ids, total = gather(np.concatenate([self.flat, head_flat.astype(self.dtype)]), start, size)
        return ids, total[offsets]

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Index numbers of distinct words; new ones are encoded and join the index."""
        at = pc.index_in(words, value_set=self.known)
        missed = pc.is_null(at)
        number = at.fill_null(-1).to_numpy().astype(np.int64)
        new = words.filter(missed)
        if len(new):
            flat, sizes = self._encode_words(new.to_pylist())
            number[number < 0] = len(self.known) + np.arange(len(new))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
            self.known = pa.concat_arrays([self.known, new])
        return number
