"""Operator 5: byte-level BPE encoding and decoding in numpy.

Pieces (matches of the vocabulary's pattern) are bucketed by length and laid
out as padded matrices of token ids, one piece a row.  In each round every row
looks up the ranks of its adjacent pairs in an open-addressing hash table,
merges its leftmost pair of minimum rank, and closes the gap; rows without a
pair leave.  Pieces longer than ``LONGEST_ROW`` bytes take the same merges from
a heap of pairs, so that their cost stays n log n.

Cases
-----
* null or empty text: no ids, decoded to nothing.
* repeated rows, null ids: each row is encoded and returned by itself.
* one very long piece: the heap path, same result.
* ties (equal ranks): the leftmost pair merges first.
* special strings (``<|endoftext|>``) are ordinary text.
* empty table: an empty result with the same columns.
* extra columns: ``encode`` reads only its id and text columns.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.llm import common
from lurescan.llm.pieces import SLICE_BYTES, WordIds, gather
from lurescan.llm.words import mix

LONGEST_ROW = 128
ROWS_AT_ONCE = 20_000
#: Bounds of a worker's index of words; a worker keeps it between tasks.
INDEX_WORDS, INDEX_IDS = 400_000, 4_000_000
_U = np.uint64
NONE = np.int32(2**31 - 1)
PAD = np.int32(-1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Hash table (left id, right id) -> id of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        get = ranks.get
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None and (b := get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, _U) << _U(32)) | np.array(right, _U)
        merged = np.array(merged, np.int32)
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = _U(size - 1)
        self.keys = np.full(size, _U(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(size, NONE, np.int32)
        todo, at = np.arange(len(keys)), mix(keys) & self.mask
        while len(todo):
            free = self.keys[at[todo]] == _U(0xFFFFFFFFFFFFFFFF)
            slot, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slot], self.values[slot] = keys[put], merged[put]
            left_ = np.ones(len(keys), bool)
            left_[put] = False
            todo = todo[left_[todo]]
            at[todo] = (at[todo] + _U(1)) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs (any shape), NONE where the pair does not merge."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        key = (left.astype(_U) << _U(32)) | right.astype(_U)
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = mix(key[todo]) & self.mask
        while len(todo):
            here = self.keys[at]
            hit = here == key[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (here != _U(0xFFFFFFFFFFFFFFFF))
            todo, at = todo[go], (at[go] + _U(1)) & self.mask
        return out.reshape(shape)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        top = max(ranks.values()) + 1
        self.tokens = [b""] * top
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def matrix(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of about the same length -> (rows as they end, their ids one after another, number of ids of each)."""
        lengths = np.array([len(r) for r in rows])
        width = int(lengths.max())
        ids = np.full((len(rows), width), PAD, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        rank = np.full((len(rows), width), NONE, np.int32)  # of the pair that begins at each place
        rank[:, :-1] = self.table.ranks(ids[:, :-1], ids[:, 1:])
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alive = np.arange(len(rows))
        while len(alive):
            at = rank.argmin(axis=1)  # leftmost minimum
            line = np.arange(len(alive))
            best = rank[line, at]
            done = best == NONE
            if done.any():
                real = ids[done] >= 0
                ended.append((alive[done], ids[done][real], real.sum(axis=1)))
                keep = ~done
                alive, ids, rank, at, best = alive[keep], ids[keep], rank[keep], at[keep], best[keep]
                if not len(alive):
                    break
                width = int((ids >= 0).sum(axis=1).max())
                ids, rank = ids[:, :width], rank[:, :width]
                line = np.arange(len(alive))
            # close the gap: places after the merged pair move one to the left
            width = ids.shape[1]
            column = np.arange(width)
            source = column + (column > at[:, None])
            behind = source >= width
            source[behind] = width - 1
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[behind], rank[behind] = PAD, NONE
            ids[line, at] = best
            right = np.where(at + 1 < width, ids[line, np.minimum(at + 1, width - 1)], PAD)
            rank[line, at] = self.table.ranks(best, right)
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.table.ranks(ids[has, at[has] - 1], best[has])
        return tuple(np.concatenate(x) for x in zip(*ended))

    def long_piece(self, piece: bytes) -> np.ndarray:
        """Same merges for one long piece, from a heap of (rank, place)."""
        if (whole := self.ranks.get(piece)) is not None:
            return np.array([whole], np.int32)
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prev, tokens, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.tokens, self.ranks.get
        heap = []

        def push(i):
            j = nxt[i]
            if j < n and (r := get(tokens[ids[i]] + tokens[ids[j]])) is not None:
                heap.append((r, i)) if not heap_ready else heapq.heappush(heap, (r, i))

        heap_ready = False
        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        heap_ready = True
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := nxt[i]) >= n or get(tokens[ids[i]] + tokens[ids[j]]) != r:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each), bucket by bucket of like length."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        length = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(length, kind="stable")
        ranked = length[order]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            size = int(ranked[at])
            if size > LONGEST_ROW:
                for i in order[at:].tolist():
                    ids = self.long_piece(raw[i])
                    parts.append((np.array([i]), ids, np.array([len(ids)])))
                break
            limit = min(size + size // 4, LONGEST_ROW)  # a bucket's lengths are alike
            to = min(int(np.searchsorted(ranked, limit, "right")), at + ROWS_AT_ONCE)
            rows = order[at:to]
            row, ids, sizes = self.matrix([raw[i] for i in rows.tolist()])
            parts.append((rows[row], ids, sizes))
            at = to
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        row, flat, sizes = (np.concatenate(x) for x in zip(*parts))
        size, start = np.empty(len(raw), np.int64), np.empty(len(raw), np.int64)
        size[row], start[row] = sizes, np.cumsum(sizes) - sizes
        return gather(flat, start, size)[0], size

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, one after another."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_coders: dict[tuple[str, str], tuple[ByteBPE, WordIds]] = {}


def coder(path: str, pattern: str) -> tuple[ByteBPE, WordIds]:
    """One encoder a worker and vocabulary."""
    if (path, pattern) not in _coders:
        bpe = ByteBPE(read_ranks(path))
        _coders[path, pattern] = bpe, WordIds(pattern, bpe.encode, "<u4", INDEX_WORDS, INDEX_IDS)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (array<int>), and the digests of the ids and of the decoded bytes."""
    common.ready(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), common.text_of(F.col(f"`{text_col}`")).alias("text"))
    fields = f"id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        bpe, words = coder(path, pattern)
        for batch in common.released(batches):
            offsets, _ = common.string_parts(batch.column(1))
            for a, b in common.slices(offsets, SLICE_BYTES):
                ids, at = words.ids(batch.column(1).slice(a, b - a))
                raw, spans = ids.tobytes(), list(zip(at[:-1].tolist(), at[1:].tolist()))
                out = [batch.column(0).slice(a, b - a), pa.array(np.diff(at)),
                       pa.array([hashlib.sha256(raw[4 * i:4 * j]).hexdigest() for i, j in spans], pa.string()),
                       pa.array([hashlib.sha256(bpe.decode(ids[i:j])).hexdigest() for i, j in spans], pa.string())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:len(out)])

    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def query(spark, sf_dir) -> DataFrame:
    import public_tokenizers as P

    return encode(common.documents(spark, sf_dir).select("doc_id", "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN,
                  with_ids=False)
