"""Operator 6: token counts by a finite-state transducer.

The tokenizer (pre-token pattern and byte-level BPE) is compiled to one
deterministic transducer over bytes.  A transition carries the change of the
number of tokens, so the count of a text is the sum along its path plus a final
correction of the state in which it ends.

* BPE.  The last token of an encoded prefix ends at the prefix's end, and what
  stands before it is the encoding of the shorter prefix.  So a state keeps,
  for every earlier boundary at which a token may still be under way, the node
  of that token in the vocabulary's trie, the last token before the boundary,
  and the count there relative to now.  Exactly one token that ends with the
  next byte may follow the last token at its boundary: the pair is encoded as
  itself.  States that agree in all of this have the same future, so they are
  one state; their number is finite.
* Pattern.  Runs of letters, numbers and others, contractions, and white space
  whose last character is held back until the next one is known.

The transducer is compiled as transitions are met and kept in a hash table on
numpy arrays; a worker starts over when it holds ``MAX_TRANSITIONS``.

Texts are cut into chunks of ``CHUNK`` bytes that run in lockstep.  A chunk's
state map is constant from its first synchronising position on: after a space
behind a visible ASCII character every path is in the same state.  So all
chunks' tails run at once; a prefix scan over each text's chunks hands the exit
states on, and the short heads run from those; a chunk without such a position
takes its entry state from the scan and passes its exit on in the next round.

Cases
-----
* null or empty text: no bytes, no tokens, not over the limit.
* null ids and repeated rows: each row is counted by itself.
* a text without spaces: its chunks run one after another, same result.
* special strings inside texts count as the library's default has it: one
  token each, and the parts between them are encoded separately.
* n_tokens equal to the limit is not over it.
* empty table: an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.llm import common

LIMIT = 1024
CHUNK = 384
MAX_TRANSITIONS = 900_000
SLICE_BYTES = 16 << 20

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
FIRST = -1  # "last token" at the start of a pre-token


class BPEStates:
    """States and transitions of BPE within one pre-token, compiled on demand."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]]):
        self.tokens = tokens
        self.rank = {m: i for i, m in enumerate(merges)}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: dict[int, int] = {}
        for t, token in enumerate(tokens):
            node = 0
            for b in token:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                node = nxt
            self.token_at[node] = t
        self.follows: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.number = {((0, FIRST, 0),): 0}
        self.states = [((0, FIRST, 0),)]
        self.step_memo: dict[tuple[int, int], tuple[int, int]] = {}

    def encode(self, text: bytes) -> list[bytes]:
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, last: int, token: int) -> bool:
        got = self.follows.get((last, token))
        if got is None:
            b = self.tokens[token]
            want = [b] if last == FIRST else [self.tokens[last], b]
            got = self.follows[last, token] = self.encode(b"".join(want)) == want
        return got

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count)."""
        got = self.step_memo.get((state, byte))
        if got is not None:
            return got
        alive, end = [], None
        for node, last, rel in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            if self.children[child]:
                alive.append((child, last, rel))
            if end is None:
                token = self.token_at.get(child)
                if token is not None and self.may_follow(last, token):
                    end = token, rel + 1
        token, delta = end
        new = tuple((n, t, r - delta) for n, t, r in alive) + ((0, token, 0),)
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        self.step_memo[state, byte] = to, delta
        return to, delta

    def run(self, state: int, text: bytes) -> tuple[int, int]:
        total = 0
        for b in text:
            state, d = self.step(state, b)
            total += d
        return state, total


_letter, _number, _space = (regex.compile(p).match for p in (r"\p{L}", r"\p{N}", r"\s"))
START, RUN, SPACE, QUOTE, QUOTE_MORE = range(5)
_ENDS = {"r": "e", "v": "e", "l": "l"}


class Transducer:
    """States are (mode, class or held character, BPE state, bytes of an unfinished character)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in _alphabet().items()}
        plain = lambda t: bytes(back[c] for c in t)
        vocab = [t for t, _ in sorted(spec["model"]["vocab"].items(), key=lambda x: x[1])]
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.bpe = BPEStates([plain(t) for t in vocab if t not in self.special], [(plain(a), plain(b)) for a, b in merges])
        self.kinds: dict[str, str] = {}
        self.clear()

    def clear(self) -> None:
        self.bpe.clear()
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.filled = 0
        self._table(1 << 20)
        self.start = self.intern((START, "", 0, b""))
        self.after_space = self.intern((SPACE, b" ", 0, b""))
        self.finals: dict[int, int] = {}

    def _table(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int64)
        self.next = np.zeros(size, np.int32)
        self.delta = np.zeros(size, np.int8)
        self.shift = np.uint64(64 - int(size).bit_length() + 1)

    def intern(self, state: tuple) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def kind(self, char: str) -> str:
        got = self.kinds.get(char)
        if got is None:
            got = "W" if _space(char) else "L" if _letter(char) else "N" if _number(char) else "P"
            self.kinds[char] = got
        return got

    def transition(self, n: int, byte: int) -> tuple[int, int]:
        mode, what, inner, part = self.states[n]
        part += bytes([byte])
        lead = part[0]
        if len(part) < (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
            return self.intern((mode, what, inner, part)), 0
        state, delta = self.on_char(mode, what, inner, part.decode("utf-8", "surrogatepass"), part)
        return self.intern((*state, b"")), delta

    def on_char(self, mode, what, inner, char, raw):
        kind, run = self.kind(char), self.bpe.run
        if mode == SPACE:
            if kind == "W":
                inner, delta = run(inner, what)
                return (SPACE, raw, inner), delta
            if what == b" ":
                inner, delta = run(0, b" " + raw)
                return (RUN, kind, inner), delta
            state, delta = self.on_char(START, "", 0, char, raw)
            return state, delta + run(0, what)[1]
        if mode == RUN and kind == what:
            inner, delta = run(inner, raw)
            return (RUN, kind, inner), delta
        if mode == QUOTE:
            if char in "stmd":
                return (START, "", 0), run(0, b"'" + raw)[1] - run(0, b"'")[1]
            if kind == "P":
                inner, delta = run(inner, raw)
                return (RUN, "P", inner), delta
            if char in _ENDS:
                inner, delta = run(0, raw)
                return (QUOTE_MORE, char, inner), delta
        if mode == QUOTE_MORE:
            if char == _ENDS[what]:
                had = run(0, b"'")[1] + run(0, what.encode())[1]
                return (START, "", 0), run(0, b"'" + what.encode() + raw)[1] - had
            if kind == "L":
                inner, delta = run(inner, raw)
                return (RUN, "L", inner), delta
        if kind == "W":
            return (SPACE, raw, 0), 0
        inner, delta = run(0, raw)
        return ((QUOTE, "", inner) if char == "'" else (RUN, kind, inner)), delta

    def final(self, n: int) -> int:
        """What the end of the text adds: a held white space joins its run."""
        got = self.finals.get(n)
        if got is None:
            mode, what, inner, _ = self.states[n]
            got = self.finals[n] = self.bpe.run(inner, what)[1] if mode == SPACE else 0
        return got

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def _insert(self, keys: np.ndarray, nxt: np.ndarray, delta: np.ndarray) -> None:
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.keys[at[todo]] == -1)
            slot, one = np.unique(at[todo[free]], return_index=True)
            put = todo[free[one]]
            self.keys[slot], self.next[slot], self.delta[slot] = keys[put], nxt[put], delta[put]
            todo = np.delete(todo, free[one])
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        self.filled += len(keys)

    def _compile(self, keys: np.ndarray) -> None:
        got = [self.transition(k >> 8, k & 255) for k in keys.tolist()]
        if 2 * (self.filled + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keep = self.keys[old], self.next[old], self.delta[old]
            self._table(4 * len(self.keys))
            self.filled = 0
            self._insert(*keep)
        self._insert(keys, np.array([x[0] for x in got], np.int32), np.array([x[1] for x in got], np.int8))

    def step(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, changes of the counts) of many paths at once."""
        keys = (states.astype(np.int64) << 8) | data
        while True:
            at = self._slot(keys)
            here = self.keys[at]
            todo = np.flatnonzero(here != keys)
            missed = []
            while len(todo):
                none = here[todo] == -1
                if none.any():
                    missed.append(keys[todo[none]])
                    todo = todo[~none]
                at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
                here[todo] = self.keys[at[todo]]
                todo = todo[here[todo] != keys[todo]]
            if not missed:
                return self.next[at], self.delta[at]
            self._compile(np.unique(np.concatenate(missed)))

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, counts) of paths over data[start:end] from the given states, in lockstep."""
        order = np.argsort(start - end, kind="stable")  # longest first: the active paths are a prefix
        at, length = start[order], (end - start)[order]
        now, total = states[order].astype(np.int32), np.zeros(len(order), np.int64)
        for j in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -j, "left"))
            now[:n], delta = self.step(now[:n], data[at[:n] + j])
            total[:n] += delta
        out, sums = np.empty_like(now), np.empty_like(total)
        out[order], sums[order] = now, total
        return out, sums

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of the texts data[start:end]."""
        if self.filled > MAX_TRANSITIONS:
            self.clear()
        n = len(starts)
        pieces = -(-(ends - starts) // CHUNK)
        text = np.repeat(np.arange(n), pieces)
        first = np.zeros(len(text), bool)
        begin = np.cumsum(pieces) - pieces
        first[begin[pieces > 0]] = True
        a = starts[text] + (np.arange(len(text)) - begin[text]) * CHUNK
        b = np.minimum(a + CHUNK, ends[text])
        # a chunk's tail begins behind its first synchronising space
        visible = (data > 0x20) & (data < 0x7F)
        sync = np.zeros(len(data), bool)
        sync[1:] = (data[1:] == 0x20) & visible[:-1]
        where = np.append(np.flatnonzero(sync), len(data) + CHUNK)
        tail = where[np.searchsorted(where, a)] + 1
        constant = (tail <= b) & ~first
        tail[first] = a[first]
        known = first | constant
        exits = np.zeros(len(text), np.int32)
        counts = np.zeros(len(text), np.int64)
        exits[known], counts[known] = self.run(data, tail[known], b[known], np.where(
            first, self.start, self.after_space)[known])
        # the scan: entry states become known along each text; heads follow
        todo, head_end = np.flatnonzero(~first), np.where(constant, tail, b)
        while len(todo):
            ready = known[todo - 1]
            go = todo[ready]
            out, sums = self.run(data, a[go], head_end[go], exits[go - 1])
            counts[go] += sums
            open_ = ~constant[go]
            exits[go[open_]] = out[open_]
            known[go] = True
            todo = todo[~ready]
        total = np.bincount(text, counts, n).astype(np.int64)
        last = (begin + pieces - 1)[pieces > 0]
        state, which = np.unique(exits[last], return_inverse=True)
        total[pieces > 0] += np.array([self.final(s) for s in state.tolist()], np.int64)[which] if len(last) else 0
        return total


def _alphabet() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def count_slice(t: Transducer, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Tokens of every text of a slice; special strings cut texts and count one."""
    starts, ends = offsets[:-1], offsets[1:]
    blob, cuts = data.tobytes(), []
    for s in t.special:
        mark, at = s.encode(), 0
        while (at := blob.find(mark, at)) >= 0:
            text = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(mark) <= offsets[text + 1]:
                cuts.append((at, at + len(mark), text))
                at += len(mark)
            else:
                at += 1
    if not cuts:
        return t.count(data, starts, ends)
    cuts.sort()
    row = np.concatenate([np.arange(len(starts)), [c[2] for c in cuts]])
    a = np.concatenate([starts, [c[1] for c in cuts]])
    order = np.lexsort((a, row))
    row, a = row[order], a[order]
    b = ends[row]
    gap = {c[1]: c[0] for c in cuts}
    for i in range(len(row) - 1):
        if row[i + 1] == row[i]:
            b[i] = gap[int(a[i + 1])]
    total = np.bincount(row, t.count(data, a, b), len(starts)).astype(np.int64)
    return total + np.bincount([c[2] for c in cuts], minlength=len(starts))


def counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), common.text_of(F.col(f"`{text_col}`")).alias("text"))

    def kernel(ids, offsets, data):
        n = count_slice(machine(path), offsets, data)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                                          ["id", "n_bytes", "n_tokens", "over_limit"])

    return common.map_texts(rows, kernel, f"id {key}, n_bytes long, n_tokens long, over_limit boolean",
                            SLICE_BYTES).withColumnRenamed("id", id_col)


def query(spark, sf_dir) -> DataFrame:
    import public_tokenizers as P

    return counts(common.documents(spark, sf_dir).select("doc_id", "text"), P.path("byte_bpe_50k.json"))
