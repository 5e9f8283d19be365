"""Operator 11: exact merge-type SentencePiece encoding by backtracking, and decoding.

A merge-type model joins the best-scored adjacent pair again and again, equal
scores from the left.  The result is the only segmentation in which every piece
encodes to itself and every two neighbours encode to themselves, so it can be
searched for instead of merged:

* an Aho-Corasick pass over the text gives the longest piece from every place;
* from the left, the longest piece that is compatible with the piece before it
  is taken; whether two pieces are compatible is checked by merging their
  characters again (and remembered, within a bound);
* where no piece fits, the place is marked in a bitfield as failed and the
  piece before it is replaced by its next shorter prefix.  The segmentation up
  to a place is unique, so a place fails or not whatever led to it.

Many short units are searched in lockstep in numpy; long ones, and the last few, one by one.

Characters outside the vocabulary become their bytes' pieces.

Texts are first cut where no piece of the vocabulary can reach across: before
spaces that follow a non-space, and around ASCII characters of no longer piece
(digits, line ends).  Each distinct unit of a worker is encoded once, in an index of
bounded size, and the ids of whole texts are gathered from it.  What cannot be
cut (long runs without spaces) is searched whole.

Cases
-----
* null or empty text: no ids, decoded to the empty text.
* repeated rows, null ids: each row is encoded and returned by itself.
* ties (equal scores, as for runs of spaces): the leftmost pair merges first.
* strings of control pieces (``<s>``) in a text are ordinary text.
* U+2581 in a text counts as a space, as the library takes it.
* one very long run without spaces: the same search over the whole run, memory linear in it.
* empty table: an empty result with the same columns.
* extra columns: ``encode`` reads only its id and text columns.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.llm import common
from lurescan.llm.pieces import gather

SPACE = "▁"
#: Bounds of a worker's memory: units and ids of the index, remembered pairs.
INDEX_UNITS, INDEX_IDS, PAIRS = 400_000, 4_000_000, 1_000_000
#: Slots of pairs that the lockstep search reads; matches of the automaton taken at once.
SLOT_BITS, MATCHES = 19, 1 << 18
#: Units of more characters, and the last so many, are searched one by one.
LONGEST_UNIT, FEWEST = 64, 32
SLICE_BYTES = 4 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = float("-inf")


class PieceModel:
    """A merge-type model with byte fallback and no normalisation rules."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only models without normalisation rules, with a space in front, are supported")
        types = {p.type for p in proto.pieces}
        if not types <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined or unused pieces are not supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.number = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.size = len(self.pieces)
        self.controls = {i for i, t in enumerate(self.types) if t == CONTROL}
        self.unknown = proto.trainer_spec.unk_surface.encode()
        #: next shorter piece that begins a piece, -1 for none
        self.shorter = {}
        for piece, i in self.number.items():
            cut = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.number), None)
            self.shorter[i] = -1 if cut is None else self.number[cut]
        self.back = [len(p) - 1 for p in self.pieces]
        #: by token, with the characters of no piece: its length, its next shorter piece
        self.reach = np.ones(self.size + 0x110000, np.int32)
        self.reach[:self.size] = [len(p) for p in self.pieces]
        self.shorter_all = np.full(self.size + 0x110000, -1, np.int32)
        self.shorter_all[list(self.shorter)] = list(self.shorter.values())
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.number.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.alphabet = set("".join(self.number))
        self.inside = {piece[i:i + 2] for piece in self.number for i in range(len(piece) - 1)}
        self.separator = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in self.alphabet)
        # units: a run of spaces with what follows it; ASCII characters of no longer piece stand alone
        joined = {c for pair in self.inside for c in pair}
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in joined and chr(c) != " "))
        if any(pair[0] != SPACE and pair[1] == SPACE for pair in self.inside):
            self.units = re.compile(f"[{alone}]|[^{alone}]+").findall
        else:
            self.units = re.compile(f"[{alone}]| +[^ {alone}]*|[^ {alone}]+").findall
        self.fits: dict[int, bool] = {}
        self.slot_key, self.slot_fits = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)
        #: what an id stands for in a decoded text (bytes), and in a list of decimal ids
        self.surface = [self._surface(i) for i in range(self.size)]
        self.decimal = [str(i) for i in range(self.size)]

    def _surface(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:-1], 16)])
        if self.types[i] == CONTROL:
            return b""
        return self.unknown if self.types[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    # -- compatibility by merging again

    def merge(self, text: str, border: int = 0) -> list[str] | None:
        """The model's merges over a short string: best score first, equal scores from the left.

        None as soon as a pair merges across the place ``border``.
        """
        parts, get = list(text), self.score.get
        scores = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            at = scores.index(best)
            if at + 1 == border:
                return None
            if at < border:
                border -= 1  # counted in parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], NEVER)
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], NEVER)
        return parts

    def string(self, token: int) -> str:
        return self.pieces[token] if token < self.size else chr(token - self.size)

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: nothing before it): merged again, both come out as they are."""
        key = (left + 1) << 22 | right
        got = self.fits.get(key)
        if got is None:
            a, b = self.string(left) if left >= 0 else "", self.string(right)
            if a and a[-1] + b[0] not in self.inside:  # nothing merges across: each by itself
                got = self.compatible(-1, right)
            else:
                got = self.merge(a + b, len(a)) == ([a, b] if a else [b])
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[key] = got
        return got

    # -- search

    def longest(self, text: str) -> np.ndarray:
        """The longest piece from every place (as its id); characters of no piece count from ``size`` on."""
        out = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32) + np.int32(self.size)
        found = chain.from_iterable(self.automaton.iter(text))
        while len(some := np.fromiter(islice(found, 2 * MATCHES), np.int32)):
            end, token = some[::2], some[1::2]
            out[end - self.reach[token] + 1] = token  # ends ascend, so the longest from a place comes last
        return out

    def search(self, longest: np.ndarray, start: int, end: int) -> list[int]:
        """Tokens of text[start:end]: longest compatible piece first, shorter ones where the search got stuck."""
        longest, end, start = array("i", longest[start:end].tobytes()), end - start, 0
        failed = bytearray((end - start >> 3) + 1)  # a bit a place
        tokens: list[int] = []
        back, size, compatible, shorter, fits = self.back, self.size, self.compatible, self.shorter, self.fits
        at, token = start, longest[start]
        while True:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                to = at + back[token] + 1 if token < size else at + 1
                bit = to - start
                if not failed[bit >> 3] >> (bit & 7) & 1:
                    fit = fits.get((last + 1) << 22 | token)
                    if compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token] if token < size else -1
            if token >= 0:
                tokens.append(token)
                at = to
                if at == end:
                    return tokens
                token = longest[at]
                continue
            bit = at - start
            failed[bit >> 3] |= 1 << (bit & 7)
            if not tokens:  # no vocabulary allows this: every text has a segmentation
                raise AssertionError("no segmentation found")
            token = tokens.pop()
            at -= back[token] + 1 if token < size else 1

    def compatible_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs: asked once for each pair that its slot does not hold."""
        key = (left.astype(np.int64) + 1) << 22 | right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out, missed = self.slot_fits[slot], np.flatnonzero(self.slot_key[slot] != key)
        if len(missed):
            new, first, back = np.unique(key[missed], return_index=True, return_inverse=True)
            got = np.array([self.compatible((k >> 22) - 1, k & (1 << 22) - 1) for k in new.tolist()])
            out[missed] = got[back]
            to, pick = np.unique(slot[missed[first]], return_index=True)
            self.slot_key[to], self.slot_fits[to] = new[pick], got[pick]
        return out

    def search_all(self, longest: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``search`` of many units in lockstep: (places where their tokens end, in order, these tokens).

        ``ended[p]`` is the token that ends at p on a unit's path so far, which serves as its stack.
        The last few units, and long ones, are searched one by one.
        """
        ended = np.full(len(longest) + 1, -1, np.int32)
        failed = np.zeros((len(longest) >> 3) + 1, np.uint8)  # a bit a place
        unit = np.flatnonzero(ends - starts <= LONGEST_UNIT)
        alone = [np.flatnonzero(ends - starts > LONGEST_UNIT)]
        at = starts[unit]
        token = longest[at]
        while len(unit) > FEWEST:
            stuck = np.flatnonzero(token < 0)
            if len(stuck):
                place = at[stuck]
                np.bitwise_or.at(failed, place >> 3, (1 << (place & 7)).astype(np.uint8))
                token[stuck] = ended[place]
                at[stuck] -= self.reach[token[stuck]]
                if (at[stuck] < starts[unit[stuck]]).any():
                    raise AssertionError("no segmentation found")
            to = at + self.reach[token]
            fit = failed[to >> 3] >> (to & 7) & 1 == 0
            some = np.flatnonzero(fit)
            fit[some] = self.compatible_all(ended[at[some]], token[some])
            ended[to[fit]] = token[fit]
            at = np.where(fit, to, at)
            token = np.where(fit, longest[np.minimum(at, len(longest) - 1)], self.shorter_all[token])
            going = at < ends[unit]
            unit, at, token = unit[going], at[going], token[going]
        alone.append(unit)
        for k in np.concatenate(alone).tolist():
            tokens = np.array(self.search(longest, int(starts[k]), int(ends[k])), np.int32)
            ended[starts[k] + np.cumsum(self.reach[tokens])] = tokens
        path, at, first = np.zeros(len(longest) + 1, bool), ends, starts  # back from the ends
        while len(at):
            path[at] = True
            at = at - self.reach[ended[at]]
            at, first = at[at > first], first[at > first]
        place = np.flatnonzero(path)
        return place, ended[place]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, number of ids of each); one pass of the automaton over all of them."""
        if not units:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text = self.separator.join(units).replace(" ", SPACE)
        length = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(length + 1) - 1
        place, ids = self.search_all(self.longest(text), ends - length, ends)
        bounds = np.concatenate([[0], np.searchsorted(place, ends, "right")])
        unknown = np.flatnonzero(ids >= self.size)
        if len(unknown):  # become their bytes
            chars, which = np.unique(ids[unknown], return_inverse=True)
            spelt = [[self.bytes[b] for b in chr(c - self.size).encode("utf-8")] for c in chars.tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[unknown] = np.array([len(x) for x in spelt])[which]
            stops = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.repeat(ids, sizes)
            for i, k in zip(stops[unknown].tolist(), which.tolist()):
                ids[i:i + len(spelt[k])] = spelt[k]
            bounds = stops[bounds]
        return ids, np.diff(bounds)

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        if not text:
            return []
        units = self.units(" " + text.replace(SPACE, " "))
        return self.encode_units(units)[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids, byte for byte as the library's ``decode(ids)``: runs of byte pieces are read as
        UTF-8, each invalid byte as U+FFFD, and the first piece loses the space in front."""
        return self.decoded(ids).decode("utf-8", "replace")

    def decoded(self, ids) -> bytes:
        if not len(ids):
            return b""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if not self.controls.isdisjoint(ids):
            return self._lenient(ids)
        if self.types[ids[0]] == NORMAL and raw[0] == 0x20:
            raw = raw[1:]
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return self._lenient(ids)

    def _lenient(self, ids) -> bytes:
        """``decoded`` for ids with control pieces, or whose byte pieces are no valid UTF-8."""
        out, run, begin = [], bytearray(), True

        def flush():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        run[at:at + n].decode("utf-8")
                        out.append(bytes(run[at:at + n]))
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    at += 1
            run.clear()

        for i in ids:
            if self.types[i] == BYTE:
                run.append(self.surface[i][0])
                begin = False
                continue
            flush()
            piece = self.surface[i]
            if begin and self.types[i] == NORMAL and piece[:1] == b" ":
                piece = piece[1:]
            begin = begin and self.types[i] == CONTROL
            out.append(piece)
        flush()
        return b"".join(out)


class UnitIds:
    """Ids of whole texts from an index of units; the index starts over when it is full."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets) of an Arrow array of strings without nulls."""
        if len(self.known) > INDEX_UNITS or len(self.flat) > INDEX_IDS:
            self.clear()
        units = self.model.units
        cut = [units(" " + t) if t else [] for t in pc.replace_substring(texts, SPACE, " ").to_pylist()]
        counts = np.array([len(c) for c in cut], np.int64)
        coded = pa.array([u for c in cut for u in c], pa.string()).dictionary_encode()
        number = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        ids, total = gather(self.flat, self.ends[number], np.diff(self.ends)[number])
        return ids, total[np.concatenate([[0], np.cumsum(counts)])]

    def _numbers(self, units: pa.Array) -> np.ndarray:
        at = pc.index_in(units, value_set=self.known)
        number = at.fill_null(-1).to_numpy().astype(np.int64)
        new = units.filter(pc.is_null(at))
        if len(new):
            flat, sizes = self.model.encode_units(new.to_pylist())
            number[number < 0] = len(self.known) + np.arange(len(new))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat])
            self.known = pa.concat_arrays([self.known, new])
        return number


_models: dict[str, UnitIds] = {}


def encoder(path: str) -> UnitIds:
    """One model and index a worker."""
    if path not in _models:
        _models[path] = UnitIds(PieceModel(path))
    return _models[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (array<int>), and the digests of the ids and of the decoded text.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256``
    over the text that decoding the ids gives, in UTF-8.
    """
    common.ready(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), common.text_of(F.col(f"`{text_col}`")).alias("text"))
    fields = f"id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def digest(raw: bytes) -> str:
        return hashlib.sha256(raw).hexdigest()

    def run(batches):
        index = encoder(path)
        model = index.model
        for batch in batches:
            offsets, _ = common.string_parts(batch.column(1))
            for a, b in common.slices(offsets, SLICE_BYTES):
                ids, at = index.ids(batch.column(1).slice(a, b - a).cast(pa.string()))
                rows = [ids[i:j].tolist() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                out = [batch.column(0).slice(a, b - a), pa.array(np.diff(at)),
                       pa.array([digest(",".join(map(model.decimal.__getitem__, r)).encode()) for r in rows], pa.string()),
                       pa.array([digest(model.decoded(r)) for r in rows], pa.string())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(out, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:len(out)])

    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the text that each row's ids decode to; null or no ids give the empty text."""
    common.ready(rows.sparkSession)
    key = rows.schema[id_col].dataType.simpleString()
    picked = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))

    def run(batches):
        model = encoder(path).model
        for batch in batches:
            texts = [model.decode(r or []) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return picked.mapInArrow(run, f"id {key}, text string").withColumnRenamed("id", id_col)


def query(spark, sf_dir) -> DataFrame:
    import public_tokenizers as P

    return encode(common.documents(spark, sf_dir).select("doc_id", "text"), P.path("piece_bpe_32k.model"), with_ids=False)
