"""Operator 9: removal of repeated 100-byte substrings by a hash-compared suffix sort.

A byte goes if it lies in a ``WIDTH``-byte string that also starts earlier
(smaller id, or same id and smaller place).  The corpus is cut so that equal
strings always meet:

1. Each ``WIDTH``-byte window is owned by an anchor, its smallest ``GRAM``-byte
   gram by hash (leftmost of equals).  Equal windows have equal anchors at equal
   offsets.  Neighbouring windows with one anchor form a super-window, so a text
   gives one row for about forty bytes: anchor hash, content hash, place.
2. Equal super-windows of one slice collapse before the shuffle: only the first
   travels, all windows of the others are known to repeat.
3. Rows meet by anchor hash, sorted, and are read as a stream: of equal
   super-windows all but the first repeat as a whole.  An anchor that has only
   one content needs nothing more; these are nearly all.
4. Anchors with several contents send their first super-windows' bytes to a
   task by anchor.  There all their suffixes are sorted by mergesort.  Two
   suffixes are compared by the hashes of their prefixes: binary search finds
   how far they agree, the next byte decides.  Neighbours that agree in
   ``WIDTH`` bytes by hash are compared byte by byte; a collision sends the
   group to a plain sort.  All but the first window of a run of equals repeat.
5. The anchors that more than ``HOT`` distinct super-windows share are split:
   their windows meet by two 64-bit hashes of the window itself.
6. Repeated windows are merged to spans per document and cut out.

Nothing is capped, and no task holds more than a slice, a document, or ``HOT``
super-windows.

Cases
-----
* null or empty text, texts under ``WIDTH`` bytes: nothing is removed.
* null ids: such rows are returned whole and not compared.
* repeated rows (same id and text) are one document: each is returned alike.
* overlapping repeats within one text (long runs of one character) count.
* very long texts: one super-window row for about forty bytes, spans per text.
* empty table: an empty result; extra columns are ignored by ``spans`` and
  returned by ``cleaned``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.llm import common
from lurescan.llm.words import mix, powers, prefix_hash, range_hash

WIDTH, GRAM = 100, 24
SPAN = WIDTH - GRAM + 1  # anchors a window may have
HOT = 20_000
SLICE_BYTES = 2 << 20
_U = np.uint64
ROW = "h long, c long, id long, s int, n int, a int"


def anchors(data: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For every window start: the place of its smallest gram (windows may cross texts; see super_windows)."""
    n = len(data) - GRAM + 1
    value = range_hash(prefix, np.arange(n), np.arange(GRAM, len(data) + 1))
    place = np.arange(n, dtype=np.int32)
    size = 1
    while 2 * size <= SPAN:  # smallest of ever longer runs
        value, place = _least(value[:-size], place[:-size], value[size:], place[size:])
        size *= 2
    rest = SPAN - size
    if rest:
        value, place = _least(value[:-rest], place[:-rest], value[rest:], place[rest:])
    return place


def _least(v1, p1, v2, p2):
    right = v2 < v1
    return np.where(right, v2, v1), np.where(right, p2, p1)


def super_windows(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: h, c, doc, s (place in the text), n windows, a (anchor's offset)."""
    if len(data) < WIDTH:
        return {k: np.zeros(0, np.int64) for k in ("h", "c", "doc", "s", "n", "a")}
    prefix = prefix_hash(data)
    place = anchors(data, prefix)
    # windows that lie within one text
    inside = np.ones(len(place), bool)
    edge = offsets[1:-1]
    bad = np.zeros(len(place) + 1, np.int32)
    lo = np.clip(edge - WIDTH + 1, 0, len(place))
    np.add.at(bad, lo, 1)
    np.add.at(bad, np.clip(edge, 0, len(place)), -1)
    inside = np.cumsum(bad)[:-1] == 0
    new = np.empty(len(place), bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    if not len(start):
        return {k: np.zeros(0, np.int64) for k in ("h", "c", "doc", "s", "n", "a")}
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    at = place[start].astype(np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    return {"h": range_hash(prefix, at, at + GRAM).view(np.int64),
            "c": mix(range_hash(prefix, start, stop + WIDTH - 1) ^ _U(0x5DEECE66D)).view(np.int64),
            "doc": doc, "s": start - offsets[doc], "n": stop - start, "a": at - start}


def merged(ids: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [s, e) of window starts, adjacent or overlapping ones of an id joined."""
    if not len(ids):
        return ids, s, e
    order = np.lexsort((e, s, ids))
    ids, s, e = ids[order], s[order], e[order]
    # the furthest end so far, within an id
    _, group = np.unique(ids, return_inverse=True)
    lift = group.astype(np.int64) << 40
    far = np.maximum.accumulate(e + lift) - lift
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (s[1:] > far[:-1])
    first = np.flatnonzero(new)
    return ids[first], s[first], far[np.append(first[1:], len(ids)) - 1]


def _batch(h, c, ids, s, n, a) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(h, np.int64)), pa.array(np.asarray(c, np.int64)), pa.array(np.asarray(ids, np.int64)),
         *(pa.array(np.asarray(x, np.int32)) for x in (s, n, a))], ["h", "c", "id", "s", "n", "a"])


def _flags(ids, s, n) -> pa.RecordBatch:
    """Repeated windows as rows of the same schema: n below 0, dealt by id and place."""
    ids, s, e = merged(np.asarray(ids, np.int64), np.asarray(s, np.int64), np.asarray(s, np.int64) + n)
    h = mix(ids.view(_U) * _U(31) + s.view(_U))
    return _batch(h.view(np.int64), np.zeros(len(ids)), ids, s, s - e, np.zeros(len(ids)))


def _first_of_class(x: dict, ids: np.ndarray) -> np.ndarray:
    """True for the first (by id, place) of equal super-windows and rows that are the very same."""
    order = np.lexsort((x["s"], ids, x["c"], x["h"]))
    h, c, i, s = x["h"][order], x["c"][order], ids[order], x["s"][order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    first = np.empty(len(order), bool)
    first[order] = (i == i[head]) & (s == s[head])
    return first


def _cut(batches):
    """(id, text) -> super-windows that travel, and flags."""
    for batch in batches:
        offsets, data = common.string_parts(batch.column(1))
        ids = batch.column(0).to_numpy()
        for a, b in common.slices(offsets, SLICE_BYTES):
            own = offsets[a:b + 1]
            x = super_windows(own - own[0], data[own[0]:own[-1]])
            if not len(x["h"]):
                continue
            key = ids[a:b][x["doc"]]
            first = _first_of_class(x, key)
            yield _batch(*(y[first] for y in (x["h"], x["c"], key, x["s"], x["n"], x["a"])))
            if not first.all():
                yield _flags(key[~first], x["s"][~first], x["n"][~first])


def _meet(batches):
    """Sorted rows -> flags (n < 0) and first super-windows of anchors with several contents (n > 0)."""
    held = None  # the last first-of-class row; whether it was given out
    for batch in batches:
        col = {k: batch.column(i).to_numpy() for i, k in enumerate(("h", "c", "id", "s", "n", "a"))}
        passed = col["n"] < 0
        if passed.any():
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(passed)).columns, batch.schema.names)
            col = {k: v[~passed] for k, v in col.items()}
        if not len(col["h"]):
            continue
        if held is not None:
            col = {k: np.concatenate([[held[0][k]], v]) for k, v in col.items()}
        new = np.ones(len(col["h"]), bool)
        new[1:] = (col["h"][1:] != col["h"][:-1]) | (col["c"][1:] != col["c"][:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        repeat = ~new & ~((col["id"] == col["id"][head]) & (col["s"] == col["s"][head]))
        if repeat.any():
            yield _flags(col["id"][repeat], col["s"][repeat], col["n"][repeat])
        f = np.flatnonzero(new)
        h = col["h"][f]
        alike = h[1:] == h[:-1]
        several = np.append(False, alike) | np.append(alike, False)
        given = np.zeros(len(f), bool)
        given[0] = held is not None and held[1]
        out = f[several & ~given]
        if len(out):
            yield _batch(*(col[k][out] for k in ("h", "c", "id", "s", "n", "a")))
        held = {k: v[f[-1]] for k, v in col.items()}, bool(several[-1] or given[-1])


def compare(data, prefix, down, x, y) -> tuple[np.ndarray, np.ndarray]:
    """(x's suffix is less than y's, they agree in WIDTH bytes) by binary search on prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), WIDTH, np.int64)
    px, py, dx, dy = prefix[x], prefix[y], down[x], down[y]
    while True:  # they agree in lo bytes, and not in hi + 1
        open_ = lo < hi
        if not open_.any():
            break
        mid = (lo + hi + 1) >> 1
        same = (prefix[x + mid] - px) * dx == (prefix[y + mid] - py) * dy
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)
    equal = lo == WIDTH
    at = np.minimum(lo, WIDTH - 1)
    return ~equal & (data[x + at] < data[y + at]), equal


def merge_sort(data: np.ndarray, prefix: np.ndarray, group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``at`` within each group (groups are consecutive), all groups at once.

    Bottom-up: every element finds its place among the neighbouring run by
    binary search, so a level takes about log(run) comparisons an element.
    """
    _, down = powers(len(prefix))
    n = len(at)
    order = np.arange(n)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(begin, n))
    base, length = np.repeat(begin, size), np.repeat(size, size)
    inner = np.arange(n) - base
    width = 1
    while width < (size.max() if n else 0):
        run = inner // width
        sib = run ^ 1
        lo, hi = np.minimum(sib * width, length), np.minimum((sib + 1) * width, length)
        left, todo = lo.copy(), np.flatnonzero(lo < hi)
        top = hi.copy()
        while len(todo):
            mid = (left[todo] + top[todo]) >> 1
            own, other = at[order[todo]], at[order[base[todo] + mid]]
            less, equal = compare(data, prefix, down, other, own)
            before = less | (equal & (sib[todo] < run[todo]))  # the other stands before this one
            left[todo] = np.where(before, mid + 1, left[todo])
            top[todo] = np.where(before, top[todo], mid)
            todo = todo[left[todo] < top[todo]]
        place = base + np.minimum(run, sib) * width + (inner - run * width) + (left - lo)
        nxt = np.empty(n, np.int64)
        nxt[place] = order
        order = nxt
        width *= 2
    return order


def repeated_windows(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (h, id, s, n, a, bytes) of whole anchor groups -> (id, s, e) ranges of repeated window starts."""
    h = np.array([r[0] for r in rows], np.int64)
    ids, s, n, a = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))
    blob = b"".join(r[5] for r in rows)
    data = np.frombuffer(blob, np.uint8)
    start = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])])[:-1]
    prefix = prefix_hash(data)
    row = np.repeat(np.arange(len(rows)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    # windows of one anchor and offset stand together, in order of (id, place)
    _, dense = np.unique(h, return_inverse=True)
    group = dense[row] * (WIDTH + 1) + (a[row] - j)
    order = np.lexsort((s[row] + j, ids[row], group))
    row, j, group = row[order], j[order], group[order]
    at, key, place = start[row] + j, ids[row], s[row] + j
    ranked = merge_sort(data, prefix, group, at)
    x, y = at[ranked[:-1]], at[ranked[1:]]
    together = group[ranked[:-1]] == group[ranked[1:]]
    _, down = powers(len(prefix))
    same = np.zeros(len(x), bool)
    t = np.flatnonzero(together)
    same[t] = (prefix[x[t] + WIDTH] - prefix[x[t]]) * down[x[t]] == (prefix[y[t] + WIDTH] - prefix[y[t]]) * down[y[t]]
    t = np.flatnonzero(same)
    step = np.arange(WIDTH)
    wrong = np.zeros(len(x), bool)
    for k in range(0, len(t), 1 << 16):
        u = t[k:k + (1 << 16)]
        wrong[u] = (data[x[u][:, None] + step] != data[y[u][:, None] + step]).any(axis=1)
    flagged = np.zeros(len(at), bool)
    # ties keep the order of (id, place), so the first of a run of equals is the earliest
    later = ranked[1:][same]
    flagged[later] = True
    head = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(ranked)), 0)) if len(ranked) else ranked
    very_same = (key[ranked] == key[ranked[head]]) & (place[ranked] == place[ranked[head]])
    flagged[ranked[very_same]] = False
    for g in np.unique(group[ranked[1:][wrong]]) if wrong.any() else ():
        members = np.flatnonzero(group == g)  # a hash collision: plain comparison
        first: dict[bytes, tuple] = {}
        for m in members.tolist():
            first.setdefault(blob[at[m]:at[m] + WIDTH], (key[m], place[m]))
        for m in members.tolist():
            flagged[m] = first[blob[at[m]:at[m] + WIDTH]] != (key[m], place[m])
    return merged(key[flagged], place[flagged], place[flagged] + 1)


def _sort_groups(batches):
    """(h, id, s, n, a, bytes) sorted by h -> flags; an anchor's rows are handled together."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if size > SLICE_BYTES and held[-1][0] != r[0]:
                ids, s, e = repeated_windows(held)
                yield _flags(ids, s, e - s)
                held, size = [], 0
            held.append(r)
            size += len(r[5])
    if held:
        ids, s, e = repeated_windows(held)
        yield _flags(ids, s, e - s)


def _segments(batches):
    """(id, text, wanted) -> (h, id, s, n, a, bytes)."""
    for batch in batches:
        h, ids, s, n, a, out = [], [], [], [], [], []
        for i, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_buffer().to_pybytes()
            for w in wanted:
                h.append(w["h"]), ids.append(i), s.append(w["s"]), n.append(w["n"]), a.append(w["a"])
                out.append(raw[w["s"]:w["s"] + w["n"] + WIDTH - 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(ids, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32()),
             pa.array(a, pa.int32()), pa.array(out, pa.binary())], ["h", "id", "s", "n", "a", "bytes"])


def _windows(batches):
    """Segments of hot anchors -> one row a window: two hashes, id, place."""
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            data = np.frombuffer(r[5], np.uint8)
            p, at = prefix_hash(data), np.arange(r[3])
            one = range_hash(p, at, at + WIDTH)
            p = prefix_hash(data ^ 0x55)
            two = range_hash(p, at, at + WIDTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(r[3], r[1], np.int64)),
                 pa.array((r[2] + at).astype(np.int32))], ["w1", "w2", "id", "s"])


def flags(texts: DataFrame) -> DataFrame:
    """(id, text) -> (id, s, n): ranges of n window starts that repeat an earlier window."""
    texts = texts.where(F.col("id").isNotNull() & (F.octet_length("text") >= WIDTH))
    rows = texts.mapInArrow(_cut, ROW).repartition("h").sortWithinPartitions("h", "c", "id", "s")
    met = common.materialise(rows.mapInArrow(_meet, ROW), "op9-met")
    found = met.where("n < 0").select("id", "s", (-F.col("n")).alias("n"))
    need = met.where("n > 0").drop("c")

    wanted = need.groupBy("id").agg(F.collect_list(F.struct("h", "s", "n", "a")).alias("wanted"))  # bounded by the text
    pieces = texts.join(wanted, "id").select("id", "text", "wanted").mapInArrow(
        _segments, "h long, id long, s int, n int, a int, bytes binary")
    hot = common.materialise(need.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("h"), "op9-hot")
    flag_of = lambda df: df.where("n < 0").select("id", "s", (-F.col("n")).alias("n"))
    if hot.isEmpty():
        near = pieces.repartition("h").sortWithinPartitions("h", "id", "s").mapInArrow(_sort_groups, ROW)
        return found.unionByName(flag_of(near))
    pieces = common.materialise(pieces, "op9-pieces")
    near = pieces.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h", "id", "s").mapInArrow(_sort_groups, ROW)
    found = found.unionByName(flag_of(near))
    each = pieces.join(hot, "h", "left_semi").select("h", "id", "s", "n", "a", "bytes").mapInArrow(
        _windows, "w1 long, w2 long, id long, s int")
    each = common.materialise(each, "op9-windows")
    first = each.groupBy("w1", "w2").agg(F.min(F.struct("id", "s")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    again = each.join(first, ["w1", "w2"]).where(F.struct("id", "s") != F.col("first"))
    return found.unionByName(again.select("id", "s", F.lit(1).alias("n")))


def _remove(whole: bool):
    """Kernel: (id, text, ranges) -> the text without the bytes of repeated windows."""

    def run(batches):
        for batch in batches:
            size, gone, spans, digest, kept = [], [], [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                r = sorted(((x["s"], x["s"] + x["n"] + WIDTH - 1) for x in ranges or ()))
                out, at, lost, count = [], 0, 0, 0
                end = -1
                for s, e in r:
                    if s > end:  # a new run of removed bytes
                        count += 1
                        out.append(raw[at:s])
                    lost += max(0, e - max(s, end))
                    end = max(end, e)
                    at = end
                out.append(raw[at:])
                left = b"".join(out)
                size.append(len(raw)), gone.append(lost), spans.append(count)
                digest.append(hashlib.sha256(left).hexdigest()), kept.append(left)
            got = [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                   pa.array(digest, pa.string())]
            if whole:
                got.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(got, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:len(got)])

    return run


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), common.text_of(F.col(f"`{text_col}`")).alias("text"))
    ranges = flags(texts).distinct().groupBy("id").agg(F.collect_list(F.struct("s", "n")).alias("ranges"))
    joined = texts.join(ranges, "id", "left").select("id", "text", "ranges")
    fields = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInArrow(_remove(with_text), fields).withColumnRenamed("id", id_col)


def query(spark, sf_dir) -> DataFrame:
    return spans(common.documents(spark, sf_dir).select("doc_id", "text"))
