"""Deep trees and forests of many rows, with statistics that do not grow with the nodes.

Spark's fit sums dense statistics (features x bins x classes) of every open node in every task, pass by
pass.  Without a depth limit the open nodes grow with the rows, so memory, passes and shuffles grow, too.
Here only large nodes are split that way; the rest of a tree is grown where its rows are:

1. Values are cut into bins as Spark does (split candidates from a sample of rows), and rows are written in
   blocks of sparse bins.  Bins of zero are left out: their sums are the node's less those of the others.
2. Nodes whose rows are too many for a task are split level by level: tasks sum the bins of each node's drawn
   features, and the driver gets one row a node.  Their number is bounded by rows over ``GROUP_ENTRIES``.
3. The rows of every smaller node travel once, as blocks, to one task, which grows the node's subtree to its end.
   Where the whole table is as small as that, its blocks are broadcast instead and tasks grow trees.

The trees are those of the scripts' forests: gini gain over ``BINS`` bins, features drawn anew in each node,
Poisson bootstrap by a hash of (seed, tree, row), leaves of equal prediction merged.  Up to ``SPARK_ROWS`` rows
the estimator fits itself, so small tables give Spark's own trees.  The model is held whole by the driver and
each Python worker, in about 17 bytes a node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.session import remove_scratch, scratch_dir, ship_package

#: Tables of up to this many rows are fitted by Spark's estimators.
SPARK_ROWS = 2048
BLOCK_ROWS = 1024
#: Bins that are not zero's, of the rows of a node that one task grows to its end.
GROUP_ENTRIES = 4_000_000
#: Rows that split candidates are taken from, as in Spark.
SAMPLE_ROWS = 10_000
BINS = 32
#: Bytes of a node's rows as a matrix.
DENSE_BYTES = 160_000_000
#: Cells of (node, feature) that are marked at a time.
CELLS = 1 << 24
LEAST_GAIN = 1e-13
BLOCK = "block long, y binary, w binary, size binary, f binary, b binary"
DEALT = "g int, y binary, w binary, c binary, size binary, f binary, b binary"
GROWN = "g int, feature binary, cut binary, kid binary, stats binary, gain binary"
#: Node arrays of a tree.
KINDS = {"feature": np.int32, "cut": np.uint8, "kid": np.int32, "stats": np.float64, "gain": np.float64}
_U = np.uint64
#: Cumulated Poisson probabilities of rate 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def bag(rows: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often each row is drawn for a tree."""
    if not bootstrap:
        return np.ones(len(rows), np.int64)
    key = _mix(np.array([(seed * 1_000_003 + tree * 2 + 1) & (2**64 - 1)], _U))
    u = (_mix(_mix(rows.astype(_U) + key) ^ key) >> _U(11)).astype(np.float64) * 2.0 ** -53
    return np.searchsorted(POISSON, u, "right")


def entries(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of an Arrow column of ML vectors."""
    kind, _, indices, values = (column.field(i) for i in range(4))
    at = values.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    val = values.values.to_numpy()[at[0]:at[-1]]
    row = np.repeat(np.arange(len(column)), size)
    iat = indices.offsets.to_numpy()
    idx = indices.values.to_numpy()[iat[0]:iat[-1]].astype(np.int64)
    sparse = kind.to_numpy(zero_copy_only=False) == 0
    if not sparse.all():
        own, idx = idx, np.arange(len(val)) - np.repeat(at[:-1] - at[0], size)
        idx[sparse[row]] = own
    return row, idx, val


def candidates(values: np.ndarray, counts: np.ndarray, most: int) -> list[float]:
    """Thresholds of one feature from its sorted values: every middle, or about equal shares of the rows."""
    if len(values) - 1 <= most:
        return ((values[1:] + values[:-1]) / 2).tolist()
    stride = counts.sum() / (most + 1)
    out, now, target = [], float(counts[0]), stride
    for i in range(1, len(values)):
        before, now = now, now + counts[i]
        if abs(before - target) < abs(now - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return out[:most]


class Cuts:
    """Thresholds of every feature (padded with inf) and the bin of zero."""

    def __init__(self, at: np.ndarray):
        self.at = at
        self.zero = (at < 0).sum(axis=1).astype(np.uint8)

    def bins(self, f: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(f), np.uint8)
        for a in range(0, len(f), 1 << 17):
            out[a:a + (1 << 17)] = (v[a:a + (1 << 17), None] > self.at[f[a:a + (1 << 17)]]).sum(axis=1)
        return out

    def dense(self, rows: int, row: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.repeat(self.zero[None, :], rows, axis=0)
        out[row, f] = b
        return out


def cuts(vectors: DataFrame, d: int, n: int, seed: int) -> Cuts:
    """Split candidates from about ``SAMPLE_ROWS`` rows of one column of vectors."""
    sample = vectors if n <= SAMPLE_ROWS else vectors.sample(False, SAMPLE_ROWS / n, seed)

    def run(batches):
        for batch in batches:
            _, f, v = entries(batch.column(0))
            f, v = f[v != 0], v[v != 0]
            order = np.lexsort((v, f))
            f, v = f[order], v[order]
            first = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (v[1:] != v[:-1])])) if len(f) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(f[first], -1), pa.int32()), pa.array(np.append(v[first], 0.0)),
                 pa.array(np.append(np.diff(np.append(first, len(f))), batch.num_rows), pa.int64())], ["f", "v", "n"])

    got = sample.mapInArrow(run, "f int, v double, n long").groupBy("f", "v").agg(F.sum("n").alias("n")).toArrow()  # values of the sample
    f, v, c = (got.column(i).to_numpy() for i in range(3))
    rows = int(c[f == -1].sum())
    f, v, c = f[f >= 0], v[f >= 0], c[f >= 0]
    order = np.lexsort((v, f))
    f, v, c = f[order], v[order], c[order]
    at, start = np.full((d, BINS - 1), np.inf), np.searchsorted(f, np.arange(d + 1))
    for i in range(d):
        x, k = v[start[i]:start[i + 1]], c[start[i]:start[i + 1]]
        if rows > k.sum():
            p = np.searchsorted(x, 0.0)
            x, k = np.insert(x, p, 0.0), np.insert(k, p, rows - k.sum())
        own = candidates(x, k, BINS - 1)
        at[i, :len(own)] = own
    return Cuts(at)


# ---------------------------------------------------------------- one split

def summed(node, f, b, y, w, c, d: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums) of entries by (node, feature, bin): a weight a class, then the rows drawn."""
    key = (node.astype(np.int64) * d + f) * BINS + b
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return key, np.zeros((0, classes + 1))
    parts = [np.add.reduceat(np.where(y == k, w, 0.0)[order], first) for k in range(classes)]
    return key[first], np.stack([*parts, np.add.reduceat(c[order].astype(float), first)], axis=1)


def best_splits(key: np.ndarray, sums: np.ndarray, total: np.ndarray, zero: np.ndarray, d: int, least: int):
    """(feature or -1, bin, gain, sums of the left side) of every node, from the sums of bins that are not zero's.

    ``total`` has the nodes' own sums.  Ties go to the lower feature, then the lower bin.
    """
    n, k = len(total), total.shape[1] - 1
    feature, cut, gain, left = np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.zeros(n), np.zeros((n, k + 1))
    if not len(key):
        return feature, cut, gain, left
    group = key // BINS
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    rest = np.maximum(total[group[first] // d] - np.add.reduceat(sums, first, axis=0), 0.0)
    some = rest[:, k] > 0.5
    own = group[first][some]
    key = np.concatenate([key, own * BINS + zero[own % d]])
    order = np.argsort(key)
    key, sums = key[order], np.concatenate([sums, rest[some]])[order]
    group = key // BINS
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    run = np.cumsum(sums, axis=0)
    at = np.flatnonzero(fresh)
    run -= np.repeat(run[at] - sums[at], np.diff(np.append(at, len(key))), axis=0)
    node = group // d
    other = np.maximum(total[node] - run, 0.0)
    weight = total[:, :k].sum(axis=1)
    # sums of squares over weights, less those of the node: the gini gain times the node's weight
    a, z = run[:, :k].sum(axis=1), other[:, :k].sum(axis=1)
    ok = (run[:, k] >= least - 0.5) & (other[:, k] >= least - 0.5) & (a > 0) & (z > 0) & np.append(~fresh[1:], False)
    score = np.full(len(key), -np.inf)
    score[ok] = (run[ok, :k] ** 2).sum(axis=1) / a[ok] + (other[ok, :k] ** 2).sum(axis=1) / z[ok]
    score[ok] = (score[ok] - ((total[:, :k] ** 2).sum(axis=1) / weight)[node[ok]]) / weight[node[ok]]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    top = np.full(n, -np.inf)
    top[node[first]] = np.maximum.reduceat(score, first)
    hit = np.flatnonzero((score == top[node]) & (score > LEAST_GAIN))
    who, one = np.unique(node[hit], return_index=True)
    hit = hit[one]
    feature[who], cut[who], gain[who], left[who] = group[hit] % d, key[hit] % BINS, score[hit], run[hit]
    return feature, cut, gain, left


def drawn(rng: np.random.Generator, n: int, d: int, m: int) -> np.ndarray:
    """(n, m) features drawn for each of ``n`` nodes, in order."""
    out = np.empty((n, m), np.int32)
    step = max(1, (1 << 22) // d)
    for a in range(0, n, step):
        x = rng.random((min(step, n - a), d), dtype=np.float32)
        out[a:a + step] = np.argpartition(x, m - 1, axis=1)[:, :m]
    return np.sort(out, axis=1)


def marked(features: np.ndarray, d: int) -> np.ndarray:
    """(n, d) marks of drawn features."""
    out = np.zeros((len(features), d), bool)
    np.put_along_axis(out, features, True, axis=1)
    return out


def closed(total: np.ndarray, least: int) -> np.ndarray:
    """Nodes that are not split: one class only, or too few rows for two leaves."""
    return ((total[:, :-1] > 0).sum(axis=1) < 2) | (total[:, -1] < 2 * least - 0.5)


# ---------------------------------------------------------------- a subtree in one task

def grow(y, w, c, size, f, b, spec: dict, depth: int, key: tuple) -> dict:
    """The subtree of these rows, level by level: node arrays, the two children of a node side by side from ``kid`` on.

    Where a node draws few features, they are looked up in a dense matrix; else all entries are gone through.
    """
    d, k, least, zero, m = spec["d"], spec["classes"], spec["least"], spec["zero"], spec["drawn"]
    w = w * c
    row, f = np.repeat(np.arange(len(y), dtype=np.int32), size), f.astype(np.int32)
    look = _Dense if m * len(y) <= len(f) and len(y) * d <= DENSE_BYTES else _Sparse
    held = look(len(y), row, f, b, spec)
    node, n, done, out = np.zeros(len(y), np.int32), 1, 0, []
    rng = np.random.default_rng([spec["seed"] & (2**63 - 1), *key])
    while n:
        total = np.stack([*(np.bincount(node, np.where(y == i, w, 0.0), n) for i in range(k)), np.bincount(node, c, n)], axis=1)
        feature, cut, gain, kid = np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.zeros(n), np.full(n, -1, np.int32)
        open_ = ~closed(total, least) if depth < spec["depth"] else np.zeros(n, bool)
        live, more = np.flatnonzero(open_), 0
        if len(live):
            keep = open_[node]
            held.keep(keep)
            y, w, c, node = y[keep], w[keep], c[keep], (np.cumsum(open_, dtype=np.int32) - 1)[node[keep]]
            step = max(1, CELLS // d)
            for a in range(0, len(live), step):
                own = live[a:a + step]
                r, e, v = held.of(node, a, a + len(own), drawn(rng, len(own), d, m) if m < d else None)
                best = best_splits(*summed(node[r] - a, e, v, y[r], w[r], c[r], d, k), total[own], zero, d, least)
                feature[own], cut[own], gain[own] = best[:3]
            has = feature[live] >= 0
            more = 2 * int(has.sum())
            kid[live[has]] = done + n + np.arange(0, more, 2)
            right = held.bins(np.maximum(feature[live], 0)[node]) > cut[live][node]
            keep = has[node]
            held.keep(keep)
            node = (2 * (np.cumsum(has) - 1)[node] + right).astype(np.int32)[keep]
            y, w, c = y[keep], w[keep], c[keep]
        out.append((feature, cut, kid, total, gain))
        done, n, depth = done + n, more, depth + 1
    return dict(zip(("feature", "cut", "kid", "stats", "gain"), (np.concatenate(x) for x in zip(*out))))


class _Dense:
    """Rows as a matrix of bins, of which rows that are left are numbers."""

    def __init__(self, n: int, row, f, b, spec: dict):
        self.d, self.zero = spec["d"], spec["zero"]
        x = np.repeat(self.zero[None, :], n, axis=0)
        x[row, f] = b
        self.x, self.at = x.ravel(), np.arange(n, dtype=np.int64) * self.d

    def keep(self, keep: np.ndarray) -> None:
        self.at = self.at[keep]

    def of(self, node: np.ndarray, a: int, z: int, features: np.ndarray):
        """(row, feature, bin) where a drawn feature of the row's node, of nodes ``a`` to ``z``, is not in zero's bin."""
        m, out, zeros = features.shape[1], [], self.zero[features]
        for i in range(0, len(node), 4096):
            rows = i + np.flatnonzero((node[i:i + 4096] >= a) & (node[i:i + 4096] < z))
            own = features[node[rows] - a]
            got = self.x[self.at[rows][:, None] + own]
            hit = np.flatnonzero(got != (zeros[node[rows] - a] if self.zero.any() else 0))
            out.append((rows[hit // m], own.ravel()[hit], got.ravel()[hit]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def bins(self, feature: np.ndarray) -> np.ndarray:
        return self.x[self.at + feature]


class _Sparse:
    """Rows as their entries; those of dropped rows go when they are many."""

    def __init__(self, n: int, row, f, b, spec: dict):
        self.d, self.zero = spec["d"], spec["zero"]
        self.row, self.f, self.b = row, f, b
        self.number, self.n = np.arange(n, dtype=np.int32), n

    def keep(self, keep: np.ndarray) -> None:
        """``number`` leads from the rows that entries name to those that are left, or -1."""
        new = np.append(np.where(keep, np.cumsum(keep, dtype=np.int32) - 1, -1), -1).astype(np.int32)
        self.number = new[self.number]
        self.n = int(keep.sum())
        if self.n < 0.8 * len(self.number):
            row = self.number[self.row]
            of = np.flatnonzero(row >= 0)
            self.row, self.f, self.b, self.number = row[of], self.f[of], self.b[of], np.arange(self.n, dtype=np.int32)

    def of(self, node: np.ndarray, a: int, z: int, features: np.ndarray | None):
        at = np.append(np.where((node >= a) & (node < z), node - a, z - a), z - a).astype(np.int32)[self.number][self.row]
        if features is None:
            pick = np.flatnonzero(at < z - a)
        else:
            marks = np.concatenate([marked(features, self.d), np.zeros((1, self.d), bool)]).ravel()  # a last row for other rows
            pick = np.flatnonzero(marks[at * np.int32(self.d) + self.f])
        return self.number[self.row[pick]], self.f[pick], self.b[pick]

    def bins(self, feature: np.ndarray) -> np.ndarray:
        out = self.zero[feature]
        own = np.append(feature, -1).astype(np.int32)[self.number]
        pick = np.flatnonzero(self.f == own[self.row])
        out[self.number[self.row[pick]]] = self.b[pick]
        return out


def pruned(tree: dict) -> dict:
    """The tree with sibling leaves of equal prediction merged, as Spark's models are, in order of depth."""
    feature, kid = tree["feature"].copy(), tree["kid"].copy()
    says = tree["stats"][:, :-1].argmax(axis=1)
    levels, now = [], np.zeros(1, np.int64)
    while len(now):
        levels.append(now)
        inner = kid[now[kid[now] >= 0]].astype(np.int64)
        now = np.stack([inner, inner + 1], axis=1).ravel()
    for now in reversed(levels):
        inner = now[kid[now] >= 0]
        a = kid[inner]
        merged = inner[(kid[a] < 0) & (kid[a + 1] < 0) & (says[a] == says[a + 1])]
        feature[merged], kid[merged] = -1, -1
    order, now = [], np.zeros(1, np.int64)
    while len(now):
        order.append(now)
        inner = kid[now[kid[now] >= 0]].astype(np.int64)
        now = np.stack([inner, inner + 1], axis=1).ravel()
    order = np.concatenate(order)
    number = np.zeros(len(kid), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    kid = kid[order]
    kid[kid >= 0] = number[kid[kid >= 0]]
    return {"feature": feature[order], "kid": kid, **{x: tree[x][order] for x in ("cut", "stats", "gain")}}


# ---------------------------------------------------------------- the fit

def _pack(*arrays) -> list[bytes]:
    return [np.ascontiguousarray(x).tobytes() for x in arrays]


def _wide(d: int):
    return np.uint16 if d <= 1 << 16 else np.int32


def blocks(rows: DataFrame, cut: Cuts, d: int, n: int, path: str) -> DataFrame:
    """(label, weight, vector) rows (about ``n``) as blocks of sparse bins, written once, in files for every core."""
    shared = rows.sparkSession.sparkContext.broadcast(cut)

    def run(batches):
        cut, k = shared.value, TaskContext.get().partitionId() << 24
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                row, f, v = entries(part.column(2))
                b = cut.bins(f, v)
                keep = b != cut.zero[f]
                size = np.bincount(row[keep], minlength=part.num_rows).astype(np.int32)
                yield pa.RecordBatch.from_pylist([dict(zip(("block", "y", "w", "size", "f", "b"), (k, *_pack(
                    part.column(0).to_numpy().astype(np.int32), part.column(1).to_numpy(), size, f[keep].astype(_wide(d)), b[keep]))))],
                    pa.schema([("block", pa.int64()), *((x, pa.binary()) for x in ("y", "w", "size", "f", "b"))]))
                k += 1

    files = max(2 * rows.sparkSession.sparkContext.defaultParallelism, n // (32 * BLOCK_ROWS))
    rows.mapInArrow(run, BLOCK).repartition(files).write.parquet(path)
    return rows.sparkSession.read.schema(BLOCK).parquet(path)


def _opened(batch: pa.RecordBatch, d: int):
    """(row keys, y, w, size, row of each entry, f, b) of every block of a batch."""
    for i in range(batch.num_rows):
        at, y, w, size, f, b = (batch.column(j)[i].as_py() for j in range(6))
        y, w, size = np.frombuffer(y, np.int32), np.frombuffer(w), np.frombuffer(size, np.int32)
        yield (at * BLOCK_ROWS + np.arange(len(y)), y, w, size, np.repeat(np.arange(len(y)), size),
               np.frombuffer(f, _wide(d)), np.frombuffer(b, np.uint8))


def _reached(top: dict, x: np.ndarray) -> np.ndarray:
    """The node of a tree's top where each row of ``x`` (dense bins) stops."""
    at = np.zeros(len(x), np.int64)
    moving = np.flatnonzero(top["kid"][at] >= 0)
    while len(moving):
        node = at[moving]
        at[moving] = top["kid"][node] + (x[moving, top["feature"][node]] > top["cut"][node])
        moving = moving[top["kid"][at[moving]] >= 0]
    return at


class _Tops:
    """The trees so far on the driver: nodes with their sums, and which of them are too large for a task."""

    def __init__(self, trees: int):
        self.trees = [{"feature": [-1], "cut": [0], "kid": [-1], "stats": [None], "gain": [0.0], "depth": [0]} for _ in range(trees)]

    def arrays(self) -> list[dict]:
        return [{"feature": np.array(t["feature"], np.int32), "cut": np.array(t["cut"], np.uint8), "kid": np.array(t["kid"], np.int32)}
                for t in self.trees]

    def split(self, t: int, i: int, feature: int, cut: int, gain: float, total, left) -> list[int]:
        own = self.trees[t]
        own["stats"][i] = total
        if feature < 0:
            return []
        at = len(own["kid"])
        own["feature"][i], own["cut"][i], own["gain"][i], own["kid"][i] = feature, cut, gain, at
        for side in (left, np.maximum(total - left, 0.0)):
            for name, v in (("feature", -1), ("cut", 0), ("kid", -1), ("stats", side), ("gain", 0.0), ("depth", own["depth"][i] + 1)):
                own[name].append(v)
        return [at, at + 1]


def split_large(held: DataFrame, spec: dict, tops: _Tops, large: list[tuple[int, int]], level: int) -> None:
    """One pass: the best splits of the nodes (tree, node) of ``large``."""
    d, k = spec["d"], spec["classes"]
    number: dict[int, dict[int, int]] = {}
    for g, (t, i) in enumerate(large):
        number.setdefault(t, {})[i] = g
    marks = None
    if spec["drawn"] < d:
        rng = np.random.default_rng([spec["seed"] & (2**63 - 1), level, 0, 1])
        marks = np.packbits(marked(drawn(rng, len(large), d, spec["drawn"]), d), axis=1)
    shared = held.sparkSession.sparkContext.broadcast((spec, tops.arrays(), number, marks))
    names = [f"s{i}" for i in range(k + 1)]

    def run(batches):
        spec, trees, number, marks = shared.value
        cut = Cuts(spec["cuts"])
        for batch in batches:
            for rows, y, w, _, row, f, b in _opened(batch, d):
                x = cut.dense(len(y), row, f, b)
                f = f.astype(np.int64)
                for t, of in number.items():
                    c = bag(rows, t, spec["seed"], spec["bootstrap"])
                    which = np.full(len(trees[t]["kid"]), -1)
                    which[list(of)] = list(of.values())
                    g = np.where(c > 0, which[_reached(trees[t], x)], -1)
                    at = g[row]
                    pick = np.flatnonzero(at >= 0)
                    if marks is not None:
                        e = f[pick]
                        pick = pick[(marks[at[pick], e >> 3] >> (7 - (e & 7))) & 1 == 1]
                    r = row[pick]
                    key, sums = summed(at[pick], f[pick], b[pick], y[r], (w * c)[r], c[r], d, k)
                    own = np.flatnonzero(g >= 0)
                    nodes, inverse = np.unique(g[own], return_inverse=True)
                    total = [np.bincount(inverse, np.where(y[own] == i, (w * c)[own], 0.0), len(nodes)) for i in range(k)]
                    total = np.stack([*total, np.bincount(inverse, c[own], len(nodes))], axis=1)
                    # a node's own sums have the feature -1
                    cols = [np.append(key // BINS // d, nodes), np.append(key // BINS % d, np.full(len(nodes), -1)),
                            np.append(key % BINS, np.zeros(len(nodes), np.int64))]
                    sums = np.concatenate([sums, total])
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in cols), *(pa.array(sums[:, i]) for i in range(k + 1))],
                                                     ["g", "f", "b", *names])

    sums = held.mapInArrow(run, "g int, f int, b int, " + ", ".join(f"{x} double" for x in names))
    sums = sums.groupBy("g", "f", "b").agg(*[F.sum(x).alias(x) for x in names])

    def choose(table: pa.Table) -> pa.Table:
        g, f, b = (table.column(i).to_numpy() for i in range(3))
        s = np.stack([table.column(x).to_numpy() for x in names], axis=1)
        total = s[f < 0]
        key = f[f >= 0].astype(np.int64) * BINS + b[f >= 0]
        order = np.argsort(key)
        cut = Cuts(shared.value[0]["cuts"])
        feature, at, gain, left = best_splits(key[order], s[f >= 0][order], total, cut.zero, d, spec["least"])
        return pa.table({"g": pa.array(g[:1], pa.int32()), "f": pa.array(feature, pa.int32()), "b": pa.array(at, pa.int32()), "gain": gain,
                         "total": pa.array(total.tolist(), pa.list_(pa.float64())), "left": pa.array(left.tolist(), pa.list_(pa.float64()))})

    out = "g int, f int, b int, gain double, total array<double>, left array<double>"
    for r in sums.groupBy("g").applyInArrow(choose, out).collect():  # one row a large node
        t, i = large[r["g"]]
        tops.split(t, i, r["f"], r["b"], r["gain"], np.array(r["total"]), np.array(r["left"]))


def _sent(g: int, tree: dict) -> pa.RecordBatch:
    tree = pruned(tree)
    return pa.RecordBatch.from_pylist([dict(zip(("g", *KINDS), (g, *_pack(*(tree[x] for x in KINDS)))))],
                                      pa.schema([("g", pa.int32()), *((x, pa.binary()) for x in KINDS)]))


def grown(held: DataFrame, spec: dict, tops: _Tops, small: list[tuple[int, int]], path: str) -> DataFrame:
    """(g, node arrays) of the subtrees below the nodes (tree, node) of ``small``: their rows meet in one task."""
    d = spec["d"]
    number: dict[int, dict[int, int]] = {}
    for g, (t, i) in enumerate(small):
        number.setdefault(t, {})[i] = g
    depths = [tops.trees[t]["depth"][i] for t, i in small]
    shared = held.sparkSession.sparkContext.broadcast((spec, tops.arrays(), number, small, depths))
    names = ("y", "w", "c", "size", "f", "b")
    dealt = pa.schema([("g", pa.int32()), *((x, pa.binary()) for x in names)])

    def deal(batches):
        spec, trees, number, *_ = shared.value
        cut = Cuts(spec["cuts"])
        for batch in batches:
            for rows, y, w, size, row, f, b in _opened(batch, d):
                deep = any(len(t["kid"]) > 1 for t in trees)
                x = cut.dense(len(y), row, f, b) if deep else np.zeros((len(y), 0), np.uint8)
                start = np.cumsum(size) - size
                for t, of in number.items():
                    c = bag(rows, t, spec["seed"], spec["bootstrap"])
                    which = np.full(len(trees[t]["kid"]), -1)
                    which[list(of)] = list(of.values())
                    g = np.where(c > 0, which[_reached(trees[t], x)], -1)
                    order = np.argsort(g, kind="stable")
                    order = order[g[order] >= 0]
                    first = np.flatnonzero(np.concatenate([[True], np.diff(g[order]) > 0])) if len(order) else []
                    got = []
                    for own in np.split(order, first[1:]) if len(order) else []:
                        n = size[own]
                        at = np.arange(n.sum()) + np.repeat(start[own] - (np.cumsum(n) - n), n)
                        got.append(dict(zip(("g", *names), (int(g[own[0]]), *_pack(y[own], w[own], c[own].astype(np.uint8), n, f[at], b[at])))))
                    if got:
                        yield pa.RecordBatch.from_pylist(got, dealt)

    def finish(batches):
        spec, _, _, small, depths = shared.value
        spec = {**spec, "zero": Cuts(spec["cuts"]).zero}
        kinds = (np.int32, np.float64, np.uint8, np.int32, _wide(d), np.uint8)
        parts, now = [], None

        def tree():
            y, w, c, size, f, b = (np.concatenate([p[i] for p in parts]) for i in range(6))
            parts.clear()
            return _sent(now, grow(y, w, c.astype(np.int64), size, f, b, spec, depths[now], (*small[now], 0)))

        for batch in batches:
            for i in range(batch.num_rows):
                g = batch.column(0)[i].as_py()
                if parts and g != now:
                    yield tree()
                now = g
                parts.append([np.frombuffer(batch.column(j + 1)[i].as_py(), kind) for j, kind in enumerate(kinds)])
        if parts:
            yield tree()

    tasks = min(len(small), max(256, len(small) // 4))
    met = held.mapInArrow(deal, DEALT).repartition(tasks, "g").sortWithinPartitions("g")
    met.mapInArrow(finish, GROWN).write.parquet(path)
    return held.sparkSession.read.schema(GROWN).parquet(path)


def grown_from_all(held: DataFrame, spec: dict, trees: int, path: str) -> DataFrame:
    """``grown`` for whole trees of rows that fit a task: all blocks go to every worker, and none is shuffled tree by tree."""
    d, spark = spec["d"], held.sparkSession
    rows = held.orderBy("block").toArrow()  # at most GROUP_ENTRIES and what trees leave out
    shared = spark.sparkContext.broadcast((spec, rows.to_batches()))

    def run(batches):
        spec, rows = shared.value
        spec = {**spec, "zero": Cuts(spec["cuts"]).zero}
        keys, y, w, size, _, f, b = (np.concatenate(x) for x in zip(*(r for batch in rows for r in _opened(batch, d))))
        for batch in batches:
            for t in batch.column(0).to_pylist():
                c = bag(keys, t, spec["seed"], spec["bootstrap"])
                own = c > 0
                of = np.repeat(own, size)
                yield _sent(t, grow(y[own], w[own], c[own], size[own], f[of], b[of], spec, 0, (t, 0, 0)))

    ids = spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism))
    ids.mapInArrow(run, GROWN).write.parquet(path)
    return spark.read.schema(GROWN).parquet(path)


def drawn_features(rule: str, d: int, trees: int) -> int:
    """How many features a node looks at."""
    if rule == "auto":
        rule = "sqrt" if trees > 1 else "all"
    return {"sqrt": math.ceil(math.sqrt(d)), "log2": max(1, math.ceil(math.log2(d))), "onethird": math.ceil(d / 3), "all": d}[rule]


def fit(est, rows: DataFrame, n: int):
    """A model of a tree or forest estimator on ``rows`` (about ``n``): by the estimator itself, or grown here."""
    if n <= SPARK_ROWS:
        return est.fit(rows)
    spark = rows.sparkSession
    ship_package(spark)
    forest = isinstance(est, RandomForestClassifier)
    weight = F.col(est.getWeightCol()).cast("double") if est.isSet("weightCol") else F.lit(1.0)
    rows = rows.select(F.col(est.getLabelCol()).cast("int").alias("y"), weight.alias("w"), F.col(est.getFeaturesCol()).alias("x"))
    trees = est.getNumTrees() if forest else 1
    classes = max(2, 1 + rows.agg(F.max("y")).first()[0])
    d = len(rows.select("x").first()[0])
    cut = cuts(rows.select("x"), d, n, est.getSeed())
    spec = {"d": d, "classes": classes, "cuts": cut.at, "seed": est.getSeed(), "least": est.getMinInstancesPerNode(), "depth": est.getMaxDepth(),
            "bootstrap": forest and est.getBootstrap(), "drawn": drawn_features(est.getFeatureSubsetStrategy(), d, trees) if forest else d}
    paths = [scratch_dir(spark, "forest-rows"), scratch_dir(spark, "forest-trees")]
    held = blocks(rows, cut, d, n, paths[0])
    size = held.agg(F.sum(F.length("b")).alias("e"), F.sum(F.length("y") / 4).alias("n")).first()
    most = max(SPARK_ROWS, int(GROUP_ENTRIES * size["n"] / max(1, size["e"])))
    tops, small, level = _Tops(trees), [], 0
    # a row may be drawn more than once: its entries are held once
    share = 1 - math.exp(-1) if spec["bootstrap"] else 1.0
    large = [(t, 0) for t in range(trees)]
    whole = size["n"] * share <= most
    if whole:
        large, small = [], large
    while large:
        split_large(held, spec, tops, large, level)
        kids = [(t, j) for t, i in large if (at := tops.trees[t]["kid"][i]) >= 0 for j in (at, at + 1)]
        large, level = [], level + 1
        for t, i in kids:
            total = tops.trees[t]["stats"][i]
            if level < spec["depth"] and not closed(total[None, :], spec["least"])[0]:
                (large if total[-1] * share > most else small).append((t, i))
    trees_ = [{**a, "stats": t["stats"], "gain": np.array(t["gain"])} for a, t in zip(tops.arrays(), tops.trees)]
    below: dict[int, list] = {t: [] for t in range(trees)}
    if small:
        below_ = grown_from_all(held, spec, trees, paths[1]) if whole else grown(held, spec, tops, small, paths[1])
        for r in below_.toLocalIterator():
            t, i = small[r["g"]]
            below[t].append((i, {x: np.frombuffer(r[x], kind) for x, kind in KINDS.items()}))
    out = [joined(trees_[t], below.pop(t), classes) for t in range(trees)]
    for p in paths:
        remove_scratch(p)
    model = ForestModel(out, cut.at, classes)
    return model._set(featuresCol=est.getFeaturesCol())


def joined(top: dict, parts: list[tuple[int, dict]], classes: int) -> dict:
    """One tree of its top and the subtrees below nodes of it."""
    width = classes + 1
    top = {**top, "stats": np.array([np.zeros(width) if s is None else s for s in top["stats"]]).reshape(-1, width)}
    cols = {x: [top[x].copy()] for x in ("feature", "cut", "kid", "stats", "gain")}
    done = len(top["kid"])
    for i, sub in parts:
        stats = sub["stats"].reshape(-1, width)
        kid = np.where(sub["kid"] >= 0, sub["kid"] - 1 + done, -1).astype(np.int32)
        for name, own in (("feature", sub["feature"]), ("cut", sub["cut"]), ("kid", kid), ("stats", stats), ("gain", sub["gain"])):
            cols[name][0][i] = own[0]
            cols[name].append(own[1:])
        done += len(kid) - 1
    return pruned({name: np.concatenate(v) for name, v in cols.items()})


# ---------------------------------------------------------------- the model

class ForestModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, MLWritable, MLReadable):
    """Trees with thresholds; ``transform`` adds class probabilities (the mean over the trees) and the first largest class."""

    def __init__(self, trees: list[dict] | None = None, at: np.ndarray | None = None, classes: int = 2):
        super().__init__()
        self.trees, self.at, self.classes = trees or [], at, classes

    @property
    def numFeatures(self) -> int:
        return len(self.at)

    @property
    def totalNumNodes(self) -> int:
        return sum(len(t["kid"]) for t in self.trees)

    @property
    def featureImportances(self):
        """Gains times weights of nodes, as shares of each tree, then of the forest."""
        out = np.zeros(len(self.at))
        for t in self.trees:
            own, inner = np.zeros(len(self.at)), t["kid"] >= 0
            np.add.at(own, t["feature"][inner], t["gain"][inner] * t["stats"][inner, :-1].sum(axis=1))
            out += own / own.sum() if own.sum() > 0 else own
        return Vectors.dense(out / out.sum() if out.sum() > 0 else out)

    def packed(self) -> dict:
        """All trees in one set of arrays; leaves have a row of ``share``, found through -2 - ``kid``."""
        roots, feature, cut, kid, share, n, leaves = [], [], [], [], [], 0, 0
        for t in self.trees:
            leaf = t["kid"] < 0
            roots.append(n)
            own = t["kid"] + n
            own[leaf] = -2 - leaves - np.arange(leaf.sum())
            s = t["stats"][leaf, :-1]
            for out, x in ((feature, np.maximum(t["feature"], 0)), (cut, t["cut"]), (kid, own.astype(np.int32)),
                           (share, s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300))):
                out.append(x)
            n, leaves = n + len(leaf), leaves + len(s)
        return {"roots": np.array(roots), "at": self.at, **{k: np.concatenate(v) for k, v in (
            ("feature", feature), ("cut", cut), ("kid", kid), ("share", share))}}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        shared = dataset.sparkSession.sparkContext.broadcast(self.packed())

        @F.arrow_udf("array<double>")
        def score(x: pa.Array) -> pa.Array:
            p = shared.value
            out = [probabilities(p, x.slice(a, BLOCK_ROWS)) for a in range(0, len(x), BLOCK_ROWS)]
            return pa.array([row for part in out for row in part.tolist()], pa.list_(pa.float64()))

        p = F.col("_shares")
        out = dataset.withColumn("_shares", score(F.col(self.getFeaturesCol())))
        return out.withColumns({self.getProbabilityCol(): array_to_vector(p),
                                self.getPredictionCol(): (F.array_position(p, F.array_max(p)) - 1).cast("double")}).drop("_shares")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()


def probabilities(p: dict, column: pa.StructArray) -> np.ndarray:
    """Class probabilities of the vectors of an Arrow column by the arrays of ``ForestModel.packed``."""
    cut = Cuts(p["at"])
    row, f, v = entries(column)
    x = cut.dense(len(column), row, f, cut.bins(f, v))
    n = len(column)
    total = np.zeros((n, p["share"].shape[1]))
    step = max(1, (1 << 18) // max(1, n))
    for a in range(0, len(p["roots"]), step):
        roots = p["roots"][a:a + step]
        who, at = np.tile(np.arange(n), len(roots)), np.repeat(roots, n)
        while len(at):
            kid = p["kid"][at]
            leaf = kid < 0
            if leaf.any():
                s = p["share"][-2 - kid[leaf]]
                for k in range(s.shape[1]):
                    total[:, k] += np.bincount(who[leaf], s[:, k], n)
                who, at, kid = who[~leaf], at[~leaf], kid[~leaf]
            at = kid + (x[who, p["feature"][at]] > p["cut"][at])
    return total / len(p["roots"])


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"classes": self.model.classes})
        rows = [(i, *_pack(*(np.asarray(t[x], kind) for x, kind in KINDS.items()))) for i, t in enumerate(self.model.trees)]
        self.sparkSession.createDataFrame(rows, "tree int, " + ", ".join(f"{x} binary" for x in KINDS)).write.parquet(f"{path}/trees")
        self.sparkSession.createDataFrame([(bytearray(self.model.at.tobytes()), len(self.model.at))], "at binary, d int").write.parquet(f"{path}/cuts")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        classes = metadata["classes"]
        at = self.sparkSession.read.parquet(f"{path}/cuts").first()
        trees = {}
        for r in self.sparkSession.read.parquet(f"{path}/trees").toLocalIterator():
            t = {x: np.frombuffer(r[x], kind).copy() for x, kind in KINDS.items()}
            trees[r["tree"]] = {**t, "stats": t["stats"].reshape(-1, classes + 1)}
        model = ForestModel([trees[i] for i in sorted(trees)], np.frombuffer(at["at"]).reshape(at["d"], -1), classes)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


#: Estimators that ``fit`` takes.
ESTIMATORS = (DecisionTreeClassifier, RandomForestClassifier)
