"""Exact k nearest neighbours with a two-level tree of cells.

About sqrt(n) reference rows, drawn by hash, are the centres of leaf cells; the
first of them are also top nodes, about the square root of the leaves, and each
leaf hangs under its nearest top node.  A reference goes down the tree to one
leaf, within its group.  Leaves and top nodes keep the ring (least and greatest
distance to their centre) of what they hold, for each group.

A query first meets the nearest leaves that hold k references under its nearest
top node; the k-th distance found there bounds the rest.  A top node, and then a
leaf, is skipped if its ring cannot hold anything nearer (triangle inequality) or
if all of it lies too far behind the plane between its centre and the centre
nearest to the query, which would have taken anything on this side.  A query travels once to each leaf that may matter: how many depends on
the data (few where they are clustered or low-dimensional, up to all of them
where distances hardly differ).  It travels once to each *bin*, with the list of the
leaves there: bins are runs of neighbouring leaves with an eighth of the references,
at least ``lurescan.knn.blockRows`` (default 2048) and at most ``lurescan.knn.cellRows``
(default 32768).  So a query is copied once per bin at most, however many leaves it meets.

Bins and queries meet through an equi-key ``cogroup`` with at most a bin's rows of
either side in a task's group.  Larger leaves and busier bins are split by hash
into several groups.  Each group compares a query with the leaves on its list only
and emits its k best per query, and a window per query merges them.  Cosine distances are searched on unit vectors
(chord length is a metric); the distance reported is the usual one.

The driver holds the centres, at most ``lurescan.knn.treeBytes`` (default 64 MB,
which is 30,000 leaves of 256 columns), and one row per group and leaf.  With
more references the leaves grow, not the tree.

Ties are broken by the neighbour id, so results are deterministic.  A zero
vector is at cosine distance 1 from everything.  Rows with a null group, vector
or id take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescan.session import ensure_checkpoint_dir, scratch_dir

OUT_SCHEMA = "qid long, nid long, dist double"
ASKED_SCHEMA = "g string, bin int, qid long, qv array<double>, leaves array<int>"
BINS = 8
PLACED_SCHEMA = "g string, nid long, nv array<double>, leaf int, dist double, top_dist double"
DEFAULT_BLOCK_ROWS = 2048
DEFAULT_CELL_ROWS = 32768
DEFAULT_TREE_BYTES = 64 << 20
#: Distances to centres come from a matrix product; bounds are widened by its rounding, relative to the largest norms.
SLACK = 1e-6
SQUARE_SLACK = 1e-11
STEP = 4096


def _search_form(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in which the metric is a chord: unit vectors for cosine, zero vectors on an axis of their own."""
    if metric != "cosine":
        return x
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
    return np.concatenate([unit, (norm == 0).astype(float)[:, None]], axis=1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, a few rows at a time."""
    d = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for i in range(0, len(x), step):
        diff = y[None, :, :] - x[i:i + step, None, :]
        d[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return d


def _rough(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by a matrix product, right up to rounding (see ``SLACK``)."""
    d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d2, 0))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _least(d: np.ndarray, nid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least entries of every row, ties by id; only entries up to the k-th value are sorted."""
    if d.shape[1] <= k:
        row, col = np.divmod(np.arange(d.size), d.shape[1])
    else:
        row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1:k])
    order = np.lexsort((nid[row, col], d[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _compare(qm: np.ndarray, rm: np.ndarray) -> np.ndarray:
    """Cosine distances."""
    norm = np.sqrt(np.einsum("ij,ij->i", qm, qm))[:, None] * np.sqrt(np.einsum("ij,ij->i", rm, rm))[None, :]
    return 1.0 - np.divide(qm @ rm.T, norm, out=np.zeros_like(norm), where=norm > 0)


def _closest(qm: np.ndarray, rm: np.ndarray, nid: np.ndarray, self_: np.ndarray | None, bound: np.ndarray, k: int):
    """(row, column, distance) of the k least Euclidean distances of every row that may be within ``bound``, ties by id.

    A matrix product rules out all but a few pairs; distances of these are by differences.
    """
    qq, rr = np.einsum("ij,ij->i", qm, qm), np.einsum("ij,ij->i", rm, rm)
    d2 = qm @ rm.T
    d2 *= -2
    d2 += qq[:, None]
    d2 += rr[None, :]
    if self_ is not None:
        d2[self_] = np.inf
    slack = SQUARE_SLACK * (qq + rr.max())
    most = bound ** 2 + slack
    if d2.shape[1] > k and not np.isfinite(most).all():
        most = np.minimum(most, np.partition(d2, k - 1, axis=1)[:, k - 1] + 2 * slack)
    row, col = np.nonzero((d2 <= most[:, None]) & np.isfinite(d2))
    d = np.empty(len(row))
    step = max(1, (1 << 22) // max(1, qm.shape[1]))
    for i in range(0, len(row), step):
        diff = (rm[col[i:i + step]] - qm[row[i:i + step]])[:, None, :]
        d[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))[:, 0]
    order = np.lexsort((nid[col], d, row))
    row, col, d = row[order], col[order], d[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first], d[first]


def _block_topk(left: pd.DataFrame, right: pd.DataFrame, k: int, metric: str, exclude_self: bool) -> pd.DataFrame:
    """The k best references of every query of a group, among the leaves on its list; over slices of both."""
    none = pd.DataFrame({"qid": pd.Series([], dtype="int64"), "nid": pd.Series([], dtype="int64"),
                         "dist": pd.Series([], dtype="float64")})
    if left.empty or right.empty:
        return none
    qm, qid = _stack(left["qv"]), left["qid"].to_numpy(dtype=np.int64)
    rm, nid = _stack(right["nv"]), right["nid"].to_numpy(dtype=np.int64)
    lists = left["leaves"].to_numpy()
    asks = np.repeat(np.arange(len(left)), [len(x) for x in lists])
    asked = np.concatenate(lists)
    order = np.argsort(asked, kind="stable")
    asks, asked = asks[order], asked[order]
    best, whose = np.full((len(left), k), np.inf), np.full((len(left), k), np.iinfo(np.int64).max)
    held = right["leaf"].to_numpy()
    by_leaf = np.argsort(held, kind="stable")
    held = held[by_leaf]
    for leaf in np.unique(held):
        of = asks[np.searchsorted(asked, leaf):np.searchsorted(asked, leaf, "right")]
        own = by_leaf[np.searchsorted(held, leaf):np.searchsorted(held, leaf, "right")]
        for a in range(0, len(of), STEP):
            rows = of[a:a + STEP]
            for c in range(0, len(own), STEP):
                refs = own[c:c + STEP]
                same = qid[rows][:, None] == nid[refs][None, :] if exclude_self else None
                if metric == "cosine":
                    d = _compare(qm[rows], rm[refs])
                    if exclude_self:
                        d[same] = np.inf
                    row, col = _least(d, np.broadcast_to(nid[refs], d.shape), min(k, d.shape[1]))
                    d = d[row, col]
                else:
                    row, col, d = _closest(qm[rows], rm[refs], nid[refs], same, best[rows, k - 1], k)
                near, ids = np.full((len(rows), 2 * k), np.inf), np.full((len(rows), 2 * k), np.iinfo(np.int64).max)
                near[:, :k], ids[:, :k] = best[rows], whose[rows]
                place = k + np.arange(len(row)) - np.searchsorted(row, row)
                near[row, place], ids[row, place] = d, nid[refs][col]
                first = np.lexsort((ids, near), axis=1)[:, :k]
                best[rows], whose[rows] = np.take_along_axis(near, first, axis=1), np.take_along_axis(ids, first, axis=1)
    row, col = np.nonzero(np.isfinite(best))
    return pd.DataFrame({"qid": qid[row], "nid": whose[row, col], "dist": best[row, col]})


def _least_distance(d: np.ndarray, centres: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lower bounds on the distance from queries to what cells hold.

    ``d``: distances of queries to the centres, among which every row of a cell chose its nearest; ``lo`` and
    ``hi``: rings; ``size``: a norm for each query that its distances' rounding is relative to.
    """
    nearest = d.argmin(axis=1)
    apart = _rough(centres, centres)[nearest]
    mine = np.take_along_axis(d, nearest[:, None], axis=1)
    behind = d ** 2 - mine ** 2 - SQUARE_SLACK * size[:, None] ** 2
    behind = np.divide(behind, 2 * apart, out=np.zeros_like(d), where=(behind > 0) & (apart > 0))
    return np.maximum(np.maximum(d - hi, lo - d), behind) - SLACK * size[:, None]


class CellTree:
    """Centres of top nodes and leaves, and for each group what the leaves and nodes hold.

    Leaves are ordered by their top node: node ``t`` has the leaves ``start[t]`` to ``start[t + 1]``.
    """

    def __init__(self, sample: np.ndarray):
        _, first = np.unique(sample, axis=0, return_index=True)
        centres = sample[np.sort(first)]
        self.tops = centres[:max(1, math.isqrt(len(centres)))]
        parent = _rough(centres, self.tops).argmin(axis=1)
        parent[:len(self.tops)] = np.arange(len(self.tops))  # no node without a leaf
        order = np.argsort(parent, kind="stable")
        self.leaves, self.parent = centres[order], parent[order]
        self.start = np.searchsorted(self.parent, np.arange(len(self.tops) + 1))
        self.scale = 1 + np.abs(centres).max() * math.sqrt(centres.shape[1])
        self.groups: dict = {}

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to its centre, distance to its top node) of every row."""
        top = _rough(x, self.tops).argmin(axis=1)
        leaf = np.empty(len(x), np.int64)
        for t in np.unique(top):
            own = np.flatnonzero(top == t)
            leaf[own] = self.start[t] + _rough(x[own], self.leaves[self.start[t]:self.start[t + 1]]).argmin(axis=1)
        return leaf, np.linalg.norm(x - self.leaves[leaf], axis=1), np.linalg.norm(x - self.tops[top], axis=1)

    def hold(self, stats: list) -> None:
        """Take in one row (g, leaf, n, lo, hi, top_lo, top_hi) per group and leaf."""
        for s in stats:
            if s["g"] not in self.groups:
                n, t = len(self.leaves), len(self.tops)
                self.groups[s["g"]] = {"n": np.zeros(n, np.int64), "lo": np.full(n, np.inf), "hi": np.full(n, -np.inf),
                                       "top_n": np.zeros(t, np.int64), "top_lo": np.full(t, np.inf), "top_hi": np.full(t, -np.inf)}
            own, leaf = self.groups[s["g"]], s["leaf"]
            top = self.parent[leaf]
            own["n"][leaf], own["lo"][leaf], own["hi"][leaf] = s["n"], s["lo"], s["hi"]
            own["top_n"][top] += s["n"]
            own["top_lo"][top] = min(own["top_lo"][top], s["top_lo"])
            own["top_hi"][top] = max(own["top_hi"][top], s["top_hi"])

    def pack(self, bin_rows: int) -> dict:
        """Deal the leaves of every group, in order, to bins of up to ``bin_rows`` references; {(group, bin): references}."""
        held = {}
        for g, own in self.groups.items():
            own["bin"], at, n = np.zeros(len(self.leaves), np.int64), 0, 0
            for leaf in np.flatnonzero(own["n"]):
                if n and n + own["n"][leaf] > bin_rows:
                    at, n = at + 1, 0
                n += int(own["n"][leaf])
                own["bin"][leaf], held[g, at] = at, n
        return held

    def _children(self, own: dict, t: int) -> np.ndarray:
        return self.start[t] + np.flatnonzero(own["n"][self.start[t]:self.start[t + 1]])

    def first(self, g, x: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs: the nearest leaves under the nearest top nodes that hold ``need`` references together."""
        own = self.groups[g]
        order = np.argsort(_rough(x, self.tops), axis=1, kind="stable")
        held = np.cumsum(own["top_n"][order], axis=1)
        last = np.minimum((held < need).sum(axis=1), len(self.tops) - 1)
        before = np.where(last > 0, np.take_along_axis(held, np.maximum(last - 1, 0)[:, None], axis=1)[:, 0], 0)
        place = np.argsort(order, axis=1)
        pairs = []
        for t in np.flatnonzero(own["top_n"]):
            live = self._children(own, t)
            whole = np.flatnonzero(place[:, t] < last)
            pairs.append((np.repeat(whole, len(live)), np.tile(live, len(whole))))
            ends = np.flatnonzero(place[:, t] == last)
            if len(ends):
                near = live[np.argsort(_rough(x[ends], self.leaves[live]), axis=1, kind="stable")]
                n = own["n"][near]
                row, col = np.nonzero(np.cumsum(n, axis=1) - n < (need - before[ends])[:, None])
                pairs.append((ends[row], near[row, col]))
        return tuple(np.concatenate(p) for p in zip(*pairs))

    def reach(self, g, x: np.ndarray, need: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs within ``bound`` of the query that ``first`` did not name."""
        own = self.groups[g]
        size = self.scale + np.linalg.norm(x, axis=1)
        near = _least_distance(_rough(x, self.tops), self.tops, own["top_lo"], own["top_hi"], size) <= bound[:, None]
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for t in np.flatnonzero(own["top_n"]):
            rows = np.flatnonzero(near[:, t])
            if len(rows):
                of = slice(self.start[t], self.start[t + 1])
                least = _least_distance(_rough(x[rows], self.leaves[of]), self.leaves[of], own["lo"][of], own["hi"][of], size[rows])
                row, col = np.nonzero((least <= bound[rows, None]) & (own["n"][of] > 0))
                pairs.append((rows[row], self.start[t] + col))
        query, leaf = (np.concatenate(p) for p in zip(*pairs))
        q0, l0 = self.first(g, x, need)
        n = len(self.leaves)
        new = ~np.isin(query * n + leaf, q0 * n + l0)
        return query[new], leaf[new]


def visits(queries: DataFrame, tree: CellTree, need: int, metric: str, bounded: bool) -> DataFrame:
    """(g, qid, qv[, tau]) -> one row per query and bin with the leaves that it meets (see ``CellTree.first`` and ``reach``)."""

    def run(batches):
        for f in batches:
            for g, own in f.groupby("g"):
                if g not in tree.groups:
                    continue
                x = _search_form(_stack(own["qv"]), metric)
                if bounded:
                    tau = own["tau"].to_numpy(np.float64)
                    tau = np.sqrt(2 * np.maximum(tau, 0)) if metric == "cosine" else tau
                    query, leaf = tree.reach(g, x, need, np.where(np.isnan(tau), np.inf, tau))
                else:
                    query, leaf = tree.first(g, x, need)
                to = tree.groups[g]["bin"][leaf]
                order = np.lexsort((leaf, to, query))
                query, to, leaf = query[order], to[order], leaf[order].astype(np.int32)
                start = np.flatnonzero(np.diff(query, prepend=-1) | np.diff(to, prepend=-1))
                lists = np.split(leaf, start[1:])
                for a in range(0, len(start), STEP):
                    at = start[a:a + STEP]
                    yield pd.DataFrame({"g": g, "bin": to[at].astype("int32"), "qid": own["qid"].to_numpy()[query[at]],
                                        "qv": own["qv"].to_numpy()[query[at]], "leaves": lists[a:a + STEP]})

    return queries.mapInPandas(run, ASKED_SCHEMA)


def build_tree(refs: DataFrame, metric: str, least_rows: int = 1) -> tuple[CellTree | None, DataFrame | None]:
    """(tree over (g, nid, nv) rows, the rows with their leaf), or (None, None) without rows.

    A leaf holds ``least_rows`` rows or more on average: copying a query costs more than comparing it with a few rows.
    """
    spark = refs.sparkSession
    got = refs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("nv")).alias("d")).first()  # one row
    if not got["n"]:
        return None, None
    room = int(spark.conf.get("lurescan.knn.treeBytes", str(DEFAULT_TREE_BYTES))) // (8 * (got["d"] + 1))
    n_leaves = max(1, min(math.isqrt(got["n"]), got["n"] // least_rows, room))
    chosen = refs.select("nid", "nv").orderBy(F.xxhash64("nid"), "nid").limit(n_leaves).collect()  # at most treeBytes
    tree = CellTree(_search_form(np.array([p["nv"] for p in chosen], np.float64), metric))

    def place(batches):
        for f in batches:
            if len(f):
                f["leaf"], f["dist"], f["top_dist"] = tree.place(_search_form(_stack(f["nv"]), metric))
                f["leaf"] = f["leaf"].astype("int32")
                yield f[["g", "nid", "nv", "leaf", "dist", "top_dist"]]

    placed = _written(refs.mapInPandas(place, PLACED_SCHEMA), "knn-placed")
    tree.hold(placed.groupBy("g", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"),
        F.min("top_dist").alias("top_lo"), F.max("top_dist").alias("top_hi")).collect())  # one row a group and leaf
    return tree, placed


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def knn(queries: DataFrame, refs: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
        metric: str = "cosine", group_col: str | None = None, exclude_self: bool = True,
        block_rows: int | None = None) -> DataFrame:
    """(qid, nid, dist, rank): the k nearest references of every query row.

    ``group_col`` restricts neighbours to rows of the same group (e.g. the
    same class for SMOTE); ``metric`` is ``cosine`` or ``euclidean``.
    ``block_rows`` bounds the queries of a task's group, and a bin's references at 16 times as many.
    """
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    q_rows = block_rows or int(spark.conf.get("lurescan.knn.blockRows", str(DEFAULT_BLOCK_ROWS)))
    r_rows = 16 * block_rows if block_rows else int(spark.conf.get("lurescan.knn.cellRows", str(DEFAULT_CELL_ROWS)))
    grp = (lambda df: F.col(group_col).cast("string")) if group_col else (lambda df: F.lit("all"))

    def rows(df, i, v):
        out = df.select(grp(df).alias("g"), F.col(id_col).cast("long").alias(i), F.col(vec_col).cast("array<double>").alias(v))
        return out.where(f"g is not null and {i} is not null and {v} is not null")

    q = rows(queries, "qid", "qv")
    tree, placed = build_tree(rows(refs, "nid", "nv"), metric, max(1, q_rows // 4))
    if tree is None:
        return spark.createDataFrame([], OUT_SCHEMA + ", rank long")
    need = k + int(exclude_self)
    keys = ["g", "bin", "rb", "qb"]
    n_refs = sum(int(own["n"].sum()) for own in tree.groups.values())
    bin_rows = r_rows if block_rows else min(r_rows, max(q_rows, n_refs // BINS))
    task_queries = block_rows or bin_rows
    held = tree.pack(bin_rows)
    dealt = [(g, int(leaf), int(own["bin"][leaf])) for g, own in tree.groups.items() for leaf in np.flatnonzero(own["n"])]
    dealt = F.broadcast(spark.createDataFrame(dealt, "g string, leaf int, bin int"))  # bounded by treeBytes

    def meet(asked: DataFrame, name: str) -> DataFrame:
        """Queries at bins -> the k best references of each group of keys."""
        asked = _written(asked, name)
        load = asked.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a group and bin
        table = [(s["g"], s["bin"], -(-held[s["g"], s["bin"]] // bin_rows), -(-s["n"] // task_queries)) for s in load]
        table = F.broadcast(spark.createDataFrame(table, "g string, bin int, nrb int, nqb int"))  # fewer than leaves
        left = (asked.join(table, ["g", "bin"]).withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nqb")).cast("int"))
                .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nrb") - 1))))
        right = (placed.select("g", "leaf", "nid", "nv").join(dealt, ["g", "leaf"]).join(table, ["g", "bin"])
                 .withColumn("rb", F.pmod(F.xxhash64("nid"), F.col("nrb")).cast("int"))
                 .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1))))
        return (left.select(*keys, "qid", "qv", "leaves").groupBy(*keys).cogroup(right.select(*keys, "leaf", "nid", "nv").groupBy(*keys))
                .applyInPandas(lambda x, y: _block_topk(x, y, k, metric, exclude_self), schema=OUT_SCHEMA))

    best = Window.partitionBy("qid").orderBy("dist", "nid")

    def topk(cand: DataFrame) -> DataFrame:
        return cand.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)

    first = _written(topk(meet(visits(q, tree, need, metric, False), "knn-asked")).drop("rank"), "knn-first")
    tau = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("tau"))
    more = q.join(tau, "qid", "left").select("g", "qid", "qv", "tau")
    second = meet(visits(more, tree, need, metric, True), "knn-more")
    return topk(first.unionByName(second))
