"""Operator 10: near-duplicates by one-permutation MinHash.

1. Every text becomes its set of distinct five-word shingles (A-Z lowered),
   one permutation splits the shingle hashes over ``BINS`` bins, and empty bins
   are filled by optimal densification (each draws bins by a fixed hash until
   it meets a full one).  Only counts, signatures and band keys are written.
2. Documents with the same set (128-bit digest of the whole set and its size)
   form a class; from here on only the class's smallest id takes part.
3. ``BANDS`` bands of ``ROWS`` bins give buckets.  The smallest id of a bucket
   is its hub; candidate edges form a star from the hub, so a bucket of n
   documents gives n - 1 edges.
4. Documents that the candidate edges connect form a cluster; pairs that share
   a bucket are always in one.  Within a cluster links are confirmed on the full
   sets: the largest component so far is left alone, and each document outside
   it takes the hub's part in turn and is compared with all documents of other
   components (in clusters of more than ``PAIRS``, with those that sizes and
   signatures leave, see ``least_agreement``).  So the stars lose no link, no pair
   is ever written, and documents that are already together are not compared.
5. A cluster of more than ``CLUSTER`` documents or ``CLUSTER_SHINGLES`` shingles
   is not given to one task.  There the stars themselves are confirmed by joins
   on the full texts; buckets whose members are still in different components
   let up to ``HUBS`` members a round (strangers to the bucket's main component
   first) meet all members of other components, until every bucket is one
   component or all its members have been hubs.

With 24 bands of 5 rows a pair at similarity 0.85 shares no bucket with a
probability of about 1e-6.

Cases
-----
* null or empty text or white space only: n_shingles 0, a component of its own, kept.
* fewer than five words: the whole sequence is the only shingle.
* null ids: such rows are returned with component_id null and kept, unlinked.
* repeated rows (same id): the id's row is returned once for each of its rows.
* equal similarity (ties with the limit): linked, the limit is inclusive.
* hot groups: exact copies collapse with map-side combine; joins on bucket or
  hub keys are plain equi-joins that AQE splits.
* extra columns are ignored by ``components`` and returned by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescan.llm import common
from lurescan.llm.components import connected
from lurescan.llm.words import LOWER, PLACES, Words, in_doc, mix

WIDTH = 5
BINS, BANDS, ROWS = 120, 24, 5
HUBS = 64
CLUSTER, CLUSTER_SHINGLES = 32768, 6_000_000
PAIRS = 64  # members of a cluster up to which full sets meet without a look at their signatures
SMALL_SET = 64  # densified bins repeat each other in smaller sets, so these are always confirmed
_U = np.uint64


def _draws() -> np.ndarray:
    """draws[t, bin]: the bin that an empty bin looks at in its t-th attempt."""
    t, b = np.meshgrid(np.arange(4 * BINS), np.arange(BINS), indexing="ij")
    return (mix((t * BINS + b).astype(_U) + _U(99)) % _U(BINS)).astype(np.int64)


DRAWS = _draws()


def densify(sig: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Fill empty bins of rows that have any full bin."""
    out, todo = sig.copy(), empty.copy()
    todo[empty.all(axis=1)] = False
    rows = np.flatnonzero(todo.any(axis=1))
    for draw in DRAWS:
        if not len(rows):
            break
        take = todo[rows] & ~empty[rows][:, draw]
        r, b = np.nonzero(take)
        out[rows[r], b] = sig[rows[r], draw[b]]
        todo[rows[r], b] = False
        rows = rows[todo[rows].any(axis=1)]
    for r in rows:  # drew only empty bins: take the next full one
        full = np.flatnonzero(~empty[r])
        for b in np.flatnonzero(todo[r]):
            out[r, b] = sig[r, full[np.searchsorted(full, b) % len(full)]]
    return out


def shingles(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text."""
    w = Words(offsets, LOWER[data])
    h = w.hashes()
    first, win = w.windows(h, WIDTH)
    doc = w.doc[first]
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        at = np.concatenate([[0], np.cumsum(counts)])[short]
        own = np.zeros(len(short), _U)
        for i in range(WIDTH - 1):
            has = counts[short] > i
            own[has] += h[at[has] + i] * PLACES[i]
        own = mix(own + counts[short].astype(_U))
        doc, win = np.concatenate([doc, short]), np.concatenate([win, own])
    _, one = np.unique(in_doc(win, doc), return_index=True)
    return doc[one], win[one]


def bins_of(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The densified signatures of ``n`` sets of hashes."""
    value = (mix(h + _U(3)) >> _U(16)).astype(np.uint64)
    bins = ((h >> _U(32)) % _U(BINS)).astype(np.int64)
    sig = np.full(n * BINS, _U(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(sig, doc * BINS + bins, value)
    sig = sig.reshape(n, BINS)
    return densify(sig, sig == _U(0xFFFFFFFFFFFFFFFF))


def short(sig: np.ndarray) -> np.ndarray:
    """A byte a bin, for counting bins that agree."""
    return (mix(sig) & _U(255)).astype(np.uint8)


def sign(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    doc, h = shingles(offsets, data)
    size = np.bincount(doc, minlength=n).astype(np.int64)
    digest = np.zeros((2, n), _U)
    np.add.at(digest[0], doc, mix(h + _U(1)))
    np.add.at(digest[1], doc, mix(h + _U(2)))
    sig = bins_of(doc, h, n)
    keys = np.zeros((n, BANDS), _U)
    for i in range(ROWS):
        keys += mix(sig[:, i::ROWS][:, :BANDS] + _U(i)) * PLACES[i]
    keys = mix(keys + np.arange(BANDS, dtype=_U))
    return {"size": size, "d1": digest[0].view(np.int64), "d2": digest[1].view(np.int64),
            "sig": short(sig), "keys": keys.view(np.int64)}


def _kernel(ids, offsets, data):
    s = sign(offsets, data)
    n = len(offsets) - 1
    step = pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32))
    keys = pa.ListArray.from_arrays(step, pa.array(s["keys"].ravel()))
    sig = pa.Array.from_buffers(pa.binary(BINS), n, [None, pa.py_buffer(s["sig"].tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([ids, pa.array(s["size"]), pa.array(s["d1"]), pa.array(s["d2"]), sig, keys],
                                      ["id", "n_shingles", "d1", "d2", "sig", "keys"])


SIGNED = "id long, n_shingles long, d1 long, d2 long, sig binary, keys array<long>"


def word_shingles(text: str) -> set:
    """The full set, on the words themselves."""
    words = [x for x in _split(text.translate(_LOWER)) if x]
    if not words:
        return set()
    if len(words) < WIDTH:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(WIDTH))))


_LOWER = {i: i + 32 for i in range(65, 91)}
_SPACES = {c: " " for c in range(0x09, 0x0E)}


def _split(text: str) -> list[str]:
    return text.translate(_SPACES).split(" ")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the limit.

    Texts meet the pairs by joins on either id; sorted by hub, so that a hub's
    set is built once for a run of pairs.
    """
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b")

    def check(batches):
        last, hub = None, set()
        for batch in batches:
            good = []
            for a, ta_, tb_ in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, hub = a, word_shingles(ta_.as_py())
                own = word_shingles(tb_.as_py())
                common_ = len(hub & own)
                good.append(100 * common_ >= percent * (len(hub) + len(own) - common_))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def least_agreement(percent: int) -> int:
    """Agreeing bins that a pair at the limit has but for a chance of about 1e-8."""
    p = percent / 100
    return int(BINS * p - 5.5 * (BINS * p * (1 - p)) ** 0.5)


def likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Drop pairs that sizes rule out, or signatures (see least_agreement)."""
    sa = signed.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    sb = signed.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(sb, "b").join(sa, "a").where(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    least = least_agreement(percent)

    def check(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, BINS) for i in (3, 5))
            small = np.minimum(batch.column(2).to_numpy(), batch.column(4).to_numpy()) < SMALL_SET
            good = small | ((x == y).sum(axis=1) >= least)
            part = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"])

    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(check, "a long, b long")


def join_cluster(ids: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """The component (smallest id) of each member of one cluster, on the full sets.

    In clusters of more than ``PAIRS`` members, sets meet a hub's only where sizes and signatures allow a link (see ``likely``).
    """
    n = len(ids)
    size = np.array([len(x) for x in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(word.max() + 1, np.int32)
    comp, todo = np.arange(n), np.ones(n, bool)
    sig = short(bins_of(np.repeat(np.arange(n), size), np.concatenate(sets), n)).T.copy() if n > PAIRS else None
    least = least_agreement(percent)
    while True:
        main = np.bincount(comp, minlength=n).argmax()
        left = np.flatnonzero(todo & (comp != main)) if n > 1 else ()
        if not len(left):
            break
        hub = left[0]
        todo[hub] = False
        may = (comp != comp[hub]) & (100 * np.minimum(size, size[hub]) >= percent * np.maximum(size, size[hub]))
        if sig is not None and size[hub] >= SMALL_SET:
            may &= (size < SMALL_SET) | ((sig == sig[:, hub, None]).view(np.uint8).sum(axis=0, dtype=np.uint8) >= least)
        others = np.flatnonzero(may)
        if not len(others):
            continue
        own = word[start[hub]:start[hub] + size[hub]]
        mark[own] = 1
        held = size[others]
        first = np.cumsum(held) - held
        both = np.add.reduceat(mark[word[np.arange(held.sum()) + np.repeat(start[others] - first, held)]], first)
        mark[own] = 0
        linked = others[100 * both >= percent * (held + size[hub] - both)]
        if len(linked):
            merged = np.isin(comp, comp[linked]) | (comp == comp[hub])
            comp[merged] = main if (comp[merged] == main).any() else comp[hub]
    smallest: dict[int, int] = {}
    for c, i in zip(comp.tolist(), ids):
        smallest[c] = min(i, smallest.get(c, i))
    return [smallest[c] for c in comp.tolist()]


def in_clusters(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(id, cluster) of clusters that fit a task -> (id, component)."""
    rows = texts.join(members, "id").select("cluster", "id", "text").dropDuplicates(["id"]).repartition("cluster")

    def run(batches):
        held: tuple[list, list] = ([], [])
        last = None

        def done():
            return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(join_cluster(*held, percent), pa.int64())],
                                              ["id", "component"])

        for batch in batches:
            clusters, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            offsets, data = common.string_parts(batch.column(2))
            for a, b in common.slices(offsets):
                own = offsets[a:b + 1]
                doc, h = shingles(own - own[0], data[own[0]:own[-1]])
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(b - a + 1))
                h = h[order]
                for i in range(a, b):
                    if held[0] and clusters[i] != last:
                        yield done()
                        held[0].clear(), held[1].clear()
                    last = clusters[i]
                    held[0].append(ids[i]), held[1].append(h[cut[i - a]:cut[i - a + 1]])
        if held[0]:
            yield done()

    return rows.sortWithinPartitions("cluster", "id").mapInArrow(run, "id long, component long")


def in_rounds(buckets: DataFrame, signatures: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(band, key, id, hub) of clusters of any size -> (id, component) of linked ids, by joins alone."""

    def confirmed(pairs, k):
        few = common.materialise(likely(pairs, signatures, percent), f"op10-likely{k}")
        return common.materialise(confirm(few, texts, percent), f"op10-links{k}")

    star = buckets.where(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = confirmed(star, 0)
    label = connected(links)
    # the hub has met all members of its bucket, so it leaves
    open_ = buckets.where(F.col("id") != F.col("hub")).select("band", "key", "id")
    k = 0
    while True:
        k += 1
        tagged = open_.join(label, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        mixed = (tagged.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                                   F.min_by("comp", "id").alias("main"))
                 .where("lo < hi").select("band", "key", "main"))
        tagged = common.materialise(tagged.join(mixed, ["band", "key"]), f"op10-open{k}")
        if tagged.isEmpty():
            return label
        order = Window.partitionBy("band", "key").orderBy((F.col("comp") == F.col("main")).cast("int"), "id")
        turn = tagged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= HUBS)
        turn = common.materialise(turn.select("band", "key", F.col("id").alias("h"), F.col("comp").alias("hcomp")), f"op10-hubs{k}")
        pairs = (tagged.join(turn, ["band", "key"]).where((F.col("comp") != F.col("hcomp")) & (F.col("id") != F.col("h")))
                 .select(F.least("h", "id").alias("a"), F.greatest("h", "id").alias("b")).distinct())
        more = confirmed(pairs, k)
        if not more.isEmpty():
            links = links.unionByName(more)
            label = connected(links)
        open_ = tagged.join(turn.select("band", "key", F.col("h").alias("id")), ["band", "key", "id"], "left_anti").select(
            "band", "key", "id")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id and kept for every row of ``docs``."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), common.text_of(F.col(f"`{text_col}`")).alias("text"))
    signed = common.materialise(common.map_texts(texts, _kernel, SIGNED), "op10-signed")
    rows = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))

    # classes of equal sets: hot ones collapse before the shuffle
    digest = ["d1", "d2", "n_shingles"]
    classes = rows.groupBy(*digest).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    member = common.materialise(rows.select("id", *digest).join(classes, digest).select("id", "rep"), "op10-member")
    others = member.where("id <> rep").select("id").distinct()
    entries = rows.join(others, "id", "left_anti").select("id", "n_shingles", F.posexplode("keys").alias("band", "key"))
    hubs = entries.groupBy("band", "key").agg(F.min("id").alias("hub"), F.max("id").alias("far")).where("hub < far").drop("far")
    buckets = common.materialise(entries.join(hubs, ["band", "key"]).distinct(), "op10-buckets")

    star = buckets.where(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    cluster = common.materialise(connected(star).withColumnRenamed("component", "cluster")
                                 .join(buckets.select("id", "n_shingles").distinct(), "id"), "op10-clusters")
    sizes = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    large = sizes.where((F.col("n") > CLUSTER) | (F.col("s") > CLUSTER_SHINGLES)).select("cluster")
    large = common.materialise(cluster.join(large, "cluster", "left_semi").select("id"), "op10-large")
    if large.isEmpty():
        label = in_clusters(cluster.select("id", "cluster"), texts, percent)
    else:
        label = in_clusters(cluster.select("id", "cluster").join(large, "id", "left_anti"), texts, percent).unionByName(
            in_rounds(buckets.join(large, "id", "left_semi").select("band", "key", "id", "hub"),
                      rows.join(large, "id", "left_semi").dropDuplicates(["id"]).select("id", "n_shingles", "sig"), texts, percent))
    label = common.materialise(label, "op10-label")

    comp = member.distinct().join(label.withColumnRenamed("id", "rep"), "rep", "left").select(
        "id", F.coalesce("component", "rep").alias("component"))
    alone = label.join(member.select("id"), "id", "left_anti")
    out = signed.select("id", "n_shingles").join(comp.unionByName(alone), "id", "left").withColumn(
        "component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                      (F.col("id").isNull() | (F.col("component_id") == F.col("id"))).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose id stands for its component, all columns; repeats of an id stay as one row."""
    away = components(docs, id_col, text_col, percent).where(~F.col("kept")).select(F.col(id_col).alias("_away")).distinct()
    return docs.join(away, F.col(f"`{id_col}`").cast("long") == F.col("_away"), "left_anti")


def query(spark, sf_dir) -> DataFrame:
    return components(common.documents(spark, sf_dir).select("doc_id", "text"))


#: All pairs that share a shingle, for small tables.
SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '{common.WORD_CLASS}+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {WIDTH - 1}], ' ') AS g FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) AS p FROM t WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a AS id, b AS r FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.r = l.a),
m AS (SELECT id, min(r) AS m FROM r GROUP BY id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(m.m, t.doc_id)) AS component_id,
  t.doc_id <= coalesce(m.m, t.doc_id) AS kept FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = t.doc_id"""
