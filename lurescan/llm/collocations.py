"""Operator 13: phrase collocation mining by direct-address tiles of frequency-ranked ids.

Texts (A-Z lowered) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at
spaces and tabs into words.  Everything is counted per language.

1. One pass over the texts writes *chunks*: the words of about
   ``CHUNK_BYTES`` of text of one language as a dictionary and a sequence of
   local numbers, -1 between pieces.  Longer texts are cut between pieces.
2. Words found ``min_count`` times or more get ids by falling frequency (over
   all languages, a word of each language for itself).  Each
   chunk's distinct words meet them in a join and its sequence is rewritten in ids.
3. Pairs of neighbours are counted: ids are split into tiles of 2^TILE_BITS by
   2^TILE_BITS pairs; a tile with many pairs, as those of frequent words, is
   counted by one dense ``bincount`` over its places, the pairs of all other
   tiles are sorted as coordinates and their runs counted.  Tasks send counts,
   not occurrences, and Spark sums them.
4. Frequent pairs get ids by falling frequency themselves, the sequence is
   rewritten in pair ids, and (pair, word) is counted the same way, and so on
   up to ``max_words``.
5. Counts of phrases give the candidates' cuts, scores and inclusions by joins.

Nothing whole passes the driver or one task: chunks are bounded, dictionaries
of chunks are joined by word, and the first rows of a language come from ranks
in buckets.  A phrase is only counted where all its parts are frequent, which
loses nothing, as a part is found at least as often as the whole.

Cases
-----
* null or empty text: no words.  Null language: ``und``, together with rows that say ``und``.
* repeated rows and ids: every row counts; ids are not read.
* ties: equal scores go by count, then by phrase in UTF-8 byte order; equal cuts to the smallest k.
* one very long piece: a chunk of its own.
* empty table: an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescan.llm import common
from lurescan.operators.ranking import global_rank

CHUNK_BYTES = 6 << 20
#: Chunks of all languages that a task holds back, in bytes of text.
WAITING_BYTES = 18 << 20
TILE_BITS = 10
#: A tile with this many pairs is counted by its places.
DENSE = 1 << (2 * TILE_BITS - 4)
#: Rows of several MB need smaller Parquet groups, checked at every row.
PARQUET = {"parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = SEPARATOR.copy()
BETWEEN[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.int32(-1)
COUNTS = "pair long, n long"


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, flags: the word begins a piece)."""
    data = LOWER[data]
    full = ~BETWEEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prior = np.zeros(len(data), bool)
    prior[1:] = full[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = full[1:]
    starts = np.flatnonzero(full & (~prior | edge[:-1]))
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    piece = np.cumsum(SEPARATOR[data] | edge[:-1], dtype=np.int32)[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = piece[1:] != piece[:-1]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[full]))
    return words, fresh


def parts(offsets: np.ndarray, data: np.ndarray):
    """(offsets, data) of the texts in portions of about CHUNK_BYTES; a longer text is cut behind separators."""
    for a, b in common.slices(offsets, CHUNK_BYTES):
        own, raw = offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]]
        if len(raw) <= CHUNK_BYTES:
            yield own, raw
            continue
        cuts = np.flatnonzero(SEPARATOR[raw]) + 1  # one text
        at = 0
        while at < len(raw):
            k = int(np.searchsorted(cuts, at + CHUNK_BYTES, "right")) - 1
            to = int(cuts[k]) if k >= 0 and cuts[k] > at else int(cuts[k + 1]) if k + 1 < len(cuts) else len(raw)
            if len(raw) - at <= CHUNK_BYTES:
                to = len(raw)
            yield np.array([0, to - at]), raw[at:to]
            at = to


class Chunk:
    """Words of one language that wait to be written."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.fresh: list[np.ndarray] = []
        self.size = 0

    def add(self, offsets: np.ndarray, data: np.ndarray) -> None:
        words, fresh = words_of(offsets, data)
        self.words.append(words.dictionary_encode())
        self.fresh.append(fresh)
        self.size += len(data)

    def row(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct words, their counts, the sequence of their numbers with breaks)."""
        coded = pa.chunked_array(self.words).unify_dictionaries()
        numbers = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        fresh = np.concatenate(self.fresh)
        fresh[:1] = False
        symbols = coded.chunk(0).dictionary.cast(pa.string())
        seq = np.full(len(numbers) + int(fresh.sum()), BREAK)
        seq[np.arange(len(numbers)) + np.cumsum(fresh)] = numbers
        return symbols, np.bincount(numbers, minlength=len(symbols)), seq


def chunks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """chunk, lang, symbols, counts, length, seq (packed numbers of symbols, -1 between pieces)."""
    common.ready(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       common.text_of(F.col(f"`{text_col}`")).alias("text"))
    names = ["chunk", "lang", "symbols", "counts", "length", "seq"]

    def run(batches):
        waiting: dict[str, Chunk] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(lang):
            nonlocal number
            symbols, counts, seq = waiting.pop(lang).row()
            number += 1
            one = [0, len(symbols)]
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1]), pa.array([lang]), pa.ListArray.from_arrays(pa.array(one, pa.int32()), symbols),
                 pa.ListArray.from_arrays(pa.array(one, pa.int32()), pa.array(counts)), pa.array([len(seq)]),
                 pa.array([pack(seq)], pa.binary())], names)

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(coded.indices, k))
                for offsets, data in parts(*common.string_parts(texts)):
                    chunk = waiting.setdefault(lang, Chunk())
                    chunk.add(offsets, data)
                    if chunk.size >= CHUNK_BYTES:
                        yield flush(lang)
            if sum(c.size for c in waiting.values()) >= WAITING_BYTES:
                for lang in list(waiting):
                    yield flush(lang)
        for lang in list(waiting):
            yield flush(lang)

    return rows.mapInArrow(run, "chunk long, lang string, symbols array<string>, counts array<long>, length long, seq binary")


def count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs as left << 32 | right, their counts), tile by tile; ids are below 2^31."""
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = (1 << TILE_BITS) - 1
    columns = (int(right.max()) >> TILE_BITS) + 1
    tile = (left >> TILE_BITS).astype(np.int64) * columns + (right >> TILE_BITS)
    place = ((left & low) << TILE_BITS | right & low).astype(np.int32)
    order = np.argsort(tile.astype(np.uint16) if int(tile.max()) < 1 << 16 else tile, kind="stable")
    tile, place = tile[order], place[order]
    del order
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    ends = np.append(starts[1:], len(tile))
    tiles, places, counts = [], [], []
    dense = ends - starts >= DENSE
    for a, b in zip(starts[dense].tolist(), ends[dense].tolist()):
        n = np.bincount(place[a:b], minlength=1 << 2 * TILE_BITS)
        at = np.flatnonzero(n)
        tiles.append(np.full(len(at), tile[a]))
        places.append(at)
        counts.append(n[at])
    sparse = np.repeat(~dense, ends - starts)
    if sparse.any():
        keys = np.sort(tile[sparse] << 2 * TILE_BITS | place[sparse])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        tiles.append(keys[first] >> 2 * TILE_BITS)
        places.append(keys[first] & (1 << 2 * TILE_BITS) - 1)
        counts.append(np.diff(np.append(first, len(keys))))
    tile, place, n = (np.concatenate(x) for x in (tiles, places, counts))
    return ((tile // columns << TILE_BITS | place >> TILE_BITS) << 32) | (tile % columns << TILE_BITS | place & low), n


def neighbours(ids: np.ndarray, phrases: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, phrase ids, ids of the next words) where a frequent phrase of ``length`` words has a
    frequent word behind it and the phrase one word on is frequent, too."""
    n = max(len(ids) - length, 0)
    at = np.flatnonzero((phrases[:n] >= 0) & (phrases[1:n + 1] >= 0) & (ids[length:length + n] >= 0))
    return at, phrases[at], ids[at + length]


def pack(numbers: np.ndarray) -> bytes:
    """int32 numbers as compressed planes of bytes: most numbers are small."""
    return pa.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpack(raw, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, size).T).view(np.int32)[:, 0]


class _Rows:
    """Chunks of an Arrow batch, one at a time: ``for i in rows`` and its columns by name."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def __iter__(self):
        return iter(range(self.batch.num_rows))

    def value(self, i: int, name: str):
        return self.batch.column(name)[i].as_py()

    def numbers(self, i: int, name: str) -> np.ndarray:
        return unpack(self.batch.column(name)[i].as_buffer(), self.value(i, "length"))

    def lookup(self, i: int, size: int) -> np.ndarray:
        """Ids by number in the chunk, -1 for symbols that are not frequent; ``ids`` lists at << 32 | id."""
        out, lists = np.full(size, BREAK), self.batch.column("ids")
        if lists[i].is_valid:
            both = lists.slice(i, 1).flatten().to_numpy()
            out[both >> 32] = both & 0x7FFFFFFF
        return out

    def row(self, i: int, **new) -> pa.RecordBatch:
        """Row i's chunk and length with other columns."""
        keys = ["chunk", "length"]
        columns = [self.batch.column(k).slice(i, 1) for k in keys] + [pa.array([v], pa.binary()) for v in new.values()]
        return pa.RecordBatch.from_arrays(columns, [*keys, *new])


def _frequent(sums: DataFrame, key: list[str], min_count: int, name: str) -> DataFrame:
    """key, f, id (from 0, by falling f) of the symbols found often enough.

    Ids run over all languages, so that an id, and a pair of ids, has one language.
    """
    often = sums.where(F.col("f") >= min_count)
    ranked = global_rank(often, [F.desc("f"), *key])
    return common.materialise(ranked.select(*key, "f", (F.col("rank") - 1).alias("id")), name)


def _given_back(symbols: DataFrame, ranked: DataFrame, key: list[str]) -> DataFrame:
    """(chunk, ids): for each chunk the number in the chunk << 32 | id of its symbols that are frequent.

    ``symbols`` (chunk, at, key) has a chunk's distinct symbols, so a list
    is bounded by the chunk.  The frequent symbols of a partition are hashed, as
    sorting the many others would cost most.
    """
    both = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("id"))
    return (symbols.join(ranked.select(*key, "id").hint("shuffle_hash"), key)
            .groupBy("chunk").agg(F.collect_list(both).alias("ids")))


def _row_counts(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in count_pairs(left, right)], ["pair", "n"])


def count_phrases(chunked: DataFrame, max_words: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words array<string>, f of every phrase found ``min_count`` times or more, n per lang)."""
    sums = (chunked.select("lang", F.explode(F.arrays_zip("symbols", "counts")).alias("s"))
            .groupBy("lang", F.col("s.symbols").alias("word")).agg(F.sum("s.counts").alias("f")))
    sums = common.materialise(sums, "word-counts")
    totals = sums.groupBy("lang").agg(F.sum("f").alias("n"))
    words = _frequent(sums, ["lang", "word"], min_count, "words")

    def in_ids(batches):
        for batch in batches:
            rows = _Rows(batch)
            for i in rows:
                known = rows.lookup(i, rows.value(i, "size") + 1)  # the last place is the breaks'
                yield rows.row(i, seq=pack(known[rows.numbers(i, "seq")]))

    symbols = chunked.select("chunk", "lang", F.posexplode("symbols").alias("at", "word"))
    coded = (chunked.select("chunk", "length", "seq", F.size("symbols").alias("size"))
             .join(_given_back(symbols, words, ["lang", "word"]), "chunk", "left")
             .mapInArrow(in_ids, "chunk long, length long, seq binary"))
    coded = common.materialise(coded, "coded", **PARQUET)
    common.remove(chunked)

    def pairs(batches):
        for batch in batches:
            rows = _Rows(batch)
            for i in rows:
                ids = rows.numbers(i, "seq")
                yield _row_counts(*neighbours(ids, ids, 1)[1:])

    counts = coded.mapInArrow(pairs, COUNTS)
    phrases = words.select("lang", "id", F.array("word").alias("words"), "f")
    found = [phrases]
    for length in range(1, max_words):
        sums = counts.groupBy("pair").agg(F.sum("n").alias("f"))
        ranked = _frequent(sums, ["pair"], min_count, f"phrases-{length + 1}")
        longer = (ranked.select("id", "f", F.shiftright("pair", 32).alias("l"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("r"))
                  .join(phrases.select("lang", F.col("id").alias("l"), F.col("words").alias("w")), "l")
                  .join(words.select(F.col("id").alias("r"), "word"), "r")
                  .select("lang", "id", F.concat("w", F.array("word")).alias("words"), "f"))
        phrases = common.materialise(longer, f"phrase-words-{length + 1}")
        found.append(phrases)
        if length + 1 < max_words:
            coded, counts = _longer(coded, ranked, length, last=length + 2 == max_words)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop("id"), totals


def _longer(coded: DataFrame, ranked: DataFrame, length: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """(``coded`` with the ids of the phrases one word longer, the counts of these with the next word).

    The last level's ids are not written: its counts are taken where the ids come back.
    """
    def of(rows, i):
        ids = rows.numbers(i, "seq")
        phrases = rows.numbers(i, "phrases") if "phrases" in rows.batch.schema.names else ids
        at, left, right = neighbours(ids, phrases, length)
        pair = left.astype(np.int64) << 32 | right
        return ids, at, pair

    def distinct(batches):
        for batch in batches:
            rows = _Rows(batch)
            for i in rows:
                pair = np.unique(of(rows, i)[2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), rows.value(i, "chunk"))), pa.array(np.arange(len(pair), dtype=np.int32)),
                     pa.array(pair)], ["chunk", "at", "pair"])

    def rewritten(rows, i):
        ids, at, pair = of(rows, i)
        known, number = np.unique(pair, return_inverse=True)
        out = np.full(len(ids), BREAK)
        out[at] = rows.lookup(i, len(known))[number]
        return ids, out

    def written(batches):
        for batch in batches:
            rows = _Rows(batch)
            for i in rows:
                yield rows.row(i, seq=batch.column("seq")[i].as_py(), phrases=pack(rewritten(rows, i)[1]))

    def counted(batches):
        for batch in batches:
            rows = _Rows(batch)
            for i in rows:
                yield _row_counts(*neighbours(*rewritten(rows, i), length + 1)[1:])

    def again(batches):
        for batch in batches:
            rows = _Rows(batch)
            for i in rows:
                both = rows.numbers(i, "seq"), rows.numbers(i, "phrases")
                yield _row_counts(*neighbours(*both, length + 1)[1:])

    symbols = coded.mapInArrow(distinct, "chunk long, at int, pair long")
    joined = coded.join(_given_back(symbols, ranked, ["pair"]), "chunk", "left")
    if last:
        return coded, joined.mapInArrow(counted, COUNTS)
    new = common.materialise(joined.mapInArrow(written, "chunk long, length long, seq binary, phrases binary"),
                             "coded", **PARQUET)
    common.remove(coded)
    return new, new.mapInArrow(again, COUNTS)


def mine(docs: DataFrame, max_words: int = 3, min_count: int = 10, drop_percent: int = 50, top: int = 2000,
         lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best-scored phrases of two to ``max_words`` words of each language.

    a = f(phrase) >= ``min_count``; a cut into the first words and the rest has
    l = f(first), r = f(rest) and the score floor(1000000 a a / (l r)), the
    lowest cut counts.  Phrases inside a longer candidate with
    100 f(longer) >= ``drop_percent`` a are dropped.
    """
    chunked = common.materialise(chunks(docs, lang_col, text_col), "chunks", **PARQUET)
    found, totals = count_phrases(chunked, max_words, min_count)
    freq = found.select("lang", F.array_join("words", " ").alias("phrase"), "f")
    many = found.where(F.size("words") >= 2)
    cut = F.expr("explode(transform(sequence(1, size(words) - 1), k -> struct(k, "
                 "array_join(slice(words, 1, k), ' ') as first, array_join(slice(words, k + 1, size(words)), ' ') as rest)))")
    cuts = many.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), cut.alias("c")).select(
        "lang", "phrase", "a", "c.k", "c.first", "c.rest")
    cuts = (cuts.join(freq.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(freq.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    # exact: products in decimals of 38 digits
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as {wide}) * cast(a as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    scored = (cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase")
              .agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
              .select("lang", "phrase", "a", "m.l", "m.r", "m.score"))
    part = F.expr("explode(flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), "
                  "i -> array_join(slice(words, i, k), ' ')))))")
    inside = (many.where(F.size("words") >= 3).select("lang", part.alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    left = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < drop_percent * F.col("a"))).drop("longer")
    # first rows of a language from the first rows of its buckets
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("rank") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir) -> DataFrame:
    return mine(common.documents(spark, sf_dir).select("lang", "text"))


SQL = r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    seqs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM seqs GROUP BY lang),
    grams AS (
      SELECT lang, 1 AS k, unnest(w) AS phrase FROM seqs
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM seqs
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM seqs),
    freq AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
    cand AS (SELECT lang, phrase, f AS a, k AS size, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2),
    cuts AS (
      SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM cand
      UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM cand WHERE size = 3),
    scored AS (
      SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score,
        row_number() OVER (PARTITION BY c.lang, c.phrase
          ORDER BY (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f), c.k) AS place
      FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = c.head JOIN freq y ON y.lang = c.lang AND y.phrase = c.rest),
    inside AS (
      SELECT lang, phrase, max(f) AS longer FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a AS f FROM cand WHERE size = 3
        UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE size = 3) GROUP BY ALL),
    ranked AS (
      SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, score
      FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
      WHERE place = 1 AND (longer IS NULL OR 100 * longer < 50 * a))
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
