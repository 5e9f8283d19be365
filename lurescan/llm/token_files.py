"""Operator 7: token ids as flat binary files with 64-bit offsets, memory-mapped.

Documents are range-partitioned and sorted by id.  Each task encodes its
documents and writes one shard: ``<n>.bin`` holds the ids as flat unsigned
integers (16 bits if the vocabulary fits, else 32), ``<n>.idx`` the 64-bit
offsets of its documents' starts plus the end.  Offsets are local to a shard;
a shard's base, the number of ids before it, is the prefix sum over the
shards' totals.  A shard appears under its name by a rename, so a repeated or
speculative task leaves the same whole file.

``TokenFiles`` memory-maps shards; ``read_back`` returns one row per document
from the files alone.

Cases
-----
* null or empty text: only the end id.
* null ids come first; repeated ids are written each, ordered by text hash.
* very long texts: one document never spans two shards.
* empty table: no shard, an empty result.
* extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescan.llm import common
from lurescan.llm.pieces import WordIds, gather
from lurescan.session import scratch_dir

END_ID = 2
#: Stands for a null id in a shard's file of ids.
NO_KEY = -(2**63)
#: Texts are encoded in slices of about this many bytes: each slice looks its words up in the whole index.
SLICE_BYTES = 16 << 20

_coders: dict[str, tuple] = {}

#: Characters whose letter, digit and space classes are the same in every Unicode version (RE2 syntax).
PLAIN = r"\A[\x09-\x0d\x20-\x7e\x{a1}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}]*\z"


def coder(path: str, pattern: str, dtype: str):
    """(WordIds over the library, the library's own whole-text encoding, special strings), one a worker.

    Pieces go to the library as pre-tokens in its byte alphabet; whole texts go
    to it as they are.
    """
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        lib, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (lib, bare):
            t.no_truncation()
            t.no_padding()
        bare.pre_tokenizer = None
        alphabet = byte_alphabet()

        def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([x for e in ids for x in e], dtype), np.array([len(e) for e in ids], np.int64)

        mark = "\n".translate(alphabet)
        mark_id = bare.token_to_id(mark)

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """A line end marks where one piece ends, so pieces that hold one go alone."""
            single = np.array(["\n" not in p for p in pieces], bool)
            lines, sizes = whole([p for p, s in zip(pieces, single) if not s])
            easy = [p.encode().decode("latin-1").translate(alphabet) for p, s in zip(pieces, single) if s]
            marked = [mark] * (2 * len(easy))
            marked[::2] = easy
            ids = np.array(bare.encode_batch_fast([marked], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype)
            ends = np.flatnonzero(ids == mark_id)
            starts = np.append(0, ends + 1)[:-1]
            size, start = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
            size[single], start[single] = ends - starts, starts
            size[~single], start[~single] = sizes, len(ids) + np.cumsum(sizes) - sizes
            return gather(np.concatenate([ids, lines]), start, size)[0], size

        special = [t.content for t in lib.get_added_tokens_decoder().values()]
        _coders[path] = WordIds(pattern, encode, dtype), whole, special
    return _coders[path]


def byte_alphabet() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def encode_texts(path: str, pattern: str, dtype: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts: by words, or whole where words might not be independent."""
    words, whole, special = coder(path, pattern, dtype)
    easy = pc.match_substring_regex(texts, PLAIN)
    for s in special:
        easy = pc.and_not(easy, pc.match_substring(texts, s))
    if pc.all(easy).as_py() or not len(texts):
        return words.ids(texts)
    flat, at = words.ids(texts.filter(easy))
    more, sizes = whole(texts.filter(pc.invert(easy)).to_pylist())
    easy = easy.to_numpy(zero_copy_only=False)
    size, start = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    size[easy], start[easy] = np.diff(at), at[:-1]
    size[~easy], start[~easy] = sizes, len(flat) + np.cumsum(sizes) - sizes
    return gather(np.concatenate([flat, more]), start, size)


def gathered(batches, limit: int):
    """Neighbouring Arrow batches put together up to about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def local_path(uri: str) -> str:
    """The path of a folder that all machines mount."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"token files need a mounted shared folder, not {uri}")
    return uri


class TokenFiles:
    """One shard, memory-mapped: ids of the i-th document, and the documents' ids."""

    def __init__(self, folder: str, shard: int, dtype: str):
        base = os.path.join(folder, f"{shard:06d}")
        self.offsets = np.memmap(base + ".idx", "<i8", "r")
        self.keys = np.memmap(base + ".doc", "<i8", "r")
        self.ids = np.memmap(base + ".bin", dtype, "r")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i + 1]]


def write(docs: DataFrame, folder: str, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Write the shards; (shard table: shard, docs, tokens, base; dtype of the ids)."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), common.text_of(F.col(f"`{text_col}`")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    out = local_path(folder)
    result = pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        shard = TaskContext.get().partitionId()
        base, mark = os.path.join(out, f"{shard:06d}"), f".{TaskContext.get().taskAttemptId()}.part"
        total = count = 0
        files: dict = {}
        for batch in gathered(batches, SLICE_BYTES):
            if not files and len(batch):
                os.makedirs(out, exist_ok=True)
                files = {x: open(base + x + mark, "wb") for x in (".bin", ".idx", ".doc")}
                files[".idx"].write(np.zeros(1, "<i8").tobytes())
            offsets, _ = common.string_parts(batch.column(1))
            for a, b in common.slices(offsets, SLICE_BYTES):
                ids, at = encode_texts(path, pattern, dtype, batch.column(1).slice(a, b - a))
                files[".bin"].write(np.insert(ids, at[1:], end_id).astype(dtype).tobytes())
                ends = total + at[1:] + np.arange(1, b - a + 1)
                files[".idx"].write(ends.astype("<i8").tobytes())
                files[".doc"].write(batch.column(0).slice(a, b - a).fill_null(NO_KEY).to_numpy().astype("<i8").tobytes())
                total, count = int(ends[-1]), count + b - a
        for x, f in files.items():
            f.close()
            os.replace(base + x + mark, base + x)
        if count:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [count], "tokens": [total]}, result)

    shards = common.materialise(rows.mapInArrow(run, "shard long, docs long, tokens long"), "op7-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))), dtype


def read_back(shards: DataFrame, folder: str, dtype: str) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    src = local_path(folder)
    spark = shards.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = shards.select("shard", "base").repartition(n, "shard")

    def run(batches):
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = TokenFiles(src, shard, dtype)
                for a in range(0, len(t), 4096):
                    b = min(a + 4096, len(t))
                    keys = np.array(t.keys[a:b])
                    crc = [zlib.crc32(t[i].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=keys == NO_KEY), pa.array(base + np.array(t.offsets[a:b])),
                         pa.array(np.diff(t.offsets[a:b + 1])), pa.array(crc, pa.int64())],
                        ["id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir) -> DataFrame:
    import public_tokenizers as P

    folder = scratch_dir(spark, "op7-token-files")
    shards, dtype = write(common.documents(spark, sf_dir).select("doc_id", "text"), folder, P.path("byte_bpe_50k.json"),
                          P.PATTERN)
    return read_back(shards, folder, dtype).withColumnRenamed("id", "doc_id")
