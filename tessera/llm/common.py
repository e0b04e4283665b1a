"""Shared pieces of the training-data operators: table access, blocks of documents and word arithmetic on bytes."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text in one block of documents; a longer document is a block's only large member.
BLOCK_BYTES = 8 << 20
#: Bytes handled at once by the vectorised kernels, so that scratch arrays stay in cache and memory stays flat.
CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks that keep each near block_bytes, and never fewer than the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(math.ceil(total / block_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def block_of(n: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")


def in_blocks(docs: DataFrame, n: int, carry: Sequence[str] = ()) -> DataFrame:
    """(block, doc_id, text) dealt by a hash of doc_id and text: neither a hot source nor a repeated or null id fills a block.

    carry: other columns that ride along, as one struct `carried`."""
    carried = [F.struct(*(F.col(f"`{name}`") for name in carry)).alias("carried")] if carry else []
    keyed = docs.select(block_of(n), "doc_id", F.col("text").cast("string").alias("text"), *carried)
    return keyed.repartition(n, "block")


def ordered(rows: pa.Table) -> pa.Table:
    """Rows of a block in an order that a rerun repeats, whatever order the shuffle brought them in."""
    return rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def raw_text(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, base = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=base + n + 1)[base:] if n else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return offsets, data


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes; every row is in one range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        x = np.full(size, np.uint64(base))
        x[0] = 1
        _POWERS[base] = have = np.cumprod(x, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Polynomial fingerprints modulo 2**64 of every range of one array, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def words_of(segment: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every `[^\\x20\\x09-\\x0D]+` in rows that lie end to end; bounds has len(rows)+1 offsets."""
    n = len(segment)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[segment]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    row = np.searchsorted(bounds, start, side="right") - 1
    return start, end, row


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word of rows that lie end to end, and the number of words of each row."""
    hashes, count = [], np.zeros(len(offsets) - 1, np.int64)
    digest = xxhash.xxh64_intdigest
    for r in range(len(count)):
        words = data[offsets[r] : offsets[r + 1]].tobytes().split()
        count[r] = len(words)
        hashes.append(np.fromiter(map(digest, words), np.uint64, len(words)))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), count


def slide(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every width consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        values = op(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return op(values[: len(values) - rest], values[rest:]) if rest else values


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit words as differences, cut into byte planes; planes of zeros are left out."""
    if not len(values):
        return b""
    step = np.diff(values)
    wide = (int(step.max()).bit_length() + 7) // 8 if len(step) else 0
    planes = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return int(values[0]).to_bytes(8, "little") + bytes([wide]) + planes.tobytes()


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    wide = data[8]
    step = np.zeros((n, 8), np.uint8)
    step[0] = np.frombuffer(data, np.uint8, 8)
    if n > 1 and wide:
        step[1:, :wide] = np.frombuffer(data, np.uint8, offset=9).reshape(wide, n - 1).T
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64)


def bucket_edges(sorted_words: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the 64-bit words begins; n+1 positions."""
    cuts = np.array([(i << 64) // n for i in range(n)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_words, cuts), len(sorted_words))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, spark.checkpoint.dir where none is set yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or (LOCAL if context.master.startswith("local") else None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: Where one machine is the whole cluster, as in tests.
LOCAL = "/tmp/tessera-checkpoints"


def deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # the store's own reader: any scheme
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def reliable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's shared checkpoint folder: its lineage is cut and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: columns that a reader leaves out are not read."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
