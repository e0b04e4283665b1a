"""Substring dedup over a log-structured fingerprint index (operator 8).

A window is `width` consecutive words of one document. A word goes if some window over it has a word sequence that
also starts anywhere else, in the same document or another; windows are judged on the input.

Index. Every window holds shorter windows of `GRAM` words, and the one of least hash stands for it: equal windows have
equal ones, and about one position in ten is the least of some window. Each batch of documents becomes one level of the
index, a sorted immutable run of these hashes for each range (bucket) of them, each hash with the block of documents
that holds it. Levels are merge-joined: a hash that another block holds, or one block twice, is sent to its blocks.
When `FANOUT` levels have come together they are compacted into one.

Verification. Only windows whose least hash repeats are looked at, and they are compared by a 128-bit BLAKE2b digest of
their words, exchanged in sorted runs (runs.py): a window goes only if the digest of its words repeats.

`dedup` sends a table through an index in `BATCHES` batches and judges all of it; `FingerprintIndex.add` judges each new
batch against itself and the history, of which it reads again the blocks of documents that hold a hash of the batch.

Defined cases: null or empty text has no words (n_words 0, the digest of the empty string); documents shorter than a
window keep all words; repeated rows (equal ids too) count as separate documents and so remove each other's windows;
a null doc_id is carried; an empty table gives an empty result; columns other than doc_id and text are ignored, or ride
along in `without_repeats`, which returns the columns of its input: a text that loses words becomes its kept words with
one space between, any other stays as it is. A text is held whole by one task, however long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import runs
from tessera.llm.common import Rolling, block_of, bucket_edges, chunks, deleted, in_blocks, mix, ordered, pack_sorted, partitions_for, raw_text, shared_folder, slide, stored, unpack_sorted, word_hashes

WIDTH, GRAM = 35, 16
#: Batches in which a whole table enters the index, and levels that are compacted into one.
BATCHES, FANOUT = 2, 2
#: Entries of one row of a level.
ROW = 1 << 20
BASE = 0xE7037ED1A0B428DB

LEVEL = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("payload", pa.binary()), ("blocks", pa.binary()), ("many", pa.binary())])
LEVEL_DDL = "bucket int, n int, payload binary, blocks binary, many binary"
REPEATS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])
REPEATS_DDL = "block int, bucket int, n int, payload binary"
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
OUT_DDL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def least_hashes(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, its least gram's hash, and (place, hash) of all grams that are a window's least."""
    gram = min(GRAM, width)
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
    at = np.arange(len(hashes) - gram + 1)
    grams = mix(Rolling(hashes, BASE).of(at, at + gram)) | np.uint64(1)
    inside = width - gram + 1
    least = slide(grams, inside, np.minimum)
    whole = row[: len(row) - width + 1] == row[width - 1 :]
    padded = np.zeros(len(least) + 2 * (inside - 1), np.uint64)
    padded[inside - 1 : inside - 1 + len(least)] = np.where(whole, least, np.uint64(0))
    # A gram is its windows' least if the greatest least of the windows that hold it is its own hash.
    place = np.flatnonzero(slide(padded, inside, np.maximum)[: len(grams)] == grams)
    first = np.flatnonzero(whole)
    return first, least[first], np.stack([place, grams[place].view(np.int64)])


def entries(offsets: np.ndarray, data: np.ndarray, block: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (hash, block) of the grams that are least, each once, and whether it stands at two places or more."""
    found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in chunks(offsets):
        hashes, count = word_hashes(offsets[i : j + 1], data)
        row = np.repeat(np.arange(i, j), count)
        place, values = least_hashes(hashes, row, width)[2]
        found.append(values.view(np.uint64))
        owner.append(block[row[place]])
    hashes, owners = np.concatenate(found), np.concatenate(owner)
    return joined(hashes, owners, np.zeros(len(hashes), dtype=bool))


def joined(hashes: np.ndarray, blocks: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order, each (hash, block) once; many also where it came more than once."""
    order = np.lexsort((blocks, hashes))
    hashes, blocks, many = hashes[order], blocks[order], many[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (blocks[1:] != blocks[:-1])
    lead = np.flatnonzero(new)
    size = np.diff(np.append(lead, len(hashes)))
    return hashes[lead], blocks[lead], np.logical_or.reduceat(many, lead) | (size > 1) if len(lead) else many


def level_rows(bucket: int, hashes: np.ndarray, blocks: np.ndarray, many: np.ndarray) -> list[dict]:
    press = zstandard.ZstdCompressor(level=1).compress
    return [
        {"bucket": bucket, "n": len(hashes[i : i + ROW]), "payload": pack_sorted(hashes[i : i + ROW]), "blocks": press(blocks[i : i + ROW].astype("<i4").tobytes()), "many": np.packbits(many[i : i + ROW]).tobytes()}
        for i in range(0, len(hashes), ROW)
    ]


def read_level(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of one bucket, merged over its rows."""
    unpress = zstandard.ZstdDecompressor().decompress
    parts = [(unpack_sorted(r["payload"], r["n"]), np.frombuffer(unpress(r["blocks"]), "<i4"), np.unpackbits(np.frombuffer(r["many"], np.uint8), count=r["n"]).astype(bool)) for r in rows.to_pylist()]
    return joined(*(np.concatenate(column) for column in zip(*parts, strict=True)))


def candidates(offsets: np.ndarray, data: np.ndarray, width: int, repeated: np.ndarray) -> np.ndarray:
    """A flag for every window, in the order of rows and positions: its least hash is among the sorted repeated ones."""
    out = [np.zeros(0, dtype=bool)]
    for i, j in chunks(offsets):
        hashes, count = word_hashes(offsets[i : j + 1], data)
        least = least_hashes(hashes, np.repeat(np.arange(j - i), count), width)[1]
        out.append(repeated[np.minimum(np.searchsorted(repeated, least), len(repeated) - 1)] == least if len(repeated) else np.zeros(len(least), dtype=bool))
    return np.concatenate(out)


def digests(offsets: np.ndarray, data: np.ndarray, width: int, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low words of the digests of the words of the windows that are hit."""
    out, done, digest = [], 0, hashlib.blake2b
    for r in range(len(offsets) - 1):
        words = data[offsets[r] : offsets[r + 1]].tobytes().split()
        windows = max(0, len(words) - width + 1)
        first = np.flatnonzero(hit[done : done + windows])
        done += windows
        if len(first):
            line = b" ".join(words)
            end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            start = np.append(0, end[:-1] + 1)
            out += [digest(line[a:b], digest_size=16).digest() for a, b in zip(start[first].tolist(), end[first + width - 1].tolist(), strict=True)]
    pair = np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def distinct_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs (high, low), whether each occurs twice or more, and each input's place among them."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    return high[order[lead]], low[order[lead]], np.diff(np.append(lead, len(order))) > 1, place


def _kept(table: pa.Table, width: int, hit: np.ndarray | None, whole: bool = False) -> pa.Table:
    """The rows of OUT, and what rides along, given a flag for every window (None: none is hit).

    whole: a text that loses nothing comes back as it was, not as its words."""
    offsets, data = raw_text(table["text"])
    ids = table["doc_id"].to_pylist()
    rows: dict[str, list] = {name: [] for name in OUT.names}
    done = 0
    for r in range(len(ids)):
        words = data[offsets[r] : offsets[r + 1]].tobytes().split()
        n, windows = len(words), max(0, len(words) - width + 1)
        first = np.flatnonzero(hit[done : done + windows]) if hit is not None else ()
        done += windows
        if len(first):
            cover = np.zeros(n + 1, np.int64)
            cover[first] += 1
            np.subtract.at(cover, first + width, 1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
        text = b" ".join(words)
        kept = table["text"][r].as_py() if whole and not len(first) else text.decode("utf-8", "replace")
        for name, value in zip(OUT.names, (ids[r], n, n - len(words), hashlib.sha256(text).hexdigest(), kept), strict=True):
            rows[name].append(value)
    out = pa.table(rows, schema=OUT)
    return out.append_column("carried", table["carried"]) if "carried" in table.column_names else out


class FingerprintIndex:
    """The history as levels of sorted immutable runs under `path`, for batches that arrive over time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, width: int = WIDTH):
        self.spark, self.path, self.buckets, self.width = spark, path.rstrip("/"), buckets, width
        self.levels: list[str] = []
        self.texts: list[str] = []
        self.blocks = 0

    def append(self, dealt: DataFrame) -> None:
        """Adds a batch (block, doc_id, text) as a level of its own; compacts where levels have come together."""
        buckets, width = self.buckets, self.width

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes, blocks, many = entries(*raw_text(batch["text"]), batch["block"].to_numpy().astype(np.int64), width)
                edges = bucket_edges(hashes, buckets)
                rows = [row for b in np.flatnonzero(np.diff(edges)) for i, j in [(edges[b], edges[b + 1])] for row in level_rows(int(b), hashes[i:j], blocks[i:j], many[i:j])]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=LEVEL)

        self._write(dealt.select("block", "text").mapInArrow(write, LEVEL_DDL))
        if len(self.levels) >= FANOUT:
            self.compact()

    def _write(self, rows: DataFrame) -> None:
        def one(table: pa.Table) -> pa.Table:
            return pa.Table.from_pylist(level_rows(table["bucket"][0].as_py(), *read_level(table)), schema=LEVEL)

        level = f"{self.path}/level-{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "bucket").groupBy("bucket").applyInArrow(one, LEVEL_DDL).write.parquet(level)
        self.levels.append(level)

    def compact(self) -> None:
        """Merges all levels into one, written beside them; they go when it is whole."""
        if len(self.levels) > 1:
            before, self.levels = self.levels, []
            self._write(self.spark.read.parquet(*before))
            for level in before:
                deleted(self.spark, level)

    def repeats(self, since: int = 0) -> DataFrame:
        """block, bucket and the sorted hashes that repeat, for every block that holds any.

        since: only hashes that a block with at least this number holds."""

        def one(table: pa.Table) -> pa.Table:
            bucket = table["bucket"][0].as_py()
            hashes, blocks, many = read_level(table)
            lead = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            size = np.diff(np.append(lead, len(hashes)))
            good = ((size > 1) | np.logical_or.reduceat(many, lead)) & (np.maximum.reduceat(blocks, lead) >= since)
            hashes, blocks = hashes[np.repeat(good, size)], blocks[np.repeat(good, size)]
            order = np.argsort(blocks, kind="stable")
            hashes, blocks = hashes[order], blocks[order]
            cut = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(blocks)) if len(blocks) else [0]
            rows = [{"block": int(blocks[i]), "bucket": bucket, "n": int(j - i), "payload": pack_sorted(hashes[i:j])} for i, j in zip(cut[:-1], cut[1:], strict=True)]
            return pa.Table.from_pylist(rows, schema=REPEATS)

        return self.spark.read.parquet(*self.levels).repartition(self.buckets, "bucket").groupBy("bucket").applyInArrow(one, REPEATS_DDL)

    def judged(self, dealt: DataFrame, n: int, repeats: DataFrame, since: int = 0, whole: bool = False) -> DataFrame:
        """The rows of OUT (and `carried`, where dealt has it) of blocks from `since` on, all of dealt being compared.

        n: blocks of dealt, which is partitioned by them."""
        width = self.width
        carried = "carried" in dealt.columns
        out_ddl = OUT_DDL + (f", carried {dealt.schema['carried'].dataType.simpleString()}" if carried else "")

        def digest_runs(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
            parts = sorted((r["bucket"], r["n"], r["payload"]) for r in replies.to_pylist())
            if not parts or not len(table):
                return runs.RUN.empty_table()
            offsets, data = raw_text(ordered(table)["text"])
            hit = candidates(offsets, data, width, np.concatenate([unpack_sorted(payload, m) for _, m, payload in parts]))
            high, low, multi, _ = distinct_pairs(*digests(offsets, data, width, hit))
            block = key[0].as_py()
            return pa.Table.from_pylist([*runs.write_runs(block, 1, high, multi, n, low), runs.passed_on(block, n, hit)], schema=runs.RUN)

        def keep(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
            if key[0].as_py() < since or not len(table):
                return pa.schema([*OUT, *([table.schema.field("carried")] if carried else [])]).empty_table()
            table, got = ordered(table), replies.to_pylist()
            hit = runs.read_flags(got)
            if hit is not None:
                hit[hit] = runs.read_replies(got, 1)[distinct_pairs(*digests(*raw_text(table["text"]), width, hit))[3]]
            return _kept(table, width, hit, whole)

        blocks = dealt.groupBy("block")
        verified = runs.merged(blocks.cogroup(repeats.groupBy("block")).applyInArrow(digest_runs, runs.RUN_DDL), n)
        return blocks.cogroup(verified.groupBy("block")).applyInArrow(keep, out_ddl)

    def add(self, docs: DataFrame) -> DataFrame:
        """Kept words of a new batch: windows that the history holds, or the batch elsewhere, go. The batch joins the history."""
        n, since = partitions_for(docs), self.blocks
        dealt = in_blocks(docs, n).withColumn("block", F.col("block") + since)
        place = f"{self.path}/texts-{since}"
        dealt.sortWithinPartitions("block").write.parquet(place)
        self.blocks += n
        new = self.spark.read.parquet(place)
        self.append(new)
        repeats = stored(self.repeats(since))
        everything = new
        if self.texts:
            held = self.spark.read.parquet(*self.texts)
            everything = new.unionByName(held.join(repeats.where(F.col("block") < since).select("block").distinct(), "block", "left_semi"))
        self.texts.append(place)
        return self.judged(everything.repartition(n, "block"), n, repeats, since)


def dedup(docs: DataFrame, width: int = WIDTH, carry: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row for each row of docs.

    carry: columns of docs that ride along, as one struct `carried`. whole: kept_text of a text that loses nothing is the
    text as it was."""
    spark, n = docs.sparkSession, partitions_for(docs)
    index = FingerprintIndex(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}", max(1, n // 2), width)
    blocks = docs.select(block_of(n), F.col("text").cast("string").alias("text"))
    for batch in range(BATCHES):
        index.append(blocks.where(F.col("block") % BATCHES == batch))
    return index.judged(in_blocks(docs, n, carry), n, index.repeats(), whole=whole)


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated windows cut from the texts; n_chars, where there is one, follows."""
    others = [name for name in docs.columns if name not in ("doc_id", "text")]
    found = dedup(docs, width, others, whole=True)
    changed, columns = F.col("n_removed") > 0, {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    for name in others:
        columns[name] = F.col(f"carried.`{name}`")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*(columns[name].alias(name) for name in docs.columns))


def oracle_sql() -> str:
    return rf"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
    windows AS (
      SELECT r, p, word, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS span FROM words
    ), twice AS (SELECT span FROM windows WHERE len(span) = {WIDTH} GROUP BY span HAVING count(*) > 1),
    judged AS (
      SELECT r, p, word, coalesce(bool_or(found) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW), false) AS gone
      FROM (SELECT w.*, t.span IS NOT NULL AS found FROM windows w LEFT JOIN twice t ON w.span = t.span)
    ), kept AS (
      SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS left_over FROM judged GROUP BY r
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (r)"""
