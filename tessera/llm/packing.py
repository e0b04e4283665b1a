"""Best-fit packing of documents into sequences (operator 4).

A document becomes its ids by a public vocabulary and one end id. Only documents longer than a sequence are cut, into
whole sequences and a rest. Pieces are dealt to bins by bounded-space online best-fit: `OPEN` bins are open at a time,
a bitset holds which amounts of free space some open bin has, a piece goes to the fullest bin that has room (the lowest
set bit at or above its length), and when no bin fits and all places are taken the fullest open bin closes first.

Tokenising is one narrow pass; only (doc_id, piece, start, length, crc32) is shuffled, never text or ids. Pieces are
dealt by a hash of what they are to lanes of about `LANE` documents, and arrive there in the order of that hash, so that a
rerun packs alike. Of the arrivals `AHEAD` are held at a time and the longest goes first, so that short ones fill the
gaps: at sf0.1 that takes 2,270 sequences, as few as the tokens fill, where arrivals one by one take 2,283. A lane of
20,000 documents makes some 4,500 bins, so most of them close while others arrive. A bin's rows go out when it closes: a
lane holds its open bins and what it looks ahead, however long it is. What lanes leave open is packed once more, whole
bins as pieces.

Defined cases: null or empty text is the end id alone; repeated rows are packed each for itself; a null doc_id is
carried; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import raw_text, reliable
from tessera.llm.tokens import vocabulary, word_bpe

LENGTH, END, OPEN, AHEAD = 4096, 1, 256, 2048
#: Documents for each packing task.
LANE = 20_000

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("twin", pa.int64())])
PIECE_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, twin bigint"
OUT = pa.schema([*list(PIECE)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])
OUT_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class Bins:
    """Bounded-space online best-fit. put() gives (bin, offset); closed lists bins that get no more, until it is taken."""

    def __init__(self, capacity: int = LENGTH, room: int = OPEN):
        self.capacity, self.room = capacity, room
        self.free_of: dict[int, int] = {}
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.bits = 0  # bit f is set if some open bin has f free
        self.made = 0
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        bin_ = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        del self.free_of[bin_]
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if len(self.free_of) >= self.room:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.free_of[bin_] = left
            self.bins[left].append(bin_)
            self.bits |= 1 << left
        else:
            self.closed.append(bin_)
        return bin_, self.capacity - free


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary_path: str | None = None) -> DataFrame:
    """One row for each piece of each document."""
    path = vocabulary_path or vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_bpe(path)
        end = END.to_bytes(4, "little")
        for batch in batches:
            offsets, data = raw_text(batch["text"])
            ids, rows = batch["doc_id"].to_pylist(), []
            for r in range(len(ids)):
                whole = words.ids(data[offsets[r] : offsets[r + 1]].tobytes()) + end
                twin = zlib.crc32(whole)
                for piece, at in enumerate(range(0, len(whole), 4 * length)):
                    part = whole[at : at + 4 * length]
                    rows.append((ids[r], piece, at // 4, len(part) // 4, zlib.crc32(part), twin))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECE.types, strict=True)], schema=PIECE)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_DDL)


def _arrivals(batches: Iterator[pa.RecordBatch], names: list[str], size: str) -> Iterator[tuple[int, list[tuple]]]:
    """(lane, rows) of a lane's next AHEAD arrivals, longest first; (lane, []) where a lane ends."""
    lane, held = None, []
    at = names.index(size)

    def out() -> tuple[int, list[tuple]]:
        return lane, sorted(held, key=lambda row: -row[at])

    for batch in batches:
        for of, *row in zip(*(batch[name].to_pylist() for name in ("lane", *names)), strict=True):
            if of != lane:
                if lane is not None:
                    yield out()
                    yield lane, []
                lane, held = of, []
            held.append(tuple(row))
            if len(held) >= AHEAD:
                yield out()
                held = []
    if lane is not None:
        yield out()
        yield lane, []


def _first_pass(length: int, room: int):
    """Packs lanes; rows of bins that are still open at a lane's end have what is used of them in `left`, others 0."""
    types = [*OUT.types, pa.int64()]
    names = [*OUT.names, "left"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, rows = Bins(length, room), {}
        for lane, arrived in _arrivals(batches, OUT.names[:5], "length"):
            for row in arrived:
                bin_, offset = bins.put(row[3])
                rows.setdefault(bin_, []).append((*row, (lane << 32) + bin_, offset))
            done = [(*row, 0) for bin_ in bins.closed for row in rows.pop(bin_)]
            bins.closed.clear()
            if not arrived:
                done += [(*row, length - bins.free_of[bin_]) for bin_, own in rows.items() for row in own]
                bins, rows = Bins(length, room), {}
            if done:
                yield batch_of(done)

    return run


def _second_pass(length: int, room: int):
    """Packs open bins into bins: (sequence_id, used) in, (sequence_id, into, shift) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, home = Bins(length, room), {}
        for _, arrived in _arrivals(batches, ["sequence_id", "left"], "left"):
            if not arrived:
                bins, home = Bins(length, room), {}
                continue
            out = []
            for sequence, used in arrived:
                bin_, offset = bins.put(used)
                out.append((sequence, home.setdefault(bin_, sequence), offset))
            for bin_ in bins.closed:
                home.pop(bin_, None)
            bins.closed.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["was", "into", "shift"])

    return run


def pack(docs: DataFrame, length: int = LENGTH, room: int = OPEN, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    lanes = max(1, math.ceil(docs.count() / LANE))
    order = F.xxhash64("doc_id", "piece", "twin")
    dealt = pieces(docs, length, vocabulary_path).withColumn("order", order).withColumn("lane", F.pmod(F.xxhash64("order", F.lit(7)), F.lit(lanes)).cast("int"))
    sorted_ = dealt.repartition(lanes, "lane").sortWithinPartitions("lane", "order", "doc_id", "piece", "twin")
    first = reliable(sorted_.mapInArrow(_first_pass(length, room), f"{OUT_DDL}, left bigint"))
    again = max(1, lanes * room // LANE)
    open_ = first.where("left > 0").groupBy("sequence_id").agg(F.max("left").alias("left"))
    open_ = open_.withColumn("lane", F.pmod(F.xxhash64("sequence_id"), F.lit(again)).cast("int"))
    moved = open_.repartition(again, "lane").sortWithinPartitions("lane", F.xxhash64("sequence_id")).mapInArrow(_second_pass(length, room), "was bigint, into bigint, shift bigint")
    both = first.join(moved, first["sequence_id"] == moved["was"], "left")
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
