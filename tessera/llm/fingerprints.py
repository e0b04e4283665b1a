"""Document fingerprints by locally consistent parsing (operator 6).

A text's bytes are the symbols of level 0. A level parses its sequence of symbols into phrases and names each by a hash
of its content; the names are the symbols of the next level. Runs of one symbol become one symbol with a count. Then
deterministic coin tossing: each symbol is labelled by the lowest bit in which its name differs from its left
neighbour's, and by that bit; `TOSSES` rounds leave six labels, of which neighbours always differ, and a phrase begins
wherever a label is greater than both of its neighbours. Where a phrase begins depends on a few symbols around it only,
so equal substrings are parsed into equal phrases but for their ends, wherever they stand.

A fingerprint holds `BINS` minima (16 bits each) of the phrase names of two levels: the highest, up to `LEVELS`, on which
the text has `PHRASES` phrases or more, and the one below. The likeness of two fingerprints is the share of equal bins
among those that either fills, over the levels that both have: an estimate of the phrases that they share.

The edited texts need each document's successor. Documents are dealt by ranges of doc_id and pass by in order; only the
last of each range needs a row of another range. It meets the first of the next range in a join on the range's number;
only across ranges without rows, and from the last range to the first, are what is left over numbered and matched.

Defined cases: null or empty text has no phrases, its own fingerprint, and is like an empty text (1) and unlike any other
(0); rows with equal ids follow each other by a hash of the text, then the text; a null doc_id comes first; a single row is its own successor; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, mix, partitions_for, powers, raw_text, stored

LEVELS, PHRASES, BINS, TOSSES = 4, 48, 32, 4
BASE = 0xD6E8FEB86659FD93 | 1
#: Bytes parsed at once.
CHUNK = 1 << 18

OUT_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
OUT = pa.schema(list(zip(OUT_NAMES, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)))
OUT_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE_DDL = f"{OUT_DDL}, place int, first boolean, text string"


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64)


def _toss(labels: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """One round: twice the place of the lowest bit that differs from the left neighbour, plus that bit."""
    before = np.empty_like(labels)
    before[0] = 0
    before[1:] = labels[:-1]
    place = np.where(lead, np.uint64(0), _lowest_bit(labels ^ before))
    return np.uint64(2) * place + ((labels >> place) & np.uint64(1))


def parse(names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and rows of the phrases of sequences that lie end to end; row says whose each symbol is."""
    if not len(names):
        return names, row
    new = np.append(True, (names[1:] != names[:-1]) | (row[1:] != row[:-1]))
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(names)))
    names, row = names[at], row[at]
    names = np.where(run > 1, mix(names * np.uint64(BASE) + run.astype(np.uint64)), names)
    lead = np.append(True, row[1:] != row[:-1])
    labels = names
    for _ in range(TOSSES):
        labels = _toss(labels, lead)
    labels = labels.astype(np.int8)
    left, right = np.append(-1, labels[:-1]), np.append(labels[1:], -1)
    left[lead] = 127
    right[np.append(lead[1:], True)] = -1
    begin = np.flatnonzero(lead | ((labels > left) & (labels > right)))
    length = np.diff(np.append(begin, len(names)))
    place = np.arange(len(names)) - np.repeat(begin, length)
    total = np.add.reduceat(mix(names) * powers(BASE, int(length.max()))[place], begin)
    return mix(total + length.astype(np.uint64)), row[begin]


def sketches(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of 1 + 2 * BINS numbers (level, minima of the level below, minima of the level) for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, 1 + 2 * BINS), np.uint16)
    for i, j in chunks(offsets, CHUNK):
        m = j - i
        names = data[offsets[i] : offsets[j]].astype(np.uint64)
        row = np.repeat(np.arange(m), np.diff(offsets[i : j + 1]))
        minima, level = [], np.zeros(m, np.uint16)
        for k in range(LEVELS + 1):
            if k:
                names, row = parse(names, row)
            many = np.bincount(row, minlength=m)
            level = np.where((many >= PHRASES) | (k <= 1), k, level).astype(np.uint16)
            minima.append(_minima(names, row, m, k))
        below = np.maximum(level, 1) - 1
        table = np.stack(minima)
        rows = np.arange(m)
        out[i:j, 0] = level
        out[i:j, 1 : 1 + BINS] = table[below, rows]
        out[i:j, 1 + BINS :] = table[level, rows]
    return out


def _minima(names: np.ndarray, row: np.ndarray, m: int, k: int) -> np.ndarray:
    """Least hash in each bin, as 1 to 65535; 0 is an empty bin. Level 0, single bytes, is no evidence."""
    if k == 0:
        return np.zeros((m, BINS), np.uint16)
    h = mix(names + np.uint64(k))
    bin_ = (h >> np.uint64(59)).astype(np.int64)
    least = np.full(m * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, row * BINS + bin_, h)
    empty = least == np.iinfo(np.uint64).max
    return np.where(empty, 0, least % np.uint64(65535) + np.uint64(1)).astype(np.uint16).reshape(m, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows of two arrays of sketches."""
    same, filled = np.zeros(len(a)), np.zeros(len(a))
    for x in (0, 1):
        for y in (0, 1):
            both = (a[:, 0].astype(int) - 1 + x) == (b[:, 0].astype(int) - 1 + y)
            u, v = a[:, 1 + x * BINS : 1 + (x + 1) * BINS], b[:, 1 + y * BINS : 1 + (y + 1) * BINS]
            same += np.where(both, ((u == v) & (u > 0)).sum(axis=1), 0)
            filled += np.where(both, ((u > 0) | (v > 0)).sum(axis=1), 0)
    equal = (a == b).all(axis=1)
    return np.where(equal, 1.0, same / np.maximum(filled, 1))


def hexed(sketch: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in sketch.astype(">u2")]


def edited(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by as many of the following text, or all it has."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _compare(ids: list, chain: list[str]) -> pa.RecordBatch:
    """Results of texts that follow each other; chain has one text more than ids, the last one's successor."""
    texts, size = chain[:-1], len(chain) - 1
    changed = [edited(chain[i], chain[i + 1]) for i in range(size)]
    own, new = (sketches(*raw_text(pa.array(x, pa.large_string()))) for x in (chain, changed))
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], hexed(own[:-1]), hexed(new), likeness(own[:-1], new), likeness(own[:-1], own[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OUT.types, strict=True)], schema=OUT)


def _with_edges(batch: pa.RecordBatch, place: int | None = None, first: bool | None = None, texts: list | None = None) -> pa.RecordBatch:
    n = len(batch)
    more = [pa.array([place] * n, pa.int32()), pa.array([first] * n, pa.bool_()), pa.array(texts or [None] * n, pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*OUT_NAMES, "place", "first", "text"])


def _edge(place: int, first: bool, doc_id: int | None, text: str) -> pa.RecordBatch:
    blank = pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for t in OUT.types[1:])], schema=OUT)
    return _with_edges(blank, place, first, [text])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range in; results for all but the last, and the first and last row as edges, out."""
    from pyspark import TaskContext

    place, held = TaskContext.get().partitionId(), None
    for batch in batches:
        ids, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
        if not ids:
            continue
        if held is None:
            yield _edge(place, True, ids[0], texts[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids[-1], texts[-1]
        for a, b in _slices(texts):
            yield _with_edges(_compare(ids[a:b], texts[a : b + 1]))
    if held is not None:
        yield _edge(place, False, *held)


def _slices(texts: list[str], size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of all but the last text, each of about size code points."""
    a, total = 0, 0
    for b in range(len(texts) - 1):
        total += len(texts[b])
        if total >= size:
            yield a, b + 1
            a, total = b + 1, 0
    if a < len(texts) - 1:
        yield a, len(texts) - 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    n = partitions_for(docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    done = stored(dealt.mapInArrow(_in_order, EDGE_DDL))
    lasts = done.where("place is not null and not first").select("doc_id", "text", "place")
    firsts = done.where("place is not null and first").select((F.col("place") - 1).alias("place"), F.col("text").alias("following"))
    met = lasts.join(firsts, "place").select("doc_id", "text", "following")
    # Where a range is empty: as many lasts as firsts stay alone, each last is followed by the next first, in a circle.
    alone, waiting = lasts.join(firsts, "place", "left_anti"), firsts.join(lasts, "place", "left_anti")
    in_order = Window.orderBy("place")
    waiting = waiting.withColumn("k", F.row_number().over(in_order) - 1)
    gaps = F.count("*").over(Window.partitionBy())
    alone = alone.withColumn("k", F.row_number().over(in_order) % gaps)
    met = met.unionByName(alone.join(waiting.drop("place"), "k").select("doc_id", "text", "following"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, *chain in zip(*(batch[name].to_pylist() for name in ("doc_id", "text", "following")), strict=True):
                yield _compare([doc_id], chain)

    return done.where("place is null").select(*OUT_NAMES).unionByName(met.mapInArrow(join_up, OUT_DDL))
