"""SimHash near-duplicates by bit-sliced comparison (operator 5).

A document's words are hashed in shingles; bit b of its fingerprint is set if over half of the shingles' hashes have
it. Fingerprints link at `radius` or fewer differing bits, and a component is what links reach. Two rules:

* `STRICT`: 3-word shingles, 64 bits, radius 3. One of four 16-bit blocks is equal, and of the other 48 bits one of four
  12-bit blocks: 16 keys of 28 bits find every pair.
* `NEAR`: 5-word shingles, 256 bits, radius 48, for a likeness (Jaccard, of shingles) of 0.8 or more, at which 39 bits
  differ in the mean, with a deviation of 6. No bits are sure to be equal at such a radius, so pairs are found by bands of
  minima: 16 keys, each of 5 least hashes under different multipliers, of which pairs of likeness 0.8 share one with
  probability 0.998, and more alike ones surer still.

Equal documents are one row before anything is compared, so copies cost nothing. Fingerprints that share a key are
stored as vertical bit planes, many keys in one block; distances are updated plane by plane with carry-save counters
that start so that they overflow beyond the radius, and machine words whose 64 candidates have all overflowed are
abandoned. Every key's fingerprints yield a spanning forest, never all pairs: one asks, those found are taken out of the
candidates and ask later. A key of more than `SPLIT` fingerprints is dealt to a triangle of chunk pairs, so that every
pair still meets in some task.

Defined cases: null or empty text, or text without words, has fingerprint zero and links like any other; fewer words
than a shingle make one shingle; repeated rows get the same fingerprint and component; component_id is the least
non-null doc_id reachable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, mix, raw_text, reliable
from tessera.llm.components import EDGE, components, contract, to_planes

SEED = 42
#: Fingerprints of one key that one task compares; a larger key is dealt to pairs of chunks.
SPLIT = 8192
#: A key of more fingerprints than this fills planes of its own, and many of them ask at once.
CROWD, ASK = 128, 128
#: Keys (fingerprints times 16) for each task.
TASK_KEYS = 2_000_000


@dataclass(frozen=True)
class Rule:
    """Words in a shingle, 64-bit words of a fingerprint, differing bits that still link; bands of minima, or none."""

    shingle: int
    wide: int
    radius: int
    bands: int = 0
    minima: int = 0

    @property
    def prints(self) -> list[str]:
        return [f"p{w}" for w in range(self.wide)]


STRICT = Rule(3, 1, 3)
NEAR = Rule(5, 4, 48, bands=16, minima=5)


def shingled(offsets: np.ndarray, data: np.ndarray, shingle: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Of texts that lie end to end: rows with words, where each one's shingles begin, and the XXH64 of all shingles."""
    digest = xxhash.xxh64_digest
    for i, j in chunks(offsets):
        hashes, begin, rows = [], [], []
        total = 0
        for r in range(i, j):
            words = data[offsets[r] : offsets[r + 1]].tobytes().lower().split()
            if not words:
                continue
            line = b" ".join(words)
            if len(words) <= shingle:
                hashes.append(digest(line, SEED))
                n = 1
            else:
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate(([0], ends[:-1] + 1))
                n = len(words) - shingle + 1
                hashes += [digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
            begin.append(total)
            rows.append(r)
            total += n
        if rows:
            yield rows, begin, b"".join(hashes)


def fingerprints(batch: pa.RecordBatch, rule: Rule = STRICT) -> tuple[np.ndarray, np.ndarray]:
    """For every row's text the unsigned 64-bit words of its fingerprint, and the keys of its bands."""
    offsets, data = raw_text(batch["text"])
    n = len(offsets) - 1
    out, keys = np.zeros((n, rule.wide), np.uint64), np.zeros((n, rule.bands), np.uint64)
    for rows, begin, digests in shingled(offsets, data, rule.shingle):
        hashes = np.frombuffer(digests, ">u8").astype(np.uint64)
        many = np.diff(np.append(begin, len(hashes)))
        for w in range(rule.wide):
            own = mix(hashes + np.uint64(w)) if w else hashes
            bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
            out[rows, w] = np.packbits(2 * ones > many[:, None], axis=1).view(">u8").ravel()
        for band in range(rule.bands):
            key = np.full(len(rows), band, np.uint64)
            for k in range(rule.minima):
                multiplier = mix(np.array([band * rule.minima + k + 1], np.uint64)) | np.uint64(1)
                key = mix(key * np.uint64(31) + np.minimum.reduceat(hashes * multiplier, begin))
            keys[rows, band] = key
    return out, keys


def with_fingerprint(docs: DataFrame, rule: Rule = STRICT) -> DataFrame:
    """(doc_id, row_key, node, and for wide rules the words p0, p1.. and keys) of every row.

    row_key is a hash of id and text; node names what is compared, the fingerprint itself where it has one word."""
    wide = rule.wide > 1
    names = ["doc_id", "row_key", *(rule.prints if wide else ["node"]), *(["keys"] if rule.bands else [])]
    types = [pa.int64()] * (len(names) - bool(rule.bands)) + [pa.list_(pa.int64())] * bool(rule.bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = fingerprints(batch, rule)
            columns = [batch["doc_id"].cast(pa.int64()), batch["row_key"], *(pa.array(np.ascontiguousarray(p).view(np.int64)) for p in prints.T)]
            if rule.bands:
                at = pa.array(np.arange(0, keys.size + 1, rule.bands), pa.int32())
                columns.append(pa.ListArray.from_arrays(at, pa.array(keys.view(np.int64).ravel())))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip(names, types, strict=True))))

    ddl = ", ".join(f"{name} {'array<bigint>' if name == 'keys' else 'bigint'}" for name in names)
    found = docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(run, ddl)
    return found.withColumn("node", F.xxhash64(*rule.prints, "keys")) if wide else found


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def search_keys(value: Column) -> Column:
    """Array of 16 keys; fingerprints at distance 3 or less share one."""
    keys = []
    for a in range(4):
        block = F.shiftrightunsigned(value, 16 * a).bitwiseAND(F.lit(0xFFFF))
        low = value.bitwiseAND(F.lit((1 << 16 * a) - 1))
        high = F.shiftleft(F.shiftrightunsigned(value, 16 * a + 16), 16 * a) if a < 3 else F.lit(0)
        rest = high.bitwiseOR(low)
        for b in range(4):
            part = F.shiftrightunsigned(rest, 12 * b).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * a + b) << 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


def near(planes: np.ndarray, asked: np.ndarray, radius: int) -> np.ndarray:
    """Bitmaps of the stored words within radius, by carry-save counters over the planes.

    planes: (bits, machine words). asked: (bits, queries, 1), each query's bits as words of zeros or ones, for a bitmap for
    each query; or (bits, 1, machine words), planes of one query for each candidate. The counters start so that they
    overflow at radius + 1. After every eighth plane, machine words whose candidates have overflowed for all queries are
    abandoned."""
    width, each = planes.shape[1], asked.shape[2] > 1
    found = np.zeros((asked.shape[1], width), np.uint64)
    alive, ones = np.arange(width), np.uint64((1 << 64) - 1)
    bits = radius.bit_length()
    bias = (1 << bits) - 1 - radius
    count = [np.full(found.shape, ones if bias >> c & 1 else np.uint64(0)) for c in range(bits)]
    over = np.zeros(found.shape, np.uint64)
    for b in range(len(planes)):
        carry = planes[b] ^ asked[b]
        for c in range(bits):
            count[c], carry = count[c] ^ carry, count[c] & carry
        over |= carry
        if b % 8 == 7:
            live = (over != ones).any(axis=0)
            if not live.all():
                alive, planes, over = alive[live], planes[:, live], over[:, live]
                count = [x[:, live] for x in count]
                if each:
                    asked = asked[:, :, live]
                if not len(alive):
                    return found
    found[:, alive] = ~over
    return found


def _flags(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=n).astype(bool)


def crowd_forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (found, asker) of edges that span the components of one key's fingerprints; each asks once."""
    left = np.arange(len(prints))
    us, vs = [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        wave = np.array([seed])
        while len(wave) and len(left):
            askers = to_planes(prints[wave[:ASK]])
            asked = np.unpackbits(askers.view(np.uint8), axis=1, bitorder="little", count=len(wave[:ASK])).astype(np.uint64) * np.uint64((1 << 64) - 1)
            hit = _flags(np.bitwise_or.reduce(near(to_planes(prints[left]), asked[:, :, None], radius), axis=0), len(left))
            us.append(left[hit])
            vs.append(np.full(int(hit.sum()), seed))  # the wave's members are linked to the seed by now
            wave, left = np.concatenate([wave[ASK:], left[hit]]), left[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def pooled_forest(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for the fingerprints of many keys at once; group is sorted and says whose each is.

    In each round every key has one asker: one that was found and has not asked, or else a new one."""
    place, queued = np.arange(len(prints)), np.zeros(len(prints), dtype=bool)
    us, vs = [], []
    while True:
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(lead, len(group)))
        # A key with one candidate left, and none to ask for it, is done.
        busy = np.repeat((np.add.reduceat(~queued, lead) > 0) & (size > 1), size) if len(lead) else np.zeros(0, dtype=bool)
        place, queued, group = place[busy], queued[busy], group[busy]
        if not len(place):
            break
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(lead, len(group)))
        at = np.arange(len(place))
        asker = np.minimum.reduceat(np.where(queued, at, at + len(at)), lead) % len(at)
        asks = np.zeros(len(place), dtype=bool)
        asks[asker] = True
        candidate = np.flatnonzero(~queued & ~asks)
        if len(candidate):
            of = np.repeat(asker, size)[candidate]
            hit = _flags(near(to_planes(prints[place[candidate]]), to_planes(prints[place[of]])[:, None, :], radius)[0], len(candidate))
            us.append(place[candidate[hit]])
            vs.append(place[of[hit]])
            queued[candidate[hit]] = True
        place, queued, group = place[~asks], queued[~asks], group[~asks]
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _linker(rule: Rule):
    """Rows (key, pair, node, words) sorted by key and pair in, edges out; memory holds a batch and one key's chunk pair."""
    columns = rule.prints if rule.wide > 1 else ["node"]

    def edges(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        small = np.flatnonzero((size[group] > 1) & (size[group] <= CROWD))
        parts = [(small, pooled_forest(prints[small], group[small], rule.radius))] if len(small) else []
        for g in np.flatnonzero(size > CROWD):
            own = np.flatnonzero(group == g)
            parts.append((own, crowd_forest(prints[own], rule.radius)))
        for own, (u, v) in parts:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[own[u]]), pa.array(nodes[own[v]])], schema=EDGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, prints = np.zeros((2, 0), np.int64), np.zeros(0, np.int64), np.zeros((0, rule.wide), np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, np.stack([batch["key"].to_numpy(), batch["pair"].to_numpy()])], axis=1)
            nodes = np.concatenate([nodes, batch["node"].to_numpy()])
            prints = np.concatenate([prints, np.stack([batch[c].to_numpy() for c in columns], axis=1).view(np.uint64)])
            last = (keys == keys[:, -1:]).all(axis=0)
            cut = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
            if cut:
                yield from edges(keys[:, :cut], nodes[:cut], prints[:cut])
                keys, nodes, prints = keys[:, cut:], nodes[cut:], prints[cut:]
        if len(nodes):
            yield from edges(keys, nodes, prints)

    return run


def links(nodes: DataFrame, rule: Rule = STRICT) -> DataFrame:
    """Edges (u, v) between distinct nodes that keep every component whole; each partition a forest."""
    own = ["node", *(rule.prints if rule.wide > 1 else [])]
    keys = F.col("keys") if rule.bands else search_keys(F.col("node"))
    keyed = nodes.select(*own, F.explode(keys).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > SPLIT).select("key", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts"))
    joined = keyed.join(large, "key", "left")
    chunk = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda c: F.least(c, F.col("chunk")) * F.col("parts") + F.greatest(c, F.col("chunk")).cast("bigint"))
    single = joined.where("parts is null").select("key", F.lit(0).cast("bigint").alias("pair"), *own)
    dealt = joined.where("parts is not null").withColumn("chunk", chunk).select("key", F.explode(others).alias("pair"), *own)
    tasks = max(math.ceil(16 * nodes.count() / TASK_KEYS), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    linker = _linker(rule)
    return single.union(dealt).repartition(tasks, "key", "pair").sortWithinPartitions("key", "pair").mapInArrow(lambda batches: contract(linker(batches)), "u bigint, v bigint")


def _rooted(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """with_fingerprint() of every row; and (node, least, root): root names the component, least is the node's least row."""
    rows = reliable(with_fingerprint(docs, rule))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least")
    carried = [F.first(name).alias(name) for name in ([*rule.prints, "keys"] if rule.bands else [])]
    nodes = reliable(rows.groupBy("node").agg(least, *carried))
    rooted = reliable(components(links(nodes, rule), contracted=True)).withColumnRenamed("node", "of")
    return rows, nodes.join(rooted, nodes["node"] == rooted["of"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, rule: Rule = STRICT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits for each word), component_id for every row of docs."""
    rows, named = _rooted(docs, rule)
    least = named.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    known = named.join(least, "root").select("node", "component_id")
    words = rule.prints if rule.wide > 1 else ["node"]
    hexed = F.concat(*(F.lower(F.lpad(F.hex(w), 16, "0")) for w in words)).alias("fingerprint")
    return rows.join(known, "node").select("doc_id", hexed, "component_id")


def survivors(docs: DataFrame, rule: Rule = NEAR) -> DataFrame:
    """One row of docs, all columns unchanged, of each component: that of the least doc_id (null only if all are null), of
    rows with this id the one of the least node, then of the least hash of id and text. Of rows alike in id and text any."""
    rows, named = _rooted(docs, rule)
    best = named.groupBy("root").agg(F.min(F.struct("least.none", "least.doc_id", "node", "least.row_key")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("id"), F.col("best.row_key").alias("own"), F.col("best.node").alias("of"))
    met = (rows["node"] == best["of"]) & (rows["row_key"] == best["own"]) & rows["doc_id"].eqNullSafe(best["id"])
    kept = reliable(rows.join(best, met).groupBy("own", "id").count())
    found = docs.withColumn(MARK, row_key()).join(kept, (F.col(MARK) == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")))
    if kept.where("count > 1").head(1):
        found = found.withColumn(MARK, F.row_number().over(Window.partitionBy("own", "id").orderBy(F.lit(0)))).where(F.col(MARK) == 1)
    return found.select(*(F.col(f"`{name}`") for name in docs.columns))


#: Name of a column that no table has.
MARK = "__simhash_mark"
