"""Suffix-array dedup by a common-prefix-aware distributed merge sort (operator 1).

A byte goes if it lies in a `LENGTH`-byte string that also starts in a document with a smaller doc_id. Strings are
judged on the input, in UTF-8 bytes, within documents.

Sparse suffixes. Every `LENGTH`-byte string holds `LENGTH - GRAM + 1` grams of `GRAM` bytes, and the one of least hash
is its anchor; equal strings have equal anchors. So only suffixes that start at an anchor are sorted, about one in
seventeen, each with the `REACH` bytes before it. A string around an anchor holds the `CONTEXT` bytes from the anchor on or
those up to its gram's end; anchors with neither in another document can't match: the first exchange (runs.py) finds the
others, and only these travel as text.

Merge sort. A block of documents sorts its anchored suffixes and sends each range of grams one front-coded run: the
length of the prefix shared with the suffix before, and the rest. The runs of a range are merged by a loser tree that
keeps, for every candidate, how many symbols (8-byte words) it shares with the last suffix that came out. Of two
candidates the one that shares more is smaller; only on a tie are symbols compared, and only those past the shared
ones. The merge yields the order and its common prefixes, which give classes of suffixes for every depth; with the
bytes before the anchor taken likewise, two classes name every `LENGTH`-byte string around an anchor exactly, and the
least doc_id of each is found. Every run is answered by one bit for each string around each of its suffixes.

A block sends equal suffixes once, with its least doc_id, so that a passage which a third of all documents hold is one
entry for each block. Blocks are dealt by a hash of doc_id; no source is hot.

Defined cases: null or empty text has 0 bytes and the digest of nothing; a null doc_id is neither smaller nor greater
and so takes no part; rows with equal ids don't remove each other's bytes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from tessera.llm import runs
from tessera.llm.common import Rolling, chunks, in_blocks, mix, ordered, partitions_for, raw_text, slide

LENGTH, GRAM = 50, 18
#: An anchor lies so far into a string at most; the strings around it start 0 to REACH bytes before it.
REACH = LENGTH - GRAM
#: Of a string that holds an anchor, the bytes from the anchor on or those up to its gram's end are so many at least.
CONTEXT = GRAM + REACH // 2
WORDS, LEFT_WORDS = -(-LENGTH // 8), REACH // 8
STRETCH = 1 << 17
#: Ranges of suffixes for each block: half a block's suffixes is what a merge holds, even if all of them match.
RANGES = 2
BASE = 0x9E3779B97F4A7C15

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
OUT_DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the grams that are least in some string of LENGTH bytes, and their hashes. Rows lie end to end."""
    places, hashes = [], []
    grams = REACH + 1
    for a in range(0, len(data) - LENGTH + 1, STRETCH):
        segment = data[a : a + STRETCH + LENGTH - 1]
        at = np.arange(len(segment) - GRAM + 1)
        h = mix(Rolling(segment.astype(np.uint64) + np.uint64(1), BASE).of(at, at + GRAM)) | np.uint64(1)
        least = slide(h, grams, np.minimum)
        padded = np.zeros(len(least) + 2 * (grams - 1), np.uint64)
        padded[grams - 1 : grams - 1 + len(least)] = least
        # A gram is an anchor if the least hash of some string that holds it is its own; the greatest such least is.
        hit = np.flatnonzero(slide(padded, grams, np.maximum)[: len(h)] == h)
        places.append(a + hit)
        hashes.append(h[hit])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


class Block:
    """Anchors of a block's rows that lie within one document, in an order that a rerun repeats."""

    def __init__(self, table: pa.Table):
        self.table = ordered(table)
        self.offsets, self.data = raw_text(self.table["text"])
        self.data = self.data[: self.offsets[-1]]
        ids = self.table["doc_id"].combine_chunks()
        self.known = np.asarray(pc.is_valid(ids))
        self.ids = np.asarray(pc.fill_null(ids, 0), dtype=np.int64)
        self.place, self.hash = anchors(self.data)
        self.row = np.searchsorted(self.offsets, self.place, side="right") - 1
        whole = (self.place + GRAM <= self.offsets[self.row + 1]) & self.known[self.row] if len(self.place) else np.zeros(0, bool)
        self.keep(whole)

    def keep(self, mask: np.ndarray) -> None:
        self.place, self.hash, self.row = self.place[mask], self.hash[mask], self.row[mask]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sorted hashes of the CONTEXT bytes from and up to each anchor's gram, whether two documents of the
        block have each, and for every anchor (after: first row, before: second row) its place, or -1 without the bytes."""
        own = np.zeros((2, len(self.place)), np.uint64)
        whole = np.zeros((2, len(self.place)), dtype=bool)
        for i, j in chunks(self.offsets):
            base, end = self.offsets[i], self.offsets[j]
            a, b = np.searchsorted(self.place, [base, end])
            at, row = self.place[a:b], self.row[a:b]
            rolling = Rolling(self.data[base:end].astype(np.uint64) + np.uint64(1), BASE)
            for side, start in enumerate((at, at + GRAM - CONTEXT)):
                fits = (start >= self.offsets[row]) & (start + CONTEXT <= self.offsets[row + 1])
                own[side, a:b][fits] = mix(rolling.of(start[fits] - base, start[fits] - base + CONTEXT) + np.uint64(side))
                whole[side, a:b] = fits
        ids = np.broadcast_to(self.ids[self.row], own.shape)[whole]
        distinct, which = np.unique(own[whole], return_inverse=True)
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        place = np.full(own.shape, -1)
        place[whole] = which
        return distinct, low < high, place

    def matched(self, again: np.ndarray) -> np.ndarray:
        """Flags of the anchors with a context that another document has, given flags of the distinct hashes."""
        return np.append(again, False)[self.keys()[2]].any(axis=0)


class Suffixes:
    """Anchored suffixes of a block, sorted by range of grams and bytes; equal ones (with the bytes before) are one."""

    def __init__(self, block: Block, ranges: int):
        n = len(block.place)
        begin, end = block.offsets[block.row], block.offsets[block.row + 1]
        right = np.minimum(end - block.place, LENGTH).astype(np.uint8)
        left = np.minimum(block.place - begin, REACH).astype(np.uint8)
        padded = np.concatenate([np.zeros(REACH, np.uint8), block.data, np.zeros(LENGTH, np.uint8)])
        views = np.lib.stride_tricks.sliding_window_view(padded, REACH + LENGTH)
        around = views[block.place] if n else np.zeros((0, REACH + LENGTH), np.uint8)
        after = np.zeros((n, 8 * WORDS), np.uint8)
        after[:, :LENGTH] = around[:, REACH:]
        after[np.arange(8 * WORDS) >= right[:, None]] = 0
        before = np.ascontiguousarray(around[:, :REACH][:, ::-1])
        before[np.arange(REACH) >= left[:, None]] = 0
        words, back = after.view(">u8").astype(np.uint64), before.view(">u8").astype(np.uint64)
        mixed = right.astype(np.uint64) * np.uint64(64) + left
        for column in (*words.T, *back.T):
            mixed = mix(mixed ^ column)
        # An anchor's hash is the least of many; hashed again, it deals grams evenly.
        bucket = ((mix(block.hash) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        ids = block.ids[block.row]
        order = np.lexsort((ids, mixed, *words.T[::-1], bucket))
        new = np.ones(n, dtype=bool)
        if n > 1:
            same = (words[order[1:]] == words[order[:-1]]).all(axis=1) & (back[order[1:]] == back[order[:-1]]).all(axis=1)
            new[1:] = ~(same & (right[order[1:]] == right[order[:-1]]) & (left[order[1:]] == left[order[:-1]]) & (bucket[order[1:]] == bucket[order[:-1]]))
        lead = order[new]
        self.entry = np.empty(n, np.int64)  # of each anchor
        self.entry[order] = np.cumsum(new) - 1
        self.bucket, self.ids = bucket[lead].astype(np.int64), ids[lead]  # ids: the least of the block
        self.words, self.after, self.before = words[lead], after[lead][:, :LENGTH], before[lead]
        self.right, self.left = right[lead], left[lead]

    def runs(self, block: int, ranges: int) -> list[dict]:
        edges = np.searchsorted(self.bucket, np.arange(ranges + 1))
        shared = common_bytes(self.words)
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            i, j = int(edges[b]), int(edges[b + 1])
            lcp = shared[i:j].copy()
            lcp[0] = 0
            column = np.arange(LENGTH)
            rest = self.after[i:j][(column >= lcp[:, None]) & (column < self.right[i:j, None])]
            parts = (lcp.astype(np.uint8), self.right[i:j], self.left[i:j], planes(self.ids[i:j]), self.before[i:j].T.ravel(), rest)
            packed = zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))
            rows.append({"bucket": int(b), "block": block, "turn": 1, "n": j - i, "payload": packed, "low": b"", "multi": b""})
        return rows


def planes(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def common_bytes(words: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each row of big-endian words shares with the row before, LENGTH at most; 0 for the first row.

    at: the first differing word of each row where that is known already, so that shared words aren't looked at again."""
    n, width = words.shape
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    if at is None:
        differ = words[1:] != words[:-1]
        at = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), width)))
    k = np.minimum(at[1:], width - 1)
    rows = np.arange(1, n)
    x = words[rows, k] ^ words[rows - 1, k]
    zeros = np.zeros(n - 1, np.int64)
    for byte in range(8):
        zeros += (x >> np.uint64(8 * (7 - byte))) == 0
    out[1:] = np.minimum(np.where(at[1:] >= width, 8 * width, 8 * k + zeros), 8 * width)
    return out


class Run:
    """A front-coded run, unpacked: words, shared words with the suffix before, and the rest of each entry."""

    def __init__(self, row: dict):
        n = self.n = row["n"]
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["payload"]), np.uint8)
        lcp, self.right, self.left = raw[:n].astype(np.int64), raw[n : 2 * n], raw[2 * n : 3 * n]
        self.ids = np.ascontiguousarray(raw[3 * n : 11 * n].reshape(8, n).T).view("<i8").ravel()
        self.before = np.ascontiguousarray(raw[11 * n : (11 + REACH) * n].reshape(REACH, n).T)
        rest = raw[(11 + REACH) * n :]
        column = np.arange(LENGTH)
        own = (column >= lcp[:, None]) & (column < self.right[:, None])
        after = np.zeros((n, 8 * WORDS), np.uint8)
        after[:, :LENGTH][own] = rest
        index = np.arange(n)
        for c in range(int(lcp.max(initial=0))):
            after[:, c] = after[np.maximum.accumulate(np.where(lcp <= c, index, 0)), c]
        self.words = after.view(">u8").astype(np.uint64)
        self.shared = np.where(lcp >= LENGTH, WORDS, lcp // 8)


def merge(runs_: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """Loser tree over sorted runs: places in the concatenated runs, in order, and words shared with the one before.

    hold[r] is what run r's candidate shares with the suffix that last passed it, which is the last one out on its path:
    the greater hold is the smaller suffix, and only equal holds look at words, past what is known to be equal."""
    k = 1
    while k < len(runs_):
        k *= 2
    words = [r.words.tolist() for r in runs_] + [[]] * (k - len(runs_))
    shared = [r.shared.tolist() for r in runs_] + [[]] * (k - len(runs_))
    base = np.concatenate(([0], np.cumsum([r.n for r in runs_]))).tolist()
    at, sizes = [0] * k, [len(w) for w in words]
    hold = [0 if n else -1 for n in sizes]
    now: list = [w[0] if w else None for w in words]
    loser = [0] * k
    width = WORDS

    def play(node: int) -> int:
        """Fills the tree below node; the winner's run."""
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if hold[b] > hold[a]:
            a, b = b, a
        elif hold[a] == hold[b] and hold[a] >= 0:
            j, x, y = hold[a], now[a], now[b]
            while j < width and x[j] == y[j]:
                j += 1
            if j < width and y[j] < x[j]:
                a, b = b, a
            hold[b] = j
        loser[node] = b
        return a

    a = play(1) if k > 1 else 0
    held = hold[a]
    out, common = [], []
    total = base[-1]
    while len(out) < total:
        i = at[a]
        out.append(base[a] + i)
        common.append(held)
        i += 1
        at[a] = i
        if i < sizes[a]:
            held = shared[a][i]
            now[a] = words[a][i]
        else:
            held = -1
        node = (a + k) >> 1
        while node:
            b = loser[node]
            other = hold[b]
            if other > held:
                loser[node], hold[a] = a, held
                a, held = b, other
            elif other == held and held >= 0:
                x, y, j = now[a], now[b], held
                while j < width and x[j] == y[j]:
                    j += 1
                if j < width and y[j] < x[j]:
                    loser[node], hold[a] = a, j
                    a, held = b, other
                else:
                    hold[b] = j
            node >>= 1
    return np.array(out, np.int64), np.array(common, np.int64)


def smaller_elsewhere(runs_: list[Run]) -> list[np.ndarray]:
    """For every entry of every run a bit o for each string that starts o bytes before the anchor and has a smaller doc_id."""
    order, shared = merge(runs_)
    words = np.concatenate([r.words for r in runs_])[order]
    right = np.concatenate([r.right for r in runs_])[order].astype(np.int64)
    left = np.concatenate([r.left for r in runs_])[order].astype(np.int64)
    ids = np.concatenate([r.ids for r in runs_])[order]
    before = np.concatenate([r.before for r in runs_])[order]
    common = common_bytes(words, shared)
    del words
    n = len(order)
    back = before.view(">u8").astype(np.uint64).reshape(n, LEFT_WORDS)
    by_left = np.lexsort(back.T[::-1])
    left_common = common_bytes(back[by_left])
    # Entries that are equal throughout are one class; its least doc_id stands for it in what follows.
    right_class = np.cumsum(common < LENGTH)
    left_class = np.empty(n, np.int64)
    left_class[by_left] = np.cumsum(left_common < REACH)
    key = ((right_class * (n + 2) + left_class) * 64 + right) * 64 + left if n < 1 << 25 else None
    _, lead, which = np.unique(key, return_index=True, return_inverse=True) if key is not None else (None, np.arange(n), np.arange(n))
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    lead_right, lead_left = right[lead], left[lead]
    found = np.zeros(len(lead), np.uint64)
    every = np.zeros(len(lead), np.uint64)
    for o in range(REACH + 1):
        valid = np.flatnonzero((lead_left >= o) & (lead_right >= LENGTH - o))
        every[valid] |= np.uint64(1 << o)
        if len(valid) < 2:
            continue
        deep = np.cumsum(common < LENGTH - o)[lead[valid]]
        wide = np.empty(n, np.int64)
        wide[by_left] = np.cumsum(left_common < o) if o else 0
        pair = deep * (n + 1) + wide[lead[valid]]
        sort = np.argsort(pair, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(pair[sort]) != 0))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(sort))))
        low = np.minimum.reduceat(least[valid][sort], start)[group]
        at = valid[sort]
        found[at[low < least[at]]] |= np.uint64(1 << o)
    mask = np.where(ids > least[which], every[which], found[which])
    answer = np.empty(n, np.uint64)
    answer[order] = mask
    return np.split(answer, np.cumsum([r.n for r in runs_])[:-1])


def _merge_range(rows: pa.Table) -> pa.Table:
    answers, kept = [], []
    for r in sorted(rows.to_pylist(), key=lambda r: r["block"]):
        if r["n"] < 0:
            answers.append({"block": r["block"], "bucket": r["bucket"], "turn": r["turn"], "n": r["n"], "bits": r["payload"]})
        else:
            kept.append(r)
    if kept:
        for r, mask in zip(kept, smaller_elsewhere([Run(r) for r in kept]), strict=True):
            bits = zstandard.ZstdCompressor(level=1).compress(planes(mask.view(np.int64)).tobytes())
            answers.append({"block": r["block"], "bucket": r["bucket"], "turn": 1, "n": r["n"], "bits": bits})
    return pa.Table.from_pylist(answers, schema=runs.REPLY)


def _masks(rows: list[dict]) -> np.ndarray:
    parts = []
    for _, n, bits in sorted((r["bucket"], r["n"], r["bits"]) for r in rows if r["turn"] == 1):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8)
        parts.append(np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel())
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _remove(block: Block, covered: np.ndarray) -> pa.Table:
    """The rows of OUT, given a flag for every byte of the block."""
    rows: dict[str, list] = {name: [] for name in OUT.names}
    for r in range(len(block.offsets) - 1):
        i, j = int(block.offsets[r]), int(block.offsets[r + 1])
        gone, text = covered[i:j], block.data[i:j]
        removed = int(np.count_nonzero(gone))
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0])) if removed else 0
        kept = (text[~gone] if removed else text).tobytes()
        for name, value in zip(OUT.names, (int(block.ids[r]) if block.known[r] else None, j - i, removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
            rows[name].append(value)
    return pa.table(rows, schema=OUT)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: one row for each row of docs."""
    n = partitions_for(docs)
    ranges = RANGES * n
    blocks = in_blocks(docs, n).groupBy("block")

    def first_runs(key: tuple, table: pa.Table) -> pa.Table:
        distinct, multi, _ = Block(table).keys()
        return pa.Table.from_pylist(runs.write_runs(key[0].as_py(), 0, distinct, multi, n), schema=runs.RUN)

    def suffix_runs(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        number, again = key[0].as_py(), runs.read_replies(replies.to_pylist(), 0)
        if not again.any():
            return runs.RUN.empty_table()
        block = Block(table)
        hit = block.matched(again)
        block.keep(hit)
        rows = Suffixes(block, ranges).runs(number, ranges)
        rows.append(runs.passed_on(number, n, hit))
        return pa.Table.from_pylist(rows, schema=runs.RUN)

    def keep(_: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        block, got = Block(table), replies.to_pylist()
        edge = np.zeros(len(block.data) + 1, np.int8)  # at most REACH + 1 strings begin or end at a byte
        flags = runs.read_flags(got)
        if flags is not None:
            block.keep(flags)
            suffixes, masks = Suffixes(block, ranges), _masks(got)
            ids, own = block.ids[block.row], masks[suffixes.entry]
            room = np.minimum(block.offsets[block.row + 1] - block.place, LENGTH), np.minimum(block.place - block.offsets[block.row], REACH)
            later = ids > suffixes.ids[suffixes.entry]
            for o in range(REACH + 1):
                hit = np.where(later, (room[1] >= o) & (room[0] >= LENGTH - o), (own >> np.uint64(o)) & np.uint64(1) == 1)
                start = block.place[hit] - o
                edge[start] += 1  # anchors differ, so these places do
                edge[start + LENGTH] -= 1
        return _remove(block, np.cumsum(edge[:-1], dtype=np.int16) > 0)

    first = runs.merged(blocks.applyInArrow(first_runs, runs.RUN_DDL), n)
    suffixes = blocks.cogroup(first.groupBy("block")).applyInArrow(suffix_runs, runs.RUN_DDL)
    second = suffixes.repartition(ranges, "bucket").groupBy("bucket").applyInArrow(lambda t: _merge_range(t), runs.REPLY_DDL)
    return blocks.cogroup(second.groupBy("block")).applyInArrow(keep, OUT_DDL)


def oracle_sql() -> str:
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
    strings AS (
      SELECT r, doc_id, p, b[p:p] AS byte, CASE WHEN p <= n - {LENGTH - 1} THEN b[p:p + {LENGTH - 1}] END AS span
      FROM (SELECT r, doc_id, b, octet_length(b) AS n, unnest(range(1, octet_length(b) + 1)) AS p FROM docs)
    ), first AS (SELECT span, min(doc_id) AS least FROM strings WHERE span IS NOT NULL GROUP BY span HAVING count(*) > 1),
    covered AS (
      SELECT r, p, byte, coalesce(bool_or(found) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), false) AS gone
      FROM (SELECT s.r, s.p, s.byte, f.least < s.doc_id AS found FROM strings s LEFT JOIN first f ON s.span = f.span)
    ), runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM covered),
    kept AS (
      SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(hex(byte), '' ORDER BY p) FILTER (NOT gone) AS left_over
      FROM runs GROUP BY r
    )
    SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(left_over, ''))) AS kept_sha256
    FROM docs LEFT JOIN kept USING (r)"""
