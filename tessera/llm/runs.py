"""Sorted immutable runs of 64-bit or 128-bit fingerprints, their exchange and their merge.

A block of documents writes one run for each range (bucket) of the fingerprints: distinct, sorted, difference-coded,
each with one bit that says whether the block alone repeats it. The runs of a bucket are merged, and every run is
answered by a bitmap in its own order: which of its fingerprints are repeated anywhere. A frequent fingerprint is one
entry of a run for each block, so no key is hot, and only bitmaps travel back. Fingerprints of 128 bits are sorted by
their high words; the low words (`low`) go along as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import bucket_edges, pack_sorted, unpack_sorted

RUN = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("turn", pa.int32()), ("n", pa.int32()), ("payload", pa.binary()), ("low", pa.binary()), ("multi", pa.binary())])
RUN_DDL = "bucket int, block int, turn int, n int, payload binary, low binary, multi binary"
REPLY = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("turn", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])
REPLY_DDL = "block int, bucket int, turn int, n int, bits binary"


def write_runs(block: int, turn: int, distinct: np.ndarray, multi: np.ndarray, buckets: int, low: np.ndarray | None = None) -> list[dict]:
    edges = bucket_edges(distinct, buckets)
    rows = []
    for b in np.flatnonzero(np.diff(edges)):
        i, j = int(edges[b]), int(edges[b + 1])
        rest = b"" if low is None else low[i:j].tobytes()
        rows.append({"bucket": int(b), "block": block, "turn": turn, "n": j - i, "payload": pack_sorted(distinct[i:j]), "low": rest, "multi": np.packbits(multi[i:j]).tobytes()})
    return rows


def passed_on(block: int, buckets: int, flags: np.ndarray) -> dict:
    """A row that the merge hands back to its block as it is."""
    return {"bucket": block % buckets, "block": block, "turn": 0, "n": -len(flags), "payload": np.packbits(flags).tobytes(), "low": b"", "multi": b""}


def merge_runs(rows: pa.Table) -> pa.Table:
    """One bucket's runs in, one bitmap for each run out; rows with n < 0 pass through as they are."""
    kept, answers = [], []
    for r in rows.to_pylist():
        if r["n"] < 0:
            answers.append({"block": r["block"], "bucket": r["bucket"], "turn": r["turn"], "n": r["n"], "bits": r["payload"]})
        else:
            kept.append(r)
    if kept:
        high = np.concatenate([unpack_sorted(r["payload"], r["n"]) for r in kept])
        if kept[0]["low"]:
            low = np.concatenate([np.frombuffer(r["low"], np.uint64) for r in kept])
            order = np.lexsort((low, high))
            same = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
        else:
            order = np.argsort(high, kind="stable")  # a merge, as the runs are sorted
            same = high[order[1:]] == high[order[:-1]]
        again = np.zeros(len(high), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = 0
        for r in kept:
            bits = np.unpackbits(np.frombuffer(r["multi"], np.uint8), count=r["n"]).astype(bool) | again[at : at + r["n"]]
            at += r["n"]
            answers.append({"block": r["block"], "bucket": r["bucket"], "turn": r["turn"], "n": r["n"], "bits": np.packbits(bits).tobytes()})
    return pa.Table.from_pylist(answers, schema=REPLY)


def merged(written: DataFrame, buckets: int) -> DataFrame:
    """Answers to the runs of all blocks; as many tasks as there are buckets, whatever the session's setting."""
    return written.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda table: merge_runs(table), REPLY_DDL)


def read_flags(rows: Iterable[dict]) -> np.ndarray | None:
    """What passed_on() sent, or None."""
    for r in rows:
        if r["turn"] == 0 and r["n"] < 0:
            return np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=-r["n"]).astype(bool)
    return None


def read_replies(rows: Iterable[dict], turn: int) -> np.ndarray:
    """The bits of one block for a turn, in the order of its distinct sorted fingerprints."""
    mine = sorted((r["bucket"], r["n"], r["bits"]) for r in rows if r["turn"] == turn and r["n"] >= 0)
    parts = [np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) for _, n, bits in mine]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)
