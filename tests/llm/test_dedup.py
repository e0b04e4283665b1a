"""Exact and near dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_suffix(rows, length=50):
    first: dict[bytes, int] = {}
    for doc_id, text, *_ in rows:
        if doc_id is None:
            continue
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        if doc_id is not None:
            for i in range(len(data) - length + 1):
                if first[data[i : i + length]] < doc_id:
                    gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup(docs, rows, empty):
    got = suffix_dedup.dedup(docs).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == brute_suffix(rows)
    assert any(r["n_removed"] for r in got)
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_merge_shares_prefixes():
    """The loser tree's order and shared words are those of a plain sort."""
    import numpy as np

    rng = np.random.default_rng(3)
    runs = []
    for _ in range(5):
        w = np.sort(rng.integers(0, 3, (int(rng.integers(0, 30)), suffix_dedup.WORDS)).astype(np.uint64).view([("", np.uint64)] * suffix_dedup.WORDS).ravel()).view(np.uint64).reshape(-1, suffix_dedup.WORDS)
        run = object.__new__(suffix_dedup.Run)
        run.n, run.words = len(w), w
        differ = w[1:] != w[:-1]
        run.shared = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), suffix_dedup.WORDS))) if len(w) else np.zeros(0, np.int64)
        runs.append(run)
    order, common = suffix_dedup.merge(runs)
    everything = np.concatenate([r.words for r in runs])
    merged = [tuple(x) for x in everything[order]]
    assert merged == sorted(tuple(x) for x in everything)
    for k in range(1, len(merged)):
        same = next((c for c in range(suffix_dedup.WORDS) if merged[k][c] != merged[k - 1][c]), suffix_dedup.WORDS)
        assert common[k] == same


def brute_substring(rows, width=35):
    starts: Counter = Counter()
    split = [[m.encode() for m in WORD.findall(r[1] or "")] for r in rows]
    for ws in split:
        for i in range(len(ws) - width + 1):
            starts[tuple(ws[i : i + width])] += 1
    out = []
    for r, ws in zip(rows, split, strict=True):
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if starts[tuple(ws[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((r[0], len(ws), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substring_dedup(docs, rows, empty):
    got = substring_dedup.dedup(docs).drop("kept_text").collect()
    assert Counter(tuple(r) for r in got) == brute_substring(rows)
    assert any(r["n_removed"] for r in got)
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_carries_columns(docs, empty):
    got = substring_dedup.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert got.where("n_chars <> length(text)").count() == 0
    assert substring_dedup.without_repeats(empty).count() == 0


def test_substring_dedup_leaves_blocks_without_repeats(spark):
    """Texts that lose nothing come back as they were, whatever else their block holds."""
    rows = [(1, "two\n\n lines\t here ", 17), (2, None, 5), (3, "", 0), (4, " ".join(f"w{i}" for i in range(60)) + "\n", 231)]
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert sorted(tuple(r) for r in got.collect()) == rows


def test_fingerprint_index_is_incremental(spark, tmp_path):
    """Each batch against brute force over itself and all batches before it, across compactions."""
    rng = random.Random(8)
    passages = [" ".join(f"{k}p{i}" for i in range(rng.randint(36, 70))) for k in range(4)]
    index, seen, doc_id = substring_dedup.FingerprintIndex(spark, str(tmp_path), buckets=4), [], 0
    for _ in range(4):
        batch = []
        for _ in range(12):
            parts = [" ".join(f"w{rng.random()}" for _ in range(rng.randint(0, 50))), rng.choice([*passages, ""]), "end"]
            batch.append((doc_id, " ".join(parts)))
            doc_id += 1
        seen += batch
        got = Counter(tuple(r)[:4] for r in index.add(spark.createDataFrame(batch, "doc_id long, text string")).collect())
        new = {r[0] for r in batch}
        assert got == Counter({k: n for k, n in brute_substring(seen).items() if k[0] in new})
    assert len(index.levels) == 1
    assert index.add(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substring_dedup_tells_words_apart(spark):
    """Words that collide in every polynomial modulo 2**64 (Thue-Morse) are different words."""
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    rest = " ".join(["same"] * 20 + [f"w{i}" for i in range(14)])
    rows = [(1, f"{rest} {word}"), (2, f"{rest} {other}"), (3, f"{word} {rest}")]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 0, 2: 0, 3: 0}


def test_long_texts(spark):
    """Texts beyond a kernel's chunk, with repeats across its edges, against brute force."""
    rng = random.Random(9)
    body = [f"w{rng.randint(0, 10**9)}" for _ in range(60_000)]
    far = " ".join(body[40_000:40_060])
    rows = [(1, " ".join(body)), (2, "x " + far + " y"), (3, " ".join(body[:30_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r)[:4] for r in substring_dedup.dedup(docs).collect()) == brute_substring(rows)
    assert Counter(tuple(r)[:5] for r in suffix_dedup.dedup(docs).drop("kept").collect()) == brute_suffix(rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs).collect()}
    assert prints == {i: f"{brute_print(t):016x}" for i, t in rows}


def shingles(text, shingle):
    ws = [w.encode() for w in WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))]
    return [b" ".join(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))] if ws else []


def spread(h):
    """The finaliser of the fingerprints' further words."""
    m = (1 << 64) - 1
    h = ((h ^ h >> 31) * 0x9FB21C651E98DF25) & m
    h = ((h ^ h >> 29) * 0xD6E8FEB86659FD93) & m
    return h ^ h >> 32


def brute_print(text, rule=simhash.STRICT):
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in shingles(text, rule.shingle)]
    out = 0
    for w in range(rule.wide):
        own = [spread((h + w) & ((1 << 64) - 1)) if w else h for h in hashes]
        out = out << 64 | sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
    return out


def brute_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(prints)):
        groups[find(i)].append(i)
    return groups


@pytest.mark.parametrize("rule", [simhash.STRICT, simhash.NEAR])
def test_simhash(docs, rows, empty, rule):
    prints = [brute_print(r[1], rule) for r in rows]
    expected = Counter()
    for members in brute_components(prints, rule.radius).values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        expected.update((rows[i][0], f"{prints[i]:0{16 * rule.wide}x}", least) for i in members)
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs, rule).collect()) == expected
    assert simhash.near_duplicates(empty, rule).count() == 0


@pytest.mark.parametrize("rule", [simhash.STRICT, simhash.NEAR])
def test_simhash_survivors(docs, rows, empty, rule):
    """One row of each component, of its least id; which of several texts with that id stays is open here."""
    prints = [brute_print(r[1], rule) for r in rows]
    choices = []
    for members in brute_components(prints, rule.radius).values():
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in members)
        choices.append({(rows[i][0], rows[i][1]) for i in members if (rows[i][0] is None, rows[i][0] or 0) == least})
    got = simhash.survivors(docs, rule)
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert sum(kept.values()) == len(choices) and all(sum(kept[c] for c in group) == 1 for group in choices)
    assert simhash.survivors(empty, rule).count() == 0


def signed(x):
    return x - (1 << 64 if x >> 63 else 0)


def spanned(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        up[find(u)] = find(v)
    return {frozenset(x for x in nodes if find(x) == r) for r in map(find, nodes)}


@pytest.mark.parametrize("crowd", [4, 1024])
def test_simhash_links_survive_large_keys(spark, monkeypatch, crowd):
    """Random fingerprints and neighbours of them, pooled and in crowds, by chunk pairs."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    dense = np.uint64(0xABCD) << np.uint64(40) | rng.integers(0, 1 << 12, 200, dtype=np.uint64)
    close = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, k, replace=False))) for b in base for k in (1, 2, 3, 4)]
    prints = sorted({int(x) for x in [*base, *close, *dense]})
    monkeypatch.setattr(simhash, "SPLIT", 64)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "node long")).collect()
    assert spanned([signed(x) for x in prints], edges) == {frozenset(signed(prints[i]) for i in g) for g in brute_components(prints).values()}


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 48])
def test_planes_count_distances(radius):
    """Carry-save counters against popcounts, for many queries over one block and for a query for each candidate."""
    rng = np.random.default_rng(radius)
    wide = 4 if radius > 4 else 1
    stored = rng.integers(0, 1 << 63, (150, wide), dtype=np.uint64)
    queries = stored[rng.integers(0, 150, 20)].copy()
    for i in range(20):
        for bit in rng.choice(63, min(60, i % (2 * radius + 2)), replace=False):
            queries[i, i % wide] ^= np.uint64(1) << np.uint64(bit)
    distance = np.bitwise_count(stored[None] ^ queries[:, None]).sum(axis=2)
    planes = simhash.to_planes(stored)
    bits = np.unpackbits(simhash.to_planes(queries).view(np.uint8), axis=1, bitorder="little", count=20).astype(np.uint64) * np.uint64((1 << 64) - 1)
    got = simhash.near(planes, bits[:, :, None], radius)
    assert all((simhash._flags(got[i], 150) == (distance[i] <= radius)).all() for i in range(20))
    each = np.resize(queries, (150, wide))
    got = simhash.near(planes, simhash.to_planes(each)[:, None, :], radius)
    assert (simhash._flags(got[0], 150) == (np.bitwise_count(stored ^ each).sum(axis=1) <= radius)).all()


def test_links_come_from_the_planes(monkeypatch):
    """Small keys too are compared by the bit planes, and by nothing else."""
    served = []
    real = simhash.near
    monkeypatch.setattr(simhash, "near", lambda planes, *rest: served.append(planes.shape) or real(planes, *rest))
    prints = np.array([[5], [7], [1 << 60], [5], [6]], np.uint64)
    u, v = simhash.pooled_forest(prints, np.array([0, 0, 0, 1, 1]), 3)
    assert served and {(int(a), int(b)) for a, b in zip(u, v, strict=True)} == {(1, 0), (2, 0), (4, 3)}


def test_near_rule_finds_near_copies(spark):
    """Of pairs of texts with a likeness of 0.8 or more nearly all come together; of a likeness below 0.5 none do."""
    rng = random.Random(11)
    rows, pairs = [], []
    for k in range(150):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 300))]
        copy = list(base)
        for at in rng.sample(range(len(base)), max(1, len(base) // rng.choice((10, 60, 90)))):
            copy[at] = f"x{rng.randint(0, 10**6)}"
        a, b = set(shingles(" ".join(base), 5)), set(shingles(" ".join(copy), 5))
        pairs.append((2 * k, len(a & b) / len(a | b)))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), simhash.NEAR).collect()}
    like = [i for i, j in pairs if j >= 0.8]
    assert len(like) > 50 and sum(got[i] == got[i + 1] for i in like) >= 0.97 * len(like)
    assert not any(got[i] == got[i + 1] for i, j in pairs if j < 0.5)
    assert all(c in (i, i - 1) for i, c in got.items())
