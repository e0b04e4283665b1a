"""Quality classifier by hierarchical empirical Bayes (operator 10).

Evidence: shares and rates of a whole text (capitals, signs, separators, repeated words and lines, and so on) in a
logistic regression that is fitted to a bounded sample of labelled rows; its log odds less the prior's are what the
text alone says, the weight of evidence.

Sites: a host is a document's `source`, a path of it the `lang` section (both are parameters). The expected number of
good documents of every path is summed from the evidence over all documents, by grouped aggregation, and paths are summed
to hosts and hosts to the whole. A host's rate is shrunk to the global rate, a path's to its host's, by Beta priors:

    rate = (expected good + strength * parent's rate) / (documents + strength)

The strength of a level is estimated by moments from how much its rates differ beyond what chance makes of their sizes:
empirical Bayes. A site with few documents thus keeps its parent's rate. A document's posterior joins the weight of its
evidence to its path's log odds.

The text is read once, into figures of a few bytes; everything after works on these. Sites are aggregated before they
are shuffled. Documents meet their site's rate in a join on (host, path, salt): a site of more documents than a shuffle
partition's share is dealt to as many salts as it has such parts, so that a hot host is no hot task.

Defined cases: null or empty text has all figures 0 and is judged by them; null hosts and paths are sites of their own;
a null doc_id is held out; labels without a document or null teach nothing, of several labels of one doc_id the least
counts; without rows of both kinds the evidence is 0 and the prior decides; repeated rows get equal posteriors; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, Rolling, chunks, mix, raw_text, reliable, words_of

#: Labelled rows that are fitted at most; a bound of the evidence's fit only.
SAMPLE, FOLDS = 20_000, 5
#: Documents with a lower posterior are rejected.
KEEP = 0.5
#: Documents of a site that one task joins, at least; at large a site is hot beyond the share of one shuffle partition.
SPLIT = 256
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 10_000.0

FIGURES = ("log_words", "upper", "signs", "bars", "shouts", "digits", "word_length", "new_words", "word_runs", "word_pairs", "stops", "same_lines", "line_words")


def _classes() -> np.ndarray:
    """Of each byte a bit for: 1 capital, 2 sign, 4 bar, 8 shout, 16 digit, 32 stop or comma, 64 letter or beyond ASCII."""
    table = np.zeros(256, np.uint8)
    for bit, members in ((1, range(65, 91)), (2, b"#*$%&<>{}[]\\^~_="), (4, b"|"), (8, b"!?"), (16, range(48, 58)), (32, b".,;:"), (64, [*range(65, 91), *range(97, 123), *range(128, 256)])):
        table[list(members)] |= bit
    return table


CLASSES = _classes()


def figures(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of FIGURES for each text."""
    out = np.zeros((len(offsets) - 1, len(FIGURES)))
    for i, j in chunks(offsets):
        segment, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        kinds = CLASSES[segment]
        start, end, row = words_of(segment, bounds)
        m = j - i
        words = np.bincount(row, minlength=m)
        some = np.maximum(words, 1)
        solid = np.concatenate(([0], np.cumsum(~SPACE[segment] & ((segment & 0xC0) != 0x80))))
        chars = np.maximum(solid[bounds[1:]] - solid[bounds[:-1]], 1)

        def share(bit: int, of: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum((kinds & bit) > 0)))  # noqa: B023
            return (total[bounds[1:]] - total[bounds[:-1]]) / of  # noqa: B023

        hashes = mix(Rolling(segment.astype(np.uint64) + np.uint64(1), 0x8E3C5B2F9D1A4E67).of(start, end) + (end - start).astype(np.uint64))
        own = mix(hashes + mix(row.astype(np.uint64) + np.uint64(1)))
        inner = row[1:] == row[:-1]
        pairs = mix(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:])[inner]
        lines = np.bincount(np.searchsorted(bounds, np.flatnonzero(segment == 10), side="right") - 1, minlength=m) + 1
        out[i:j] = np.column_stack([
            np.log1p(words), share(1, chars), share(2, some), share(4, some), share(8, some), share(16, chars), (chars / some).clip(0, 20),
            _distinct(own, row, m) / some, np.bincount(row[1:][inner & (own[1:] == own[:-1])], minlength=m) / some,
            _distinct(pairs, row[1:][inner], m) / some, share(32, some), _same_lines(segment, bounds, lines), np.log1p(words / lines),
        ])
    return out


def _distinct(values: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    _, first = np.unique(values, return_index=True)
    return np.bincount(row[first], minlength=m)


def _same_lines(segment: np.ndarray, bounds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Share of each row's lines that are equal to an earlier one."""
    n, m = len(segment), len(bounds) - 1
    if not n:
        return np.zeros(m)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    text = segment != 10
    start = np.flatnonzero(text & (np.append(True, ~text[:-1]) | edge[:n]))
    end = np.flatnonzero(text & (np.append(~text[1:], True) | edge[1:])) + 1
    row = np.searchsorted(bounds, start, side="right") - 1
    own = mix(mix(Rolling(segment.astype(np.uint64) + np.uint64(1), 0xA0761D6478BD642F).of(start, end)) + mix(row.astype(np.uint64) + np.uint64(1)))
    return (np.bincount(row, minlength=m) - _distinct(own, row, m)) / lines


def measured(docs: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, host, path, figures: the one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = figures(*raw_text(batch["text"])).astype(np.float32)
            listed = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(FIGURES), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["host"], batch["path"], listed], names=["doc_id", "host", "path", "figures"])

    rows = docs.select("doc_id", "text", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    return rows.mapInArrow(run, "doc_id bigint, host string, path string, figures array<float>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


class Evidence:
    """Logistic regression on standardised figures and their squares; log odds are those at a prior of one half."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.mean, self.scale, self.weights = np.zeros(len(FIGURES)), np.ones(len(FIGURES)), np.zeros(1 + 2 * len(FIGURES))
        if not len(y) or y.all() or not y.any():
            return
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = self.design(x)
        ridge = np.diag([1e-6, *[1.0] * (z.shape[1] - 1)])
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        w[0] -= np.log(self.prior / (1 - self.prior))
        self.weights = w

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.column_stack([np.ones(len(x)), z, z * z])

    def column(self, values: Column) -> Column:
        """The same as an expression over the array of figures."""
        total: Column = F.lit(float(self.weights[0]))
        m = len(FIGURES)
        for k in range(m):
            z = F.greatest(F.least((values[k].cast("double") - float(self.mean[k])) / float(self.scale[k]), F.lit(4.0)), F.lit(-4.0))
            total = total + z * (float(self.weights[1 + k]) + z * float(self.weights[1 + m + k]))
        return total


def learn(rows: DataFrame, labels: DataFrame, sample: int) -> Evidence:
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # sample rows at most: that bounds the broadcast
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("figures").alias("figures")).orderBy("doc_id").toArrow()
    x = np.asarray(found["figures"].to_pylist(), dtype=float).reshape(len(found), len(FIGURES))
    return Evidence(x, (found["quality"].to_numpy() > 0).astype(float))


def strength(sites: DataFrame, parent: Column) -> float:
    """Documents that a level's Beta prior counts as, by moments: sites has n and good, parent is the rate shrunk to.

    What the rates vary by beyond the variance parent * (1 - parent) / n of chance is the prior's own variance."""
    apart = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - parent, 2.0))
    one = F.sum(parent * (1 - parent))
    chance = F.sum(F.col("n") * parent * (1 - parent))
    row = sites.agg(apart.alias("apart"), one.alias("one"), chance.alias("chance"), F.count("*").alias("k")).first()
    if not row["k"] or not row["chance"]:
        return STRONGEST
    between = max(0.0, row["apart"] - row["one"]) / row["chance"]  # the prior's variance over parent * (1 - parent)
    return float(min(max(1 / between - 1 if between else STRONGEST, WEAKEST), STRONGEST))


def site_rates(rows: DataFrame) -> DataFrame:
    """host, path, n, host_rate, rate for every path; rows has host, path and the evidence's probability p."""
    paths = reliable(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    hosts = reliable(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = F.lit((float(total[1] or 0) + 1) / (float(total[0] or 0) + 2))
    of_host = strength(hosts, overall)
    rated = hosts.select(F.col("host").alias("of"), ((F.col("good") + of_host * overall) / (F.col("n") + of_host)).alias("host_rate"))
    joined = reliable(paths.join(rated, F.col("host").eqNullSafe(F.col("of"))).drop("of"))
    of_path = strength(joined, F.col("host_rate"))
    return joined.select("host", "path", "n", "host_rate", ((F.col("good") + of_path * F.col("host_rate")) / (F.col("n") + of_path)).alias("rate"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, keep: float = KEEP, split: int = SPLIT) -> DataFrame:
    """doc_id, held_out, evidence, host_rate, path_rate, score, kept for every row of docs (doc_id, text, host, path)."""
    rows = reliable(measured(docs, host, path))
    evidence = learn(rows, labels, sample)
    prior = float(np.log(evidence.prior / (1 - evidence.prior)))
    weighed = rows.select("doc_id", "host", "path", evidence.column(F.col("figures")).alias("evidence"))
    sites = reliable(site_rates(weighed.select("host", "path", (1 / (1 + F.exp(-(F.col("evidence") + prior)))).alias("p"))))
    # Sites that hold more than one partition's share: there are fewer of them than partitions, which bounds the list.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sites.agg(F.sum("n")).first()[0] or 0
    share = max(split, math.ceil(total / partitions))
    key = lambda: F.xxhash64(F.coalesce("host", F.lit("")), F.col("host").isNull(), F.coalesce("path", F.lit("")), F.col("path").isNull())
    hot = sites.where(F.col("n") > share).select(key().alias("key"), F.ceil(F.col("n") / share).cast("int").alias("parts")).collect()
    parts = F.coalesce(F.create_map(*[F.lit(x) for r in hot for x in r])[key()], F.lit(1)) if hot else F.lit(1)
    salted = weighed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), parts).cast("int"))
    rates = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_rate", "rate", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("s"))
    met = salted.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")) & (F.col("salt") == F.col("s")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("rate") / (1 - F.col("rate"))))))
    return met.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_rate", F.col("rate").alias("path_rate"), score.alias("score"), (score >= keep).alias("kept"))

