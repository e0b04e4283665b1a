"""Toxicity by a linear-chain conditional random field (operator 3).

Learning. Labels come with documents, so tokens are labelled at a distance: on a bounded sample of labelled rows a word,
or the beginning of a word, is a cue if toxic documents hold it far more often than chance (a likelihood ratio test) and
mostly they do; the tokens of toxic documents that show a cue are labelled toxic, all other tokens are not. The field
has two states; its emissions are weights of words and of their first bytes, and it is fitted to these labels by
gradient ascent on the conditional likelihood with marginals from forward-backward. A logistic curve over what the
marginals of a document amount to (their sum and their greatest) is fitted to the document labels.

Scoring is one pass over every whole text: forward-backward marginals of all tokens, the document's score, and the
spans of neighbouring tokens whose marginal is at least one half, as code point offsets. Messages of a two-state chain
are ratios, a step is a 2 x 2 map, and a batch is one chain that is cut into segments and scanned side by side, so that
the longest document costs no more a token than a short one.

Only the text is an input of a score. The sample is `SAMPLE` labelled rows at most, the least by a hash of doc_id, and
never rows whose crc32(doc_id as text) mod 5 is 0.

Defined cases: null or empty text has no tokens and gets the curve's value at zero; a null doc_id is held out; labels
without a document, null labels and documents without a label teach nothing; of several labels of one doc_id the
greatest counts and of its repeated rows the least text; without any labelled row of both kinds every score is the
smoothed share of toxic rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Rolling, chunks, mix, raw_text

#: Labelled rows that are fitted at most; a bound of the method, not of what is scored.
SAMPLE = 2500
FOLDS = 5
#: Bytes of a word's beginnings that are features, beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10, 12)
#: Least likelihood ratio statistic of a feature and of a cue; least share of toxic documents among those with a cue.
FEATURE_G, CUE_G, CUE_SHARE = 15.0, 25.0, 0.7
#: Features of the fit at most, those of the greatest statistic, which bounds the model that workers hold; rounds of the fit.
FEATURES, ROUNDS = 20_000, 60
BASE = 0xA24BAED4963EE407

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

OUT = pa.schema(
    [("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("toxic_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
OUT_DDL = "doc_id bigint, score double, predicted int, toxic_words bigint, spans array<struct<start:bigint,end:bigint>>"


def tokens(segment: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of letters, digits and bytes beyond ASCII."""
    n = len(segment)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = LETTER[segment]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(solid & (np.append(True, ~solid[:-1]) | edge[:n]))
    end = np.flatnonzero(solid & (np.append(~solid[1:], True) | edge[1:])) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def feature_hashes(segment: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places among the tokens, hashes) for the whole word, then for every length of its beginning."""
    rolling = Rolling(LOWER[segment].astype(np.uint64) + np.uint64(1), BASE)
    yield np.arange(len(start)), mix(rolling.of(start, end) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in BEGINNINGS:
        at = np.flatnonzero(end - start > k)
        yield at, mix(rolling.of(start[at], start[at] + k) ^ np.uint64(k << 56))


class Chain:
    """Marginals of a two-state chain over many rows that lie end to end. lead flags the first token of each row."""

    def __init__(self, start: float, step: np.ndarray):
        self.start, self.a = float(np.exp(start)), np.exp(step)

    def ratios(self, emission: np.ndarray, lead: np.ndarray, backward: bool) -> np.ndarray:
        """Messages as odds of the toxic state: forward with the token's own emission, backward without it."""
        n = len(emission)
        side = max(1, int(np.sqrt(n)))
        steps = -(-n // side)
        (a00, a01), (a10, a11) = self.a
        weight = np.exp(np.clip(emission, -30, 30))
        fresh = lead
        if backward:
            # The message to t comes from t + 1: walk from the right, and a row's last token is fresh.
            weight, fresh = np.append(weight[1:], 1.0)[::-1], np.append(lead[1:], True)[::-1]
            # (x -> (a10 + a11 w x) / (a00 + a01 w x)); fresh gives 1.
            top, low = (a11 * weight, np.full(n, a10)), (a01 * weight, np.full(n, a00))
            one = np.ones(n)
        else:
            # (x -> w (a01 + a11 x) / (a00 + a10 x)); fresh gives w times the start's odds.
            top, low = (a11 * weight, a01 * weight), (np.full(n, a10), np.full(n, a00))
            one = weight * self.start
        p, q, r, u = (self._grid(np.where(fresh, f, x), steps, side, pad) for f, x, pad in ((0.0, top[0], 1.0), (one, top[1], 0.0), (0.0, low[0], 0.0), (1.0, low[1], 1.0)))
        m = [np.ones(side), np.zeros(side), np.zeros(side), np.ones(side)]
        for t in range(steps):
            m = [p[t] * m[0] + q[t] * m[2], p[t] * m[1] + q[t] * m[3], r[t] * m[0] + u[t] * m[2], r[t] * m[1] + u[t] * m[3]]
            scale = m[2] + m[3]
            m = [x / scale for x in m]
        into, x = np.empty(side), 1.0
        for s in range(side):
            into[s] = x
            x = (m[0][s] * x + m[1][s]) / (m[2][s] * x + m[3][s])
        out = np.empty((steps, side))
        for t in range(steps):
            into = (p[t] * into + q[t]) / (r[t] * into + u[t])
            out[t] = into
        flat = out.T.ravel()[:n]
        return flat[::-1] if backward else flat

    @staticmethod
    def _grid(values: np.ndarray, steps: int, side: int, pad: float) -> np.ndarray:
        padded = np.full(steps * side, pad)
        padded[: len(values)] = values
        return np.ascontiguousarray(padded.reshape(side, steps).T)

    def marginals(self, emission: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of the toxic state of every token, and the forward and backward odds."""
        if not len(emission):
            return emission, emission, emission
        forward, back = self.ratios(emission, lead, False), self.ratios(emission, lead, True)
        odds = forward * back
        return odds / (1 + odds), forward, back


@dataclass
class Model:
    known: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float
    start: float
    step: np.ndarray
    curve: np.ndarray

    def __post_init__(self) -> None:
        self.chain = Chain(self.start, self.step)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.known >> np.uint64(44)] = True

    def active(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are known features, and which."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        if not len(at) or not len(self.known):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        hit = self.known[which] == hashes[at]
        return at[hit], which[hit]

    def emission(self, segment: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(start), self.bias)
        for at, hashes in feature_hashes(segment, start, end):
            place, which = self.active(hashes)
            np.add.at(out, at[place], self.weights[which])
        return out

    def score(self, expected: np.ndarray, most: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log1p(expected) + self.curve[2] * most, -40, 40)))


def per_row(p: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and greatest marginal of each row."""
    most = np.zeros(n)
    np.maximum.at(most, row, p)
    return np.bincount(row, weights=p, minlength=n), most


def likelihood_ratio(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """G statistic of features in a toxic and b clean documents; negative where clean documents hold it more."""
    with np.errstate(divide="ignore", invalid="ignore"):
        total = toxic + clean

        def part(x: np.ndarray, of: np.ndarray, share: float) -> np.ndarray:
            return np.where(x > 0, x * np.log(x / (of * share)), 0.0)

        both = a + b
        g = part(a, both, toxic / total) + part(b, both, clean / total)
        g += part(toxic - a, total - both, toxic / total) + part(clean - b, total - both, clean / total)
    return 2 * g * np.where(a * clean >= b * toxic, 1, -1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: pa.ChunkedArray | pa.Array, toxic: np.ndarray) -> Model:
    """The field and the curve from labelled documents."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    constant = Model(np.zeros(0, np.uint64), np.zeros(0), -10.0, 0.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if toxic.all() or not toxic.any():
        return constant
    offsets, data = raw_text(texts)
    found, labels = [], []
    for i, j in chunks(offsets):
        segment = data[offsets[i] : offsets[j]]
        start, end, row = tokens(segment, offsets[i : j + 1] - offsets[i])
        for at, hashes in feature_hashes(segment, start, end):
            _, once = np.unique(mix(hashes + mix(row[at].astype(np.uint64) + np.uint64(1))), return_index=True)
            found.append(hashes[once])
            labels.append(toxic[i + row[at[once]]])
    distinct, which = np.unique(np.concatenate(found), return_inverse=True)
    labels = np.concatenate(labels)
    a = np.bincount(which, weights=labels, minlength=len(distinct))
    b = np.bincount(which, minlength=len(distinct)) - a
    del found, which, labels
    g = likelihood_ratio(a, b, int(toxic.sum()), int(len(toxic) - toxic.sum()))
    chosen = np.flatnonzero(g >= FEATURE_G)
    chosen = np.sort(chosen[np.lexsort((chosen, -g[chosen]))][:FEATURES])
    if not len(chosen):
        return constant
    cue = (g[chosen] >= CUE_G) & (a[chosen] >= CUE_SHARE * (a + b)[chosen])
    model = Model(distinct[chosen], np.zeros(len(chosen)), 0.0, 0.0, np.zeros((2, 2)), constant.curve)
    del distinct, a, b, g

    place, feature, rows, done = [], [], [], 0
    for i, j in chunks(offsets):
        segment = data[offsets[i] : offsets[j]]
        start, end, row = tokens(segment, offsets[i : j + 1] - offsets[i])
        for at, hashes in feature_hashes(segment, start, end):
            hit, known = model.active(hashes)
            place.append(done + at[hit])
            feature.append(known)
        rows.append(i + row)
        done += len(start)
    place, feature, row = np.concatenate(place), np.concatenate(feature), np.concatenate(rows)
    lead = np.append(True, row[1:] != row[:-1])
    y = np.zeros(done, dtype=bool)
    y[place[cue[feature]]] = True
    y &= toxic[row].astype(bool)
    _ascend(model, place, feature, lead, y)
    p, _, _ = model.chain.marginals(model.bias + np.bincount(place, weights=model.weights[feature], minlength=done), lead)
    expected, most = per_row(p, row, len(toxic))
    model.curve = logistic(np.column_stack([np.ones(len(toxic)), np.log1p(expected), most]), toxic.astype(float))
    return model


def _ascend(model: Model, place: np.ndarray, feature: np.ndarray, lead: np.ndarray, y: np.ndarray) -> None:
    """Gradient ascent (Adam) on the mean log likelihood of the tokens' labels, with a ridge."""
    n, m = len(y), len(model.weights)
    inner = ~lead
    seen_bias, seen = y.sum(), np.bincount(feature, weights=y[place], minlength=m)
    was, now = np.append(False, y[:-1])[inner], y[inner]
    seen_step = np.array([[0.0, np.sum(~was & now)], [np.sum(was & ~now), np.sum(was & now)]])
    seen_start = np.sum(y[lead])
    theta = np.zeros(m + 5)  # weights, bias, start, step 01, 10, 11
    theta[m] = np.log((seen_bias + 1) / n)
    moment, square = np.zeros(m + 5), np.zeros(m + 5)
    scale = max(float(seen_bias), 1.0)
    for k in range(1, ROUNDS + 1):
        step = np.array([[0.0, theta[m + 2]], [theta[m + 3], theta[m + 4]]])
        chain = Chain(theta[m + 1], step)
        emission = theta[m] + np.bincount(place, weights=theta[feature], minlength=n)
        p, forward, back = chain.marginals(emission, lead)
        before, e, after = np.append(1.0, forward[:-1])[inner], np.exp(np.clip(emission[inner], -30, 30)), back[inner]
        a = chain.a
        parts = [a[0, 0], a[0, 1] * e * after, before * a[1, 0], before * a[1, 1] * e * after]
        total = parts[0] + parts[1] + parts[2] + parts[3]
        expect = [float(np.sum(x / total)) for x in parts[1:]]
        gradient = np.empty(m + 5)
        gradient[:m] = seen - np.bincount(feature, weights=p[place], minlength=m)
        gradient[m:] = [seen_bias - p.sum(), seen_start - p[lead].sum(), seen_step[0, 1] - expect[0], seen_step[1, 0] - expect[1], seen_step[1, 1] - expect[2]]
        gradient = (gradient - 0.05 * theta) / scale
        moment, square = 0.8 * moment + 0.2 * gradient, 0.95 * square + 0.05 * gradient**2
        theta = theta + 0.3 * (moment / (1 - 0.8**k)) / (np.sqrt(square / (1 - 0.95**k)) + 1e-8)
    model.weights, model.bias, model.start = theta[:m], float(theta[m]), float(theta[m + 1])
    model.step = np.array([[0.0, theta[m + 2]], [theta[m + 3], theta[m + 4]]])
    model.chain = Chain(model.start, model.step)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of doc_id as text divisible by FOLDS, or no doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # sample rows at most: that bounds the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    table = rows.orderBy("doc_id").toArrow()
    return fit(table["text"].cast(pa.large_string()), table["toxic"].to_numpy().astype(np.int64) > 0)


def _spans(p: np.ndarray, start: np.ndarray, end: np.ndarray, solid: np.ndarray) -> list[dict]:
    """Runs of toxic tokens of one row; solid counts code points before each byte."""
    hit = np.flatnonzero(p >= 0.5)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)]
    return [{"start": int(solid[start[i]]), "end": int(solid[end[j]])} for i, j in zip(first, last, strict=True)]


def tag(offsets: np.ndarray, data: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """Score, number of toxic tokens and spans of every row."""
    n = len(offsets) - 1
    score, words, spans = np.zeros(n), np.zeros(n, np.int64), []
    for i, j in chunks(offsets):
        segment, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, row = tokens(segment, bounds)
        lead = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, dtype=bool)
        p, _, _ = model.chain.marginals(model.emission(segment, start, end), lead)
        score[i:j] = model.score(*per_row(p, row, j - i))
        words[i:j] = np.bincount(row, weights=p >= 0.5, minlength=j - i).astype(np.int64)
        edge = np.searchsorted(row, np.arange(j - i + 1))
        for r in range(j - i):
            if not words[i + r]:
                spans.append([])
                continue
            a, b = bounds[r], bounds[r + 1]
            solid = np.concatenate(([0], np.cumsum((segment[a:b] & 0xC0) != 0x80)))
            of = slice(edge[r], edge[r + 1])
            spans.append(_spans(p[of], start[of] - a, end[of] - a, solid))
    return score, words, spans


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, toxic_words, spans for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, words, spans = tag(*raw_text(batch["text"]), model)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(words), pa.array(spans, OUT.field("spans").type)], schema=OUT
            )

    return docs.select("doc_id", "text").mapInArrow(run, OUT_DDL)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_words, spans for every row of docs, learned from labels (doc_id, toxic)."""
    found = scored(docs, learn(docs, labels, sample))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_words", "spans")
