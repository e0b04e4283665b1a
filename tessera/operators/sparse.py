"""TF-IDF cosine ranking. A query reads the postings of its terms only, sums weights by document, and divides by norms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.query import Query, searched_terms
from tessera.operators import boolean
from tessera.operators.index import Index, weight

#: Scores are ordered by this many decimals, then doc_id, so that copies tie whatever the order of a sum.
DECIMALS = 9


def top(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows; ties go to the least doc_id."""
    return scores.orderBy(F.round(score, DECIMALS).desc(), "doc_id").limit(k)


def query_vector(index: Index, terms: list[str], weights: dict[str, float] | None = None) -> dict[str, float]:
    """Term to normalised frequency (or weight) times idf; unknown terms are left out."""
    raw: dict[str, float] = {}
    for t in terms:
        raw[t] = raw.get(t, 0.0) + 1.0
    raw = {t: w for t, w in (weights or raw).items() if w > 0}
    total = sum(raw.values())
    return {t: raw[t] / total * idf for t, idf in index.idf(list(raw)).items()} if total else {}


def _looked_up(table: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def cosine(index: Index, vector: dict[str, float]) -> DataFrame:
    """doc_id and cosine of every document with a positive one."""
    live = {t: w for t, w in vector.items() if w}
    size = sum(w * w for w in live.values()) ** 0.5
    if not live:
        return index.lengths.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
    idf = _looked_up(index.idf(list(live)), F.col("term"))
    hits = index.postings.where(F.col("term").isin(list(live))).select("doc_id", (weight(idf) * _looked_up(live, F.col("term"))).alias("part"))
    return _normed(index, hits.groupBy("doc_id").agg((F.sum("part") / size).alias("dot")))


def _normed(index: Index, dots: DataFrame) -> DataFrame:
    """Positive scores: dot over the document's norm. Both sides lie by doc_id and have a row a document."""
    norms = index.lengths.where("norm > 0").select("doc_id", "norm")
    return dots.where("dot > 0").join(norms, "doc_id").withColumn("score", F.col("dot") / F.col("norm")).drop("dot", "norm").where("score > 0")


def rank(index: Index, terms: list[str], k: int = fixed.TOP_K, weights: dict[str, float] | None = None) -> DataFrame:
    return top(cosine(index, query_vector(index, terms, weights)), k)


def with_phrase_boost(index: Index, ranked: DataFrame, raw: str, k: int) -> DataFrame:
    """Raises those of the ranked documents that hold a configured phrase of the query."""
    phrases = [p for p in fixed.PHRASE_BOOST_TERMS if p in raw.lower()]
    if not phrases:
        return ranked
    hits = reduce(DataFrame.unionByName, [boolean.phrase(index, p) for p in phrases]).groupBy("doc_id").agg(F.count("*").alias("hits"))
    boosted = ranked.join(hits, "doc_id", "left").select("doc_id", (F.col("score") + fixed.PHRASE_BOOST * F.coalesce("hits", F.lit(0))).alias("score"))
    return top(boosted, k)


def floored(index: Index, matching: DataFrame, query: str, k: int) -> DataFrame:
    """Matching documents by cosine with all terms of the query, at least BOOLEAN_FLOOR."""
    scores = cosine(index, query_vector(index, searched_terms(query)))
    scored = matching.join(scores, "doc_id", "left").select("doc_id", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(fixed.BOOLEAN_FLOOR)).alias("score"))
    return top(scored, k)


def search(index: Index, query: Query, k: int = fixed.TOP_K) -> DataFrame:
    """doc_id and score by the query's type; a wildcard comes as one term here and so finds nothing."""
    if not query.terms:
        return rank(index, [], k)
    if query.type == "boolean":
        return floored(index, boolean.evaluate(index, query.raw), query.raw, k)
    if query.type == "phrase":
        return floored(index, boolean.phrase(index, query.raw), query.raw, k)
    ranked = rank(index, query.terms, k, query.weighted_terms)
    return with_phrase_boost(index, ranked, query.raw, k)


#: Up to so many rows of queries, their terms are literals of the scans' filters and their weights are sent to every task.
FEW = 1000


def rank_many(index: Index, queries: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """query_id, doc_id, score, rank for many queries (query_id, term, weight) at once, in one join and one window.

    A few queries read the postings of their terms only; for any number of them postings and terms are joined."""
    from pyspark.sql import Window

    terms, postings, sent = index.terms.select("term", "idf"), index.postings.select("term", "doc_id", "tf", "length"), lambda df: df
    rows = queries.select("query_id", "term", "weight").limit(FEW + 1).collect()
    if len(rows) <= FEW:
        named = F.col("term").isin(list({r["term"] for r in rows if r["term"] is not None}))
        terms, postings, sent = terms.where(named), postings.where(named), F.broadcast
    known = sent(queries.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))).join(terms, "term")
    vector = known.select("query_id", "term", "idf", (F.col("weight") * F.col("idf")).alias("q"))
    size = vector.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("size")).where("size > 0")
    dots = postings.join(sent(vector), "term").groupBy("query_id", "doc_id").agg(F.sum(weight(F.col("idf")) * F.col("q")).alias("dot"))
    scores = _normed(index, dots.join(sent(size), "query_id").select("query_id", "doc_id", (F.col("dot") / F.col("size")).alias("dot"))).select("query_id", "doc_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.round("score", DECIMALS).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
