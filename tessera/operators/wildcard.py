"""Wildcard search: `*` is any run of characters, `?` one. Everything else in a pattern is literal.

The pattern becomes LIKE, whose fixed beginning Catalyst pushes to the term-sorted scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import text as T
from tessera.operators.index import Index
from tessera.operators.sparse import top


def like(pattern: str) -> str:
    plain = pattern.lower().strip()
    for special in "\\%_":
        plain = plain.replace(special, "\\" + special)
    return plain.replace("*", "%").replace("?", "_")


def matching_terms(index: Index, pattern: str) -> DataFrame:
    return index.terms.where(F.col("term").like(like(pattern)))


def search(index: Index, pattern: str, k: int = fixed.TOP_K) -> DataFrame:
    """Documents by the sum of the matching terms' weights; scores of zero stay."""
    hits = index.weights(F.col("term").like(like(pattern)))
    return top(hits.groupBy("doc_id").agg(F.sum("weight").alias("score")), k)


def bigrams(terms: DataFrame) -> DataFrame:
    """bigram and term for every pair of neighbouring characters of the marked term."""
    marked: Column = F.concat(F.lit("$"), F.col("term"), F.lit("$"))
    return terms.select(F.explode(F.array_distinct(T.windows(marked, 2))).alias("bigram"), "term")


def candidates(index: Index, pattern: str) -> DataFrame:
    """Terms that hold every bigram the pattern fixes: a superset of matching_terms, which needs no such index."""
    marked = f"${pattern.lower()}$"
    wanted = list(dict.fromkeys(x for part in marked.replace("?", "*").split("*") for x in (part[i : i + 2] for i in range(len(part) - 1))))
    if not wanted:
        return index.terms.select("term")
    found = bigrams(index.terms).where(F.col("bigram").isin(wanted)).groupBy("term").count()
    return found.where(F.col("count") == len(wanted)).select("term")
