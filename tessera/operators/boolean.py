"""Boolean retrieval: sets of doc_id as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.query import searched_terms
from tessera.operators.index import Index


def _folded(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() if t.isascii() else t for t in terms))


def any_of(index: Index, terms: list[str]) -> DataFrame:
    return index.postings.where(F.col("term").isin(_folded(terms))).select("doc_id").distinct()


def all_of(index: Index, terms: list[str]) -> DataFrame:
    """Documents with every term: postings are one row a term and document, so a count decides."""
    wanted = _folded(terms)
    found = index.postings.where(F.col("term").isin(wanted)).groupBy("doc_id").count()
    return found.where((F.col("count") == len(wanted)) & F.lit(bool(wanted))).select("doc_id")


def none_of(index: Index, terms: list[str], universe: DataFrame | None = None) -> DataFrame:
    """Of the universe (documents with a token, unless one is given) those without any of the terms."""
    return (universe if universe is not None else index.lengths).select("doc_id").join(any_of(index, terms), "doc_id", "left_anti")


def evaluate(index: Index, query: str) -> DataFrame:
    """AND NOT binds first and once, then AND, then OR; anything else is OR. No brackets."""
    upper = query.upper()
    if " AND NOT " in upper:
        left, right = upper.split(" AND NOT ", 1)
        return all_of(index, searched_terms(left)).join(any_of(index, searched_terms(right)), "doc_id", "left_anti")
    if " AND " in upper:
        return all_of(index, [t for part in upper.split(" AND ") for t in searched_terms(part)])
    return any_of(index, searched_terms(re.sub(r" OR ", " ", upper)))


def phrase(index: Index, text: str) -> DataFrame:
    """Documents with the phrase's terms at consecutive positions; one term is all_of.

    Each posting moves its positions back by its place in the phrase, so that a match is one place that all terms share:
    an equal join on the document, then an intersection of position lists."""
    wanted = searched_terms(text)
    if len(wanted) < 2:
        return all_of(index, wanted)
    found = None
    for k, term in enumerate(wanted):
        moved = F.transform("positions", lambda p: p - F.lit(k))  # noqa: B023
        one = index.postings.where(F.col("term") == term).select("doc_id", moved.alias(f"at{k}"))
        found = one.withColumnRenamed("at0", "at") if found is None else found.join(one, "doc_id").select("doc_id", F.array_intersect("at", f"at{k}").alias("at"))
    return found.where(F.size("at") > 0).select("doc_id")
