"""The positional inverted index with TF-IDF weights, as Parquet tables.

postings (term, doc_id, tf, length, positions) is sorted by term, so a query's `term IN (...)` prunes row groups; length
is the document's. terms (term, df, idf), lengths (doc_id, length, norm) and counts (num_docs) are the rest. A weight is
tf / length * idf: the idf comes from terms when it is read, and norms join the few sums of a query, so that postings cross
the network once, as they are built, and carry nothing that can be had from the other tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera import fixed
from tessera.functions import text as T
from tessera.functions.query import raw_tokens
from tessera.sources.storage import new_path, stored

TABLES = ("postings", "terms", "lengths", "counts")


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, pos, term of every indexed token; positions count the dropped ones too."""
    return docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term")).where(T.is_indexed(F.col("term")))


#: Documents of about so many characters together are turned into postings at once.
BLOCK = 4_000_000


def inverted(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """term, doc_id, tf, length, positions of a block of documents, ordered by term."""
    found = [raw_tokens(t) for t in texts]
    sizes = np.array([len(x) for x in found])
    coded = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
    folded = [t.lower() if t.isascii() else t for t in coded.dictionary.to_pylist()]
    terms = sorted({t for t in folded if fixed.MIN_TOKEN <= len(t) <= fixed.MAX_TOKEN}.difference(fixed.STOPWORDS))
    number = {t: i for i, t in enumerate(terms)}
    term = np.array([number.get(t, -1) for t in folded], np.int64)[coded.indices.to_numpy()]
    doc, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    live = np.flatnonzero(term >= 0)
    length = np.bincount(doc[live], minlength=len(sizes))
    key = term[live] * len(sizes) + doc[live]
    order = np.argsort(key, kind="stable")  # places stay in order
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends = np.append(first, len(order)).astype(np.int32)
    one = live[order[first]]
    columns = [pa.array(terms, pa.string()).take(pa.array(term[one])), ids.take(pa.array(doc[one])), pa.array(np.diff(ends)), pa.array(length[doc[one]].astype(np.int32))]
    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(place[live[order]].astype(np.int32))))
    return pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "tf", "length", "positions"])


def raw_postings(docs: DataFrame) -> DataFrame:
    """One row for each term of a document, made where the document is: only rows of one doc_id have to meet."""
    whole = StructType([StructField("term", StringType()), docs.schema["doc_id"], StructField("tf", IntegerType()), StructField("length", IntegerType()), StructField("positions", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch["text"].cast(pa.binary()).to_pylist()]
            block = np.cumsum([len(t) for t in texts]) // BLOCK
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield inverted(batch["doc_id"].slice(a, b - a), texts[a:b])

    found = docs.select("doc_id", "text").mapInArrow(run, whole)
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return found
    merged = found.groupBy("term", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    length = found.groupBy(F.col("doc_id").alias("of")).agg(F.sum("tf").cast("int").alias("length"))
    return merged.join(length, F.col("doc_id").eqNullSafe(F.col("of"))).select("term", "doc_id", F.size("positions").alias("tf"), "length", "positions")


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def with_idf(frequency: DataFrame, num_docs: int) -> DataFrame:
    return frequency.select("term", "df", F.log10(F.lit(float(num_docs)) / F.col("df")).alias("idf"))


def weight(idf: Column) -> Column:
    """Of a posting."""
    return F.col("tf") * idf / F.col("length")


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    num_docs: int
    _idf: dict[str, float | None] = field(default_factory=dict, repr=False)  # of terms that were asked for

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None) -> Index:
        """Index docs (doc_id, text) and write it under path, or the shared folder."""
        spark = docs.sparkSession
        path = path or new_path(spark, "index")
        num_docs = docs.count()
        raw = stored(raw_postings(docs), "postings")
        dealt = raw.drop("tf").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        dealt.select("term", "doc_id", F.size("positions").alias("tf"), "length", "positions").write.parquet(f"{path}/postings")
        postings = spark.read.parquet(f"{path}/postings")  # by term: copies of a term shrink to little in the exchanges
        with_idf(document_frequency(postings), num_docs).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        product = F.col("tf") * F.col("idf")
        weighed = postings.select("term", "doc_id", "tf").join(spark.read.parquet(f"{path}/terms").select("term", "idf"), "term")
        lengths = weighed.groupBy("doc_id").agg(F.sum("tf").alias("length"), F.sqrt(F.sum(product * product)).alias("size"))
        lengths.select("doc_id", "length", (F.col("size") / F.col("length")).alias("norm")).write.parquet(f"{path}/lengths")
        spark.range(1).select(F.lit(num_docs).cast("bigint").alias("num_docs")).write.parquet(f"{path}/counts")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
        return cls(tables["postings"], tables["terms"], tables["lengths"], tables["counts"].first()[0])

    def save(self, path: str) -> None:
        self.postings.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.spark.range(1).select(F.lit(self.num_docs).cast("bigint").alias("num_docs")).write.mode("overwrite").parquet(f"{path}/counts")

    def lookup(self, term: str) -> DataFrame:
        """doc_id and positions of a term; ASCII terms in any case."""
        return self.postings.where(F.col("term") == (term.lower() if term.isascii() else term)).select("doc_id", "positions")

    def term_frequency(self, term: str, doc_id: int) -> int:
        row = self.lookup(term).where(F.col("doc_id") == doc_id).select(F.size("positions")).first()
        return row[0] if row else 0

    def frequency(self, term: str) -> int:
        row = self.terms.where(F.col("term") == (term.lower() if term.isascii() else term)).first()
        return row["df"] if row else 0

    def idf(self, terms: list[str]) -> dict[str, float]:
        """idf of the terms of a query that the index has; as many rows as the query has terms."""
        if new := [t for t in terms if t not in self._idf]:
            self._idf |= dict.fromkeys(new) | {r["term"]: r["idf"] for r in self.terms.where(F.col("term").isin(new)).select("term", "idf").collect()}
        return {t: self._idf[t] for t in dict.fromkeys(terms) if self._idf[t] is not None}

    def weights(self, terms: Column | None = None) -> DataFrame:
        """term, doc_id, weight of all postings, or of those whose term meets a condition."""
        rows, known = (df if terms is None else df.where(terms) for df in (self.postings, self.terms.select("term", "idf")))
        return rows.join(known, "term").select("term", "doc_id", weight(F.col("idf")).alias("weight"))

    def top_terms(self, doc_id: int | None = None, n: int = 10) -> DataFrame:
        """The n heaviest terms of a document, or of each."""
        from pyspark.sql import Window

        rows = self.weights() if doc_id is None else self.weights().where(F.col("doc_id") == doc_id)
        order = Window.partitionBy("doc_id").orderBy(F.round("weight", 9).desc(), "term")
        return rows.select("doc_id", "term", "weight", F.row_number().over(order).alias("rank")).where(F.col("rank") <= n)

    def incidence_stats(self) -> DataFrame:
        """Counts of the term by document matrix, which is never made."""
        cells = self.postings.agg(F.count("*").alias("non_zero_cells"))
        sizes = self.terms.agg(F.count("*").alias("num_terms")).join(self.lengths.agg(F.count("*").alias("num_docs")))
        total = F.col("num_terms") * F.col("num_docs")
        return sizes.join(cells).select("num_terms", "num_docs", total.alias("total_cells"), "non_zero_cells", F.when(total > 0, 1 - F.col("non_zero_cells") / total).otherwise(0.0).alias("sparsity"))

    def incidence_row(self, term: str) -> DataFrame:
        """doc_id and 0 or 1 for every document with tokens; the term is taken as it is."""
        hits = self.postings.where(F.col("term") == term).select("doc_id", F.lit(1).alias("hit"))
        return self.lengths.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(0)).alias("present"))

    def incidence_column(self, doc_id: int) -> DataFrame:
        hits = self.postings.where(F.col("doc_id") == doc_id).select("term", F.lit(1).alias("hit"))
        return self.terms.select("term").join(hits, "term", "left").select("term", F.coalesce("hit", F.lit(0)).alias("present"))

    def incidence(self) -> DataFrame:
        """The non-zero cells; a zero is an absent row."""
        return self.postings.select("term", "doc_id", F.lit(1).alias("present"))
