"""Chunks of documents: fixed word windows, sentences, and semantic chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import text as T
from tessera.operators.dense import Encoder


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def windows(text: Column, size: int = fixed.CHUNK_WORDS, stride: int = fixed.CHUNK_STRIDE) -> Column:
    """A short text as it is, a blank one nothing, a long one windows of words through its tail."""
    words = _words(text)
    n = F.size(words)
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(cut)


def fixed_chunks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(windows(F.col("text"))).alias("chunk_id", "text"))


def sentences(text: Column) -> Column:
    """Lines that are headings, and the sentences of other lines, with single spaces."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    single = lambda c: F.regexp_replace(c, r"(?U)[^\S ]\s*| \s+", " ")  # noqa: E731 (runs that are no single space yet)
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), strip), lambda x: x != "")
    parts = lambda x: F.transform(F.split(x, r"(?U)(?<=[.!?।॥])\s+"), lambda s: F.trim(single(s)))
    return F.filter(F.flatten(F.transform(lines, lambda x: F.when(T.is_heading(x), F.array(x)).otherwise(parts(x)))), lambda s: s != "")


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_id", "text"))


def cut_words(text: str) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + fixed.CHUNK_WORDS]) for i in range(0, len(words), fixed.CHUNK_STRIDE)] if len(words) > fixed.CHUNK_WORDS else [text] if words else []


def fold(parts: list[str], headings: list[bool], vectors: np.ndarray) -> list[str]:
    """Chunks of one document's sentences: a new one at a heading, beyond the size, or where neighbours differ."""
    sizes = [len(p.split()) for p in parts]
    near = np.append(1.0, (vectors[1:] * vectors[:-1]).sum(axis=1))
    out: list[str] = []
    held: list[int] = []

    def total() -> int:
        return sum(sizes[i] for i in held)

    def flush(keep: int) -> None:
        if held:
            out.append(" ".join(parts[i] for i in held).strip())
        held[:] = held[len(held) - keep :] if keep else []

    for i in range(len(parts)):
        if i:
            if headings[i] and total() >= fixed.CHUNK_MIN:
                flush(0)
            if sizes[i] > fixed.CHUNK_WORDS:
                flush(0)
                out += cut_words(parts[i])
                continue
            if total() + sizes[i] > fixed.CHUNK_WORDS or (near[i] < fixed.CHUNK_SIMILARITY and total() >= fixed.CHUNK_MIN):
                flush(min(fixed.CHUNK_OVERLAP, len(held)))
        held.append(i)
    flush(0)
    return [c for c in out if c]


def semantic_chunks(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """doc_id, chunk_id, text; a document of one sentence is cut by words. One document is held at a time."""
    rows = docs.select("doc_id", "text", sentences(F.col("text")).alias("parts"))
    rows = rows.select("doc_id", F.when(F.size("parts") == 1, F.col("text")).alias("text"), "parts", F.transform("parts", T.is_heading).alias("headings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts = [], [], []
            for doc_id, text, parts, headings in zip(*(batch[n].to_pylist() for n in ("doc_id", "text", "parts", "headings")), strict=True):
                found = fold(parts, headings, encoder.encode([f"passage: {p}" for p in parts])) if len(parts) > 1 else cut_words(text or "") if parts else []
                ids += [doc_id] * len(found)
                numbers += range(len(found))
                texts += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "chunk_id", "text"])

    return rows.mapInArrow(run, "doc_id bigint, chunk_id int, text string")


def chunks(docs: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Semantic chunks where there is an encoder, else fixed ones."""
    return semantic_chunks(docs, encoder) if encoder is not None else fixed_chunks(docs)
