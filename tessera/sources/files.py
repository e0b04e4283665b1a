"""Directories of files as documents: a binary scan, extractors by type, file-name terms, dense ids in path order.

An extractor turns bytes into (text, pages, metadata) and may raise or return None: the file is dropped, as is one without
text; `dropped` lists such files with the reason. Text, Word and Excel files and PDF files with simple fonts are read with
the standard library; other PDF files, images and the binary Excel format need an extractor to be registered.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import text as T
from tessera.sources.storage import stored

Extractor = Callable[[bytes], "tuple[str, list[dict], dict[str, str]] | None"]
DDL = "file_path string, file_name string, file_type string, text string, pages array<struct<page_num:int,text:string>>, metadata map<string,string>"


def decoded(content: bytes) -> str:
    """UTF-8, with or without its mark, else Latin-1, which any bytes are."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def text_file(content: bytes) -> tuple[str, list[dict], dict[str, str]]:
    return decoded(content), [], {"size_bytes": str(len(content))}


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _core(archive: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in archive.namelist():
        return {"title": "", "author": ""}
    found = {_local(e): e.text or "" for e in ElementTree.fromstring(archive.read("docProps/core.xml"))}
    return {"title": found.get("title", ""), "author": found.get("creator", "")}


def word_file(content: bytes) -> tuple[str, list[dict], dict[str, str]]:
    """Paragraphs that aren't blank, then the rows of tables, cells set apart by bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = next(e for e in ElementTree.fromstring(archive.read("word/document.xml")) if _local(e) == "body")
        text_of = lambda e: "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x), "") for x in e.iter()).strip()
        lines = [text_of(e) for e in body if _local(e) == "p"]
        for grid in (e for e in body if _local(e) == "tbl"):
            for row in (e for e in grid if _local(e) == "tr"):
                cells = [" ".join(text_of(p) for p in c if _local(p) == "p").strip() for c in row if _local(c) == "tc"]
                lines.append(" | ".join(c for c in cells if c))
        return "\n".join(x for x in lines if x), [], _core(archive)


def excel_file(content: bytes) -> tuple[str, list[dict], dict[str, str]]:
    """For every sheet a line with its name and the rows' cells that aren't empty, set apart by bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared = [("".join(t.text or "" for t in s.iter() if _local(t) == "t")) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        lines, count = [], 0
        for sheet in (e for e in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _local(e) == "sheet"):
            count += 1
            lines.append(f"[Sheet: {sheet.get('name')}]")
            target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
            for row in (e for e in ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if _local(e) == "row"):
                cells = []
                for cell in row:
                    value = "".join(x.text or "" for x in cell.iter() if _local(x) in ("v", "t"))
                    if cell.get("t") == "s" and value:
                        value = shared[int(value)]
                    if value.strip():
                        cells.append(value.strip())
                if cells:
                    lines.append(" | ".join(cells))
        return "\n".join(lines) if len(lines) > count else "", [], {"sheet_count": str(count)}


def missing(kind: str) -> Extractor:
    def fail(_: bytes):  # type: ignore[no-untyped-def]
        raise NotImplementedError(f"no extractor is registered for {kind} files")

    return fail


def paged(page_texts: list[str], ocr: Callable[[int], str] | None = None, short: int = 20) -> tuple[str, list[dict]]:
    """For PDF extractors: pages that are nearly without text go through ocr(page number), pages are set apart by a line."""
    pages = [{"page_num": i, "text": ocr(i) or t if ocr and len(t.strip()) < short else t} for i, t in enumerate(page_texts, 1)]
    return "\n\n".join(p["text"] for p in pages if p["text"]), pages


def recognised(words: list[tuple[str, float]]) -> tuple[str, dict[str, str]]:
    """For image extractors: words joined, with their mean confidence; a confidence of -1 is none."""
    kept = [(w, c) for w, c in words if w.strip()]
    sure = [c for _, c in kept if c >= 0]
    return " ".join(w for w, _ in kept), {"avg_confidence": str(sum(sure) / len(sure) if sure else 0.0), "word_count": str(len(kept))}


_OBJECT = re.compile(rb"(\d+) \d+ obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|\[(?:\((?:\\.|[^\\()])*\)|[^\]()])*\]\s*TJ|T\*|'|-?[\d.]+\s+-?[\d.]+\s+T[dD]\b|\bET\b", re.DOTALL)
_LITERAL = re.compile(rb"\((?:\\.|[^\\()])*\)|-?[\d.]+", re.DOTALL)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|.)", re.DOTALL)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(literal: bytes) -> str:
    code = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PLAIN.get(m[1], m[1])
    return _ESCAPED.sub(code, literal[1:-1]).decode("cp1252", "replace")


def _pdf_text(content: bytes) -> str:
    """The strings that a page's content shows, lines where the place moves down or a text object ends."""
    out: list[str] = []
    for m in _SHOWN.finditer(content):
        found = m[0]
        if found.startswith(b"("):
            out.append(_pdf_string(found))
        elif found.startswith(b"["):
            for part in _LITERAL.findall(found):
                out.append(_pdf_string(part) if part.startswith(b"(") else " " if float(part) < -200 else "")
        elif out and not out[-1].endswith("\n") and not re.search(rb"\s-?0+(\.0*)?\s+T[dD]", found):
            out.append("\n")
    return "".join(out).strip()


def pdf_file(content: bytes) -> tuple[str, list[dict], dict[str, str]]:
    """Pages of a PDF whose fonts are simple (one byte a character) and whose objects are not packed in streams."""
    if not content.startswith(b"%PDF") or b"/Encrypt" in content or b"/ObjStm" in content or b"/Type0" in content:
        raise NotImplementedError("this PDF needs an extractor of its own")
    objects = {int(number): body for number, body in _OBJECT.findall(content)}
    texts = []
    for _, body in sorted(objects.items()):
        if not re.search(rb"/Type\s*/Page\b", body):
            continue
        whole = b""
        listed = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+ \d+ R)", body)
        for number in re.findall(rb"(\d+) \d+ R", listed[1]) if listed else []:
            part = objects[int(number)]
            stream = _STREAM.search(part)
            whole += b"\n" + (zlib.decompressobj().decompress(stream[1]) if b"/FlateDecode" in part else stream[1]) if stream else b""
        texts.append(_pdf_text(whole))
    text, pages = paged(texts)
    return text, pages, {"page_count": str(len(pages))}


EXTRACTORS: dict[str, Extractor] = {"text": text_file, "docx": word_file, "excel": excel_file, "pdf": pdf_file}


def scan(spark: SparkSession, directory: str) -> DataFrame:
    """file_path, file_type, content of the supported files below directory; a missing directory has none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)  # the store's own reader: any scheme
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file_path string, file_type string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return files.select(F.col("path").alias("file_path"), T.file_type(F.col("path")).alias("file_type"), "content").where("file_type <> 'unknown'")


def dropped(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """file_path, file_type, reason of the files that `extracted` leaves out."""
    table = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["file_path"], batch["file_type"], batch["content"], strict=True):
                try:
                    if table.get(kind, missing(kind))(bytes(content)) is None:
                        rows.append((path, kind, "nothing extracted"))
                except Exception as error:  # noqa: BLE001
                    rows.append((path, kind, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["file_path", "file_type", "reason"])

    return files.mapInPandas(run, "file_path string, file_type string, reason string")


def extracted(files: DataFrame, extractors: dict[str, Extractor] | None = None, strict: bool = False) -> DataFrame:
    """One row for each file with text. strict: an extractor's error ends the job, else the file is dropped."""
    table = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["file_path"], batch["file_type"], batch["content"], strict=True):
                try:
                    found = table.get(kind, missing(kind))(bytes(content))
                except Exception:
                    if strict:
                        raise
                    continue
                if found is not None:
                    text, pages, metadata = found
                    rows.append((path, re.sub(r"^.*/", "", path), kind, text, pages, metadata))
            yield pd.DataFrame(rows, columns=["file_path", "file_name", "file_type", "text", "pages", "metadata"])

    return files.mapInPandas(run, DDL)


def with_ids(rows: DataFrame, order: str) -> DataFrame:
    """rows with doc_id 0 to n-1 in the order of a column: sorted by ranges, numbered within, moved by the ranges' sizes."""
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order)
    numbered = stored(dealt.select("*", F.spark_partition_id().alias("range"), (F.monotonically_increasing_id() % (1 << 33)).alias("place")), "files")
    sizes = {r["range"]: r["count"] for r in numbered.groupBy("range").count().collect()}  # one row a partition
    before, total = {}, 0
    for key in sorted(sizes):
        before[key], total = total, total + sizes[key]
    if not before:
        return numbered.select(F.lit(0).cast("bigint").alias("doc_id"), *rows.columns)
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("range")]
    return numbered.select((start + F.col("place")).alias("doc_id"), *rows.columns)


def documents(spark: SparkSession, directory: str, extractors: dict[str, Extractor] | None = None, name_terms: bool = True) -> DataFrame:
    """doc_id and DDL of the files below directory that have text."""
    rows = extracted(scan(spark, directory), extractors)
    if name_terms:
        rows = rows.where(F.trim("text") != "").withColumn("text", T.with_name_terms(F.col("text"), F.col("file_path")))
    return with_ids(rows.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != ""), "file_path")


def synonyms(spark: SparkSession, path: str) -> dict:
    """A synonym dictionary; a missing or broken file is an empty one."""
    import json

    try:
        return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    except Exception:  # noqa: BLE001
        return {}


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, name (normalised) of a JSON list of queries with their relevant files."""
    rows = spark.read.option("multiLine", True).schema("query string, relevant_docs array<string>").json(path)
    listed = rows.select(F.xxhash64("query").alias("query_id"), "query", F.explode_outer("relevant_docs").alias("file"))
    return listed.select("query_id", "query", T.normal_name(F.col("file")).alias("name"))


SUPPORTED = [e for extensions in fixed.FILE_TYPES.values() for e in extensions]
