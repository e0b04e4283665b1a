"""Quality rules on tokeniser fertility (operator 7).

Base figures of every whole text, as plain counts, and a base rule: under 20 words, or more than 30 % of the words
inside 8-word windows that occur twice or more in the text. Then the method's verdict: a public vocabulary splits every
word into pieces, and characters per token, byte-fallback share and token entropy must lie in the bands of the text's
language (or of its script, where the language has none).

The chars-per-token band runs from `lowest` to `highest`, and `spread / sqrt(words)` beyond both: a mean over few words
strays further, and a clean short text must not go for that. Entropy is judged against what the number of tokens
allows. The bands are constants, checked on public text in 100-word pieces: docstrings of Python's library for English,
message catalogues for 24 other languages (99 of 100 of each lie inside). They don't depend on the corpus at hand, so a
document's verdict never depends on other documents. The script of a text is that of most of its letters.

Defined cases: null or empty text has all counts 0, base_failed true and kept false; repeated rows get equal verdicts;
unknown and null languages use the script's band; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tessera.llm.common import SPACE, Rolling, chunks, raw_text
from tessera.llm.tokens import WordPieces, vocabulary, word_pieces

MIN_WORDS, REPEAT_WIDTH, REPEAT_PERCENT = 20, 8, 30

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """Limits of one language or script."""

    lowest: float
    highest: float
    spread: float
    most_fallback: float
    least_entropy: float

    def allowance(self, words: np.ndarray) -> np.ndarray:
        return self.spread / np.sqrt(np.maximum(words, 1))


#: Characters per token in the 32k vocabulary, share of byte fallback, entropy in bits for a long text. Of 100-word pieces
#: of public text the middle 98 % have: English 2.0 to 4.4, French 1.9 to 3.2, German 2.1 to 3.1, Spanish 2.0 to 3.2.
LANGUAGES = {
    "en": Band(2.19, 5.0, 2.4, 0.05, 4.6),
    "fr": Band(1.95, 5.0, 2.4, 0.05, 4.6),
    "de": Band(2.21, 5.0, 2.4, 0.05, 4.6),
    "es": Band(1.91, 5.0, 2.4, 0.05, 4.6),
}
#: Other languages by script. Measured likewise: Latin 1.1 (Vietnamese) to 3.2, Cyrillic 1.5 to 2.5, Greek 0.85 to 1.3,
#: Hebrew and Arabic 0.8 to 1.4, Devanagari 0.8 to 1.0, Georgian 0.9 to 1.2, Han and kana 0.8 to 1.9, Hangul 0.7 to 1.6;
#: scripts that the vocabulary lacks are bytes throughout.
SCRIPTS = {
    "latin": Band(1.0, 5.0, 2.0, 0.20, 4.0),
    "cyrillic": Band(1.3, 3.5, 2.0, 0.10, 4.0),
    "greek": Band(0.75, 2.2, 1.0, 0.10, 3.5),
    "semitic": Band(0.7, 2.2, 1.0, 0.15, 3.5),
    "han": Band(0.6, 2.6, 1.0, 0.50, 4.0),
    "hangul": Band(0.5, 2.6, 1.0, 0.50, 4.0),
    "other": Band(0.2, 2.3, 1.0, 1.00, 2.5),
}
NAMES = list(SCRIPTS)


def _scripts() -> np.ndarray:
    """Script by the first byte of a letter's UTF-8 form; -1 for bytes that begin no letter."""
    out = np.full(256, -1, np.int64)
    for name, ranges in {
        "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9)], "greek": [(0xCD, 0xCF)], "cyrillic": [(0xD0, 0xD4)], "semitic": [(0xD6, 0xDD)],
        "other": [(0xDE, 0xE2), (0xEE, 0xF4)], "han": [(0xE3, 0xE9)], "hangul": [(0xEA, 0xED)],
    }.items():
        for a, b in ranges:
            out[a : b + 1] = NAMES.index(name)
    out[0xE2] = -1  # punctuation and signs
    return out


SCRIPT = _scripts()

OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")]
    + [("chars_per_token", pa.float64()), ("fallback_share", pa.float64()), ("entropy", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
)
OUT_DDL = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, fallback_share double, entropy double, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes], hashes: np.ndarray, width: int) -> int:
    """Words of one text inside a width-word window that it holds twice or more; equal hashes are checked on the words."""
    if len(words) <= width:
        return 0
    first = np.arange(len(words) - width + 1)
    window = Rolling(hashes, 0xE7037ED1A0B428DB).of(first, first + width)
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(first), dtype=bool)
    seen: dict[bytes, int] = {}
    numbers = np.lib.stride_tricks.sliding_window_view(np.array([seen.setdefault(w, len(seen)) for w in words]), width)
    a, b = order[:-1][same], order[1:][same]
    if (numbers[a] == numbers[b]).all():
        again[a] = again[b] = True
    else:  # different windows of one hash
        count = Counter(map(tuple, numbers.tolist()))
        again[:] = [count[tuple(w)] > 1 for w in numbers.tolist()]
    at = np.flatnonzero(again)
    cover = np.zeros(len(words) + 1, np.int64)
    cover[at] += 1
    np.subtract.at(cover, at + width, 1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return again


def measure(offsets: np.ndarray, data: np.ndarray, langs: list, pieces: WordPieces) -> dict[str, np.ndarray]:
    """All figures of rows that lie end to end."""
    n = len(offsets) - 1
    out = {name: np.zeros(n, np.int64) for name in OUT.names[1:7]} | {name: np.zeros(n) for name in OUT.names[7:10]}
    lowest, highest = min(pieces.byte_ids), max(pieces.byte_ids)
    script, digest = np.zeros(n, np.int64), xxhash.xxh64_intdigest
    for i, j in chunks(offsets):
        segment, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        solid = np.concatenate(([0], np.cumsum(~SPACE[segment] & ((segment & 0xC0) != 0x80))))
        signs = np.concatenate(([0], np.cumsum(SYMBOL[segment])))
        out["word_chars"][i:j] = solid[bounds[1:]] - solid[bounds[:-1]]
        out["n_symbols"][i:j] = signs[bounds[1:]] - signs[bounds[:-1]]
        letters = SCRIPT[segment]
        for r in range(i, j):
            a, b = bounds[r - i], bounds[r - i + 1]
            text = segment[a:b].tobytes()
            script[r] = np.bincount(letters[a:b] + 1, minlength=len(NAMES) + 1)[1:].argmax()
            words = text.split()
            out["n_words"][r] = len(words)
            out["n_repeat_words"][r] = repeated_words(words, np.fromiter(map(digest, words), np.uint64, len(words)), REPEAT_WIDTH)
            out["n_dup_lines"][r] = repeated_lines(text)
            ids = np.frombuffer(b"".join(map(pieces.__getitem__, words)), np.uint16)
            if len(ids):
                share = np.unique(ids, return_counts=True)[1] / len(ids)
                out["n_tokens"][r] = len(ids)
                out["chars_per_token"][r] = out["word_chars"][r] / len(ids)
                out["fallback_share"][r] = np.count_nonzero((ids >= lowest) & (ids <= highest)) / len(ids)
                out["entropy"][r] = -(share * np.log2(share)).sum()
    words = out["n_words"]
    failed = (words < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * words)
    bands = [LANGUAGES.get(lang or "") or SCRIPTS[NAMES[k]] for lang, k in zip(langs, script, strict=True)]
    lowest_mean, highest_mean = np.array([b.lowest for b in bands]), np.array([b.highest for b in bands])
    allowed = np.array([b.allowance(w) for b, w in zip(bands, words, strict=True)])
    # Few tokens can't be varied: the floor falls with the entropy that as many different tokens would have.
    floor = np.minimum([b.least_entropy for b in bands], 0.5 * np.log2(np.maximum(out["n_tokens"], 2)))
    mean = out["chars_per_token"]
    fair = (mean >= lowest_mean - allowed) & (mean <= highest_mean + allowed) & (out["fallback_share"] <= [b.most_fallback for b in bands]) & (out["entropy"] >= floor)
    return out | {"base_failed": failed, "kept": ~failed & fair}


def verdicts(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, the figures, base_failed and kept, for every row of docs (doc_id, text, lang)."""
    path = vocabulary_path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(path)
        for batch in batches:
            found = measure(*raw_text(batch["text"]), batch["lang"].to_pylist(), pieces)
            columns = [batch["doc_id"].cast(pa.int64())] + [pa.array(found[name], OUT.field(name).type) for name in OUT.names[1:]]
            yield pa.RecordBatch.from_arrays(columns, schema=OUT)
        pieces.clear()  # a worker that goes on to other work holds no words

    return docs.select("doc_id", "text", "lang").mapInArrow(run, OUT_DDL)


def accepted(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """The rows of docs, all columns unchanged, that the rules keep: one narrow pass."""
    path = vocabulary_path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(path)
        for batch in batches:
            found = measure(*raw_text(batch["text"]), batch["lang"].to_pylist(), pieces)
            yield batch.filter(pa.array(found["kept"]))
        pieces.clear()

    return docs.mapInArrow(run, docs.schema)
