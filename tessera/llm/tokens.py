"""Public vocabularies as bounded word caches: tokens of whole texts at the price of a lookup for each word."""

from __future__ import annotations

import re
from functools import cache

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

#: Entries of each cache; a full cache starts anew, so that memory stays bounded on any corpus.
CACHE_WORDS, CACHE_CORES = 200_000, 600_000

#: A run of Latin letters and a run of signs: two pretokens whatever stands around them. No apostrophe, no digit.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*,.:;|?]*)")


def _spelling() -> dict[int, int]:
    """Byte-level vocabularies spell each byte as one character: those that print as themselves, others from 256 on."""
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + i for i, b in enumerate(others)}


_SPELLED = _spelling()


class WordBpe(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes, equal to encoding it with the vocabulary's file.

    The vocabulary drops white space and never joins across it, so a text's ids are its words' ids end to end. Words
    come as UTF-8 bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.cores: dict[str, bytes] = {}
        probes = ["probe", "größe", "ñàÿ", "?!", "*"]
        self.direct = True  # a run of letters or signs is one pretoken, which the merges take as it is
        self.direct = all(self.core(p) == self.encode(p) for p in probes)
        self.cores.clear()

    def encode(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def core(self, part: str) -> bytes:
        got = self.cores.get(part)
        if got is None:
            if len(self.cores) >= CACHE_CORES:
                self.cores.clear()
            if self.direct:
                spelled = part if part.isascii() else part.encode().decode("latin-1").translate(_SPELLED)
                got = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelled))
            else:
                got = self.encode(part)
            self.cores[part] = got
        return got

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if simple := _SIMPLE.fullmatch(text):
            letters, signs = simple.groups()
            ids = self.core(letters.lower())
            if signs:
                ids += self.core(signs)
        else:
            ids = self.encode(text)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


class WordPieces(dict):
    """Word to its piece ids as little-endian unsigned 16-bit bytes; every word is encoded by itself."""

    def __init__(self, path: str):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = [i for i in range(self.model.get_piece_size()) if self.model.is_byte(i)]

    def __missing__(self, word: bytes) -> bytes:
        ids = b"".join(i.to_bytes(2, "little") for i in self.model.encode(word.decode("utf-8", "replace"), num_threads=1))
        if len(self) >= CACHE_CORES:
            self.clear()
        self[word] = ids
        return ids


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


@cache
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(path)


@cache
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)
