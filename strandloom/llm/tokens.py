"""Token ids of whole texts by the ``tokenizers`` library, with caches for words that were seen before.

The vocabulary file's path is a parameter. For the word-level BPE files used here, normalisation, splitting and
merging never look across ASCII white space, so a text's ids are the ids of its white-space chunks one after another.
A chunk of plain Latin characters is lower-cased, split by the file's own pattern, and each piece is merged by the
library's BPE model; any other chunk (special-token strings, controls, combining marks, other scripts) goes through
the library's whole ``encode``. Tests hold both ways against ``encode`` on the whole text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

END_ID = 1
#: Entries of each of a worker's two caches, some 30 MB in all; larger ones are not faster.
CACHE_WORDS = 150_000
_PLAIN = re.compile("[!-~¡-įı-ɏ]+")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, others follow U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Chunks(dict):
    def __init__(self, encoder: WordEncoder):
        super().__init__({"": b""})
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self[""] = b""
        ids = self.encoder.chunk(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


class WordEncoder:
    """``encode(text)`` gives the ids as little-endian bytes of ``dtype`` (2 bytes where the vocabulary allows it)."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), END_ID + 1) <= 65536 else "<u4")
        self.end = np.array([END_ID], self.dtype).tobytes()
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.by_chunk = kinds == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0].get("invert") is True
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"]) if self.by_chunk else None
        specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.by_chunk = self.by_chunk and not any(s.isalpha() or any(c.isspace() for c in s) for s in specials)
        self.special = re.compile("|".join(map(re.escape, specials)) or "(?!)")
        self.byte_chars = _byte_alphabet()
        self.pieces: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.piece(chunk.lower())
        if not _PLAIN.fullmatch(chunk) or self.special.search(chunk):
            return self.whole(chunk)
        text = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
        if chunk.isascii() and chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return self.piece(text[:-1]) + self.piece(text[-1])
        return b"".join(map(self.piece, self.pattern.findall(text)))

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            chars = piece if piece.isascii() else "".join(map(self.byte_chars.__getitem__, piece.encode()))
            ids = array(self.code, [t.id for t in self.model.tokenize(chars)]).tobytes()
            if len(piece) <= 64:
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk:
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))

    def document(self, text: str | None) -> bytes:
        """The ids with the end id."""
        return self.encode(text) + self.end

    def forget(self) -> None:
        """Drop the caches: workers outlive their tasks, and the next stage needs the memory."""
        self.pieces.clear()
        self.chunks.clear()
        self.chunks[""] = b""


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
