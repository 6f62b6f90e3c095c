"""Encoding a text piece by piece, with each distinct piece encoded once.

A piece is a part of a text that a tokenizer's pre-tokenizer treats independently of its
neighbours; a text's ids are its pieces' ids in order. Pieces repeat, so a worker keeps a table of
the pieces it has met; the table is emptied when it has grown past a bound.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from ledgerline.llm.words import Words, pieces_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class _Index(dict):
    """piece -> number; a new one gets the next number and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[bytes] = []
        self.bytes = 0

    def __missing__(self, unit: bytes) -> int:
        n = self[unit] = len(self)
        self.waiting.append(unit)
        self.bytes += len(unit)
        return n


class UnitEncoder:
    """cut: a binary column -> Words; encode_many: pieces -> (flat ids, count per piece). most_units, most_bytes: bound of the table."""

    def __init__(self, cut: Callable[[pa.Array], Words], encode_many: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most_units: int = 350_000, most_bytes: int = 16 << 20):
        self.cut, self.encode_many, self.most_units, self.most_bytes = cut, encode_many, most_units, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self) -> None:
        new = self.index.waiting
        if not new:
            return
        ids, counts = self.encode_many(new)
        first, n = len(self.index) - len(new), len(self.index)
        if n > len(self.starts):
            self.starts = np.resize(self.starts, 2 * n)
            self.lengths = np.resize(self.lengths, 2 * n)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[first:n] = counts
        self.starts[first:n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.index.waiting = []

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (a binary column), each text followed by end_id if there is one, and the count of each text."""
        if len(self.index) > self.most_units or self.index.bytes > self.most_bytes:
            self._clear()
        codes, words, names = self.cut(texts)
        numbers = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        self._add()
        lengths, starts = self.lengths[numbers][codes], self.starts[numbers][codes]
        ends = np.cumsum(lengths)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
        counts = np.diff(edges)
        ids = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(edges[-1])]
        return (ids, counts) if end_id is None else (np.insert(ids, edges[1:], end_id), counts + 1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


BYTE_LEVEL = dict(enumerate(byte_alphabet()))
#: Outside the Latin blocks the classes of characters depend on the Unicode version.
FAR = re.compile("[^\x00-\u024f]")
#: The splitting patterns of the two vocabulary files, for ASCII texts and for others.
SPLITS = {
    "spaced": (
        re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"),
        regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
    ),
    "folded": (
        re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+"),
        regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"),
    ),
}


#: What a vocabulary file asks for before its merges; a file that asks for anything else is refused.
ASKED = {
    "spaced": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, ""),
    "folded": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "</w>",
    ),
}


def checked(path: str, kind: str) -> dict:
    """The content of a vocabulary file, if it asks for the normaliser and splitter of this kind and has plain merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    found = (spec.get("normalizer"), spec.get("pre_tokenizer"), model.get("end_of_word_suffix") or "")
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    if found != ASKED[kind] or not plain or not special:
        raise ValueError(f"{path} asks for another normaliser, splitter or model than a {kind} vocabulary")
    return spec


def is_plain(piece: bytes) -> bool:
    """Letters of ASCII, perhaps after one space: no pattern would split it."""
    return piece.isalpha() or (piece[:1] == b" " and piece[1:].isalpha())


class LibraryUnits:
    """Ids of pieces through the tokenizers library's model. Pieces that hold special tokens or characters outside the
    Latin blocks go through the library whole. plain: special tokens are ordinary text."""

    def __init__(self, path: str, kind: str, plain: bool = False):
        from tokenizers import Tokenizer

        checked(path, kind)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = plain
        self.model, self.fold = self.tok.model, kind != "spaced"
        self.ascii, self.latin = (p.findall for p in SPLITS[kind])

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ask, level, fold = self.model.tokenize, BYTE_LEVEL, self.fold
        whole: list[tuple[int, str]] = []
        ids: list[int] = []
        ends: list[int] = []
        for unit in units:
            text = unit.decode()
            if unit.isalpha() or is_plain(unit):
                ids += [t.id for t in ask(text.translate(level))]
            elif "<|" in text or FAR.search(text):
                whole.append((len(ends), text))
            else:
                text = normalised(text) if fold else text
                parts = (text,) if text.isalpha() or (text[0] == " " and text[1:].isalpha()) else (self.ascii if text.isascii() else self.latin)(text)
                for p in parts:
                    ids += [t.id for t in ask((p if p.isascii() else p.encode().decode("latin-1")).translate(level))]
            ends.append(len(ids))
        flat_ids, counts = np.array(ids, np.uint32), np.diff(np.array([0, *ends], np.int64))
        if whole:
            coded = self.tok.encode_batch_fast([t for _, t in whole], add_special_tokens=False)
            flat_ids = np.insert(flat_ids, np.repeat([ends[i] for i, _ in whole], [len(e.ids) for e in coded]), np.fromiter(chain.from_iterable(e.ids for e in coded), np.uint32))
            counts[[i for i, _ in whole]] = [len(e.ids) for e in coded]
        return flat_ids, counts


def normalised(text: str) -> str:
    """NFC, then lower case character by character (a final sigma is like any other)."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


_encoders: dict[tuple, UnitEncoder] = {}


def library_encoder(path: str, kind: str) -> UnitEncoder:
    """A worker's encoder for a tokenizer file of the tokenizers library; kind: folded (case and white space do not count) or spaced."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = UnitEncoder(lambda texts: pieces_of(texts, kind == "spaced"), LibraryUnits(path, kind))
    return _encoders[path, kind]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
