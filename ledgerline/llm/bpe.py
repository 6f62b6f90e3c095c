"""BPE by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick automaton over the reversed tokens, run over the reversed text, lists at each
position the tokens that start there, longest first. The encoder goes left to right: it takes the
longest token whose end is not known to be a dead end and that is compatible with the token before
it, and steps back when none is. Two tokens are compatible if merging their joined text gives just
these two; that is found by undoing merges from the latest to the earliest and looking for an
earlier merge across the boundary, and is kept in a table. A prefix has one valid encoding, so a
position that fails once is dead: the time is linear in the text.

Edge cases: null text has no ids; special tokens in a text become their ids, as in the tokenizers
library; a text of any length is one pass; null ids keep their null; repeated rows are rows of their
own; other columns are ignored; an empty table gives an empty result. A file that asks for another
normaliser or splitter is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.common import by_chunk, utf8
from ledgerline.llm.units import FAR, SPLITS, UnitEncoder, byte_alphabet, checked, normalised
from ledgerline.llm.words import pieces_of

END = ""  # the end of a word, glued to its last symbol
BREAK = ""  # in no token


class BacktrackingBpe:
    """The merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.suffix = suffix
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        back = {c: chr(b) for b, c in enumerate(byte_alphabet())}

        def plain(token: str) -> str:
            end = bool(suffix) and token.endswith(suffix)
            return "".join(back[c] for c in (token[: -len(suffix)] if end else token)) + END * end

        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        # Own numbers: single symbols first, then merge results in the order of their merges.
        self.names = base + [a + b for a, b in merges]
        number = {t: i for i, t in enumerate(self.names)}
        assert len(number) == len(self.names), "a token is the result of two merges"
        self.ids = np.array([vocab[t] for t in self.names], np.uint32)
        first = len(base)
        self.first = first
        self.left = [number[a] for a, _ in merges]
        self.right = [number[b] for _, b in merges]
        self.pairs = {(l, r): first + i for i, (l, r) in enumerate(zip(self.left, self.right))}
        texts = [plain(t) for t in self.names]
        self.lengths = [len(t) for t in texts]
        self.table: dict[int, bool] = {}
        sound = [True] * first
        for i in range(len(merges)):  # tokens that merging their own text does not give are never found in a text
            l, r = self.left[i], self.right[i]
            sound.append(sound[l] and sound[r] and self._walk(l, r, first + i))
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(texts):
            if sound[i]:
                self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}

    def _walk(self, a: int, b: int, limit: int) -> bool:
        """Do tokens a, b stay apart before merge `limit`? Undoes the latest of their merges, step by step."""
        pairs, first, left, right = self.pairs, self.first, self.left, self.right
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                if a < first:
                    return True
                limit, a = a, right[a - first]
            else:
                if b < first:
                    return True
                limit, b = b + 1, left[b - first]  # of equal merges the left one comes first

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 1_000_000:
                self.table.clear()
            known = self.table[key] = self._walk(a, b, 1 << 40)
        return known

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Own token numbers of each piece (bytes as latin-1, with END where the vocabulary has one)."""
        return [x for a, b in _spans(pieces) for x in self._encode_span(pieces[a:b])]

    def _encode_span(self, pieces: list[str]) -> list[list[int]]:
        text = BREAK.join(pieces)
        size = len(text)
        starts_here: list[list[int]] = [[] for _ in range(size + 1)]
        for end, token in self.automaton.iter(text[::-1]):
            starts_here[size - 1 - end].append(token)
        lengths, table, compatible = self.lengths, self.table, self.compatible
        out, base = [], 0
        for piece in pieces:
            stop = base + len(piece)
            tokens: list[int] = []
            chosen: list[int] = []
            dead: set[int] = set()
            at, k, last = base, 0, -1
            while at < stop:
                here = starts_here[at]
                n = len(here)
                while k < n:
                    token = here[k]
                    if at + lengths[token] not in dead and (last < 0 or (table.get(last << 20 | token) if (last << 20 | token) in table else compatible(last, token))):
                        break
                    k += 1
                if k < n:
                    tokens.append(token)
                    chosen.append(k)
                    at, k, last = at + lengths[token], 0, token
                else:
                    if not tokens:
                        raise ValueError("a symbol is not in the vocabulary")
                    dead.add(at)
                    at -= lengths[tokens.pop()]
                    k = chosen.pop() + 1
                    last = tokens[-1] if tokens else -1
            out.append(tokens)
            base = stop + 1
        return out


def _spans(pieces: list[str], most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, p in enumerate(pieces):
        if i > a and size + len(p) > most:
            yield a, i
            a, size = i, 0
        size += len(p)
    if a < len(pieces):
        yield a, len(pieces)


class WordBpe:
    """The normaliser and splitter of the word-end vocabulary around BacktrackingBpe; units are white-space runs."""

    PATTERN = SPLITS["folded"][1]

    def __init__(self, path: str):
        checked(path, "folded")
        self.bpe = BacktrackingBpe(path)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")")
        names = [""] * (int(max(self.bpe.ids.max(), *self.bpe.special.values())) + 1)
        for t, i in [*zip(self.bpe.names, self.bpe.ids.tolist()), *self.bpe.special.items()]:
            names[i] = t
        blob = [(n + " ").encode() for n in names]
        self.offsets = np.cumsum([0, *map(len, blob)])
        self.library = Tokenizer.from_file(path)
        self.raw = {ord(c): b for b, c in enumerate(byte_alphabet())}
        self.blob = np.frombuffer(b"".join(blob), np.uint8)

    def split(self, text: str) -> list[str]:
        """Pieces as latin-1 of their UTF-8. Outside the Latin blocks the classes of characters depend on the
        Unicode version, so there the library's own normaliser and splitter are asked."""
        if text.isascii():
            return SPLITS["folded"][0].findall(text.lower())
        if FAR.search(text):
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [p.translate(self.raw) for p, _ in found]
        return [p.encode().decode("latin-1") for p in self.PATTERN.findall(normalised(text))]

    def many(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit: distinct pieces are encoded once a call."""
        split: list[tuple | list] = []
        new: dict[str, int] = {}
        for u in units:
            text = u.decode()
            if u.isalpha():
                own = (text.lower(),)
            elif "<|" in text:
                parts = [self.bpe.special[p] if p in self.bpe.special else self.split(p) for p in self.cut.split(text) if p]
                own = [x for p in parts for x in ([p] if isinstance(p, int) else p)]
            else:
                own = self.split(text)
            split.append(own)
            for p in own:
                if not isinstance(p, int):
                    new.setdefault(p, len(new))
        coded = self.bpe.encode_pieces([p + END for p in new])
        ids = self.bpe.ids
        counts = np.empty(len(split), np.int64)
        flat: list[int] = []
        for i, own in enumerate(split):
            before = len(flat)
            for p in own:  # special tokens as numbers below zero
                flat += [-1 - p] if isinstance(p, int) else coded[new[p]]
            counts[i] = len(flat) - before
        numbers = np.array(flat, np.int64)
        return np.where(numbers < 0, -1 - numbers, ids[np.maximum(numbers, 0)]).astype(np.uint32), counts

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by a space, gathered by offset."""
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        lengths = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(lengths)
        return self.blob[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()[:-1]


_word: dict[str, tuple[WordBpe, UnitEncoder]] = {}


def word_bpe(path: str) -> tuple[WordBpe, UnitEncoder]:
    """A worker's encoder for the file, built once."""
    if path not in _word:
        bpe = WordBpe(path)
        _word[path] = (bpe, UnitEncoder(lambda texts: pieces_of(texts, False), bpe.many))
    return _word[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256; with keep also ids and the decoded text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe, units = word_bpe(path)
        ids, counts = units.encode(batch.column(1))
        ends = np.cumsum(counts)
        each = [ids[e - n : e] for n, e in zip(counts.tolist(), ends.tolist())]
        decoded = [bpe.decode(x) for x in each]
        cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep:
            cols += [pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())), pa.array([x.decode() for x in decoded])]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return by_chunk(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * keep).withColumnRenamed("doc_id", id_col)
