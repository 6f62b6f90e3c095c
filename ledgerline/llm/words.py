"""Cutting the texts of a chunk into words or units at once, and naming each distinct one once.

All passes are over the chunk's bytes as one array: where runs of white space start and end gives the
offsets of an Arrow column of words, and Arrow's dictionary encoding numbers the distinct ones. Python
then meets each distinct word of a chunk once, however often it stands there.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: ASCII white space, x20 and x09 to x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = bytes([b + 32 if 65 <= b <= 90 else b for b in range(256)])


class Words(NamedTuple):
    """codes: the number of each word, text after text; counts: words of each text; names: the distinct words."""

    codes: np.ndarray
    counts: np.ndarray
    names: list[bytes]


def flat(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a binary column's rows (nulls as empty) and the offset of each row."""
    column = column.fill_null(b"") if column.null_count else column
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = column.buffers()[2]
    return (values.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if values is not None and len(column) else b""), offsets - offsets[0]


def _named(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the pieces that the offsets cut, and the distinct pieces."""
    wide = len(data) >= 1 << 31
    kind, number = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
    cut = pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(number)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = cut.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def words_of(column: pa.Array) -> Words:
    """Runs without ASCII white space."""
    blob, offsets = flat(column)
    data = np.frombuffer(blob, np.uint8)
    here = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a text starts or ends here
    edge[offsets] = True
    first, last = here.copy(), here.copy()
    first[1:] &= ~here[:-1] | edge[1:-1]
    last[:-1] &= ~here[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    codes, names = _named(data[here], np.concatenate([[0], np.cumsum(ends - starts)]))
    return Words(codes, np.diff(np.searchsorted(starts, offsets)), names)


def single_spaced(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text, each with one space after it, as bytes; and where each word ends (at its space). No list of
    words is made, so a very long text costs a few times its bytes."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return data, np.empty(0, np.int64)
    here = ~IS_SPACE[data]
    keep = here.copy()
    keep[1:] |= here[:-1]  # the one white space after a word
    out = data[keep]
    spaces = ~here[keep]
    out[spaces] = 32
    if here[-1]:
        out, spaces = np.append(out, np.uint8(32)), np.append(spaces, True)
    return out, np.flatnonzero(spaces)


#: 0 white space, 1 letters (and every byte of other characters), 2 digits, 3 the rest.
KIND = np.full(256, 3, np.uint8)
KIND[IS_SPACE] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
#: First bytes of U+00C0 to U+024F, where all but U+00D7, U+00F7 are letters; U+0130 has no single lower case.
LATIN = np.zeros(256, bool)
LATIN[0xC3:0xCA] = True
APART = re.compile(rb"\xc3[\x97\xb7]|\xc4\xb0")
SPECIAL = re.compile(rb"<\|")
CONTRACTION = re.compile(rb"'(?:[stmd]|re|ve|ll)")
#: UTF-8 of the white space outside ASCII (Unicode White_Space).
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _places(pattern: re.Pattern, blob: bytes) -> np.ndarray:
    return np.fromiter((m.start() for m in pattern.finditer(blob)), np.int64)


def pieces_of(column: pa.Array, spaced: bool) -> Words:
    """Pieces that the splitters of the two byte-level vocabularies treat alone, as far as bytes tell: runs of letters,
    of digits, of other characters. A word that holds anything else (a contraction, a special token, characters outside
    the Latin blocks) stays whole, for a pattern to split.

    spaced: white space counts, and a piece holds the one space before it; a word that stays whole holds all the white
    space before it, and a text with white space outside ASCII is one piece. Else it is dropped, letters are in lower
    case and each digit stands alone.
    """
    blob, offsets = flat(column)
    data = np.frombuffer(blob, np.uint8)
    n = len(data)
    if not n:
        return Words(np.empty(0, np.int32), np.zeros(len(column), np.int64), [])
    kind = KIND[data]
    inner = offsets[1:-1][offsets[1:-1] < n]  # where one text follows another
    here = kind > 0
    word = here.copy() if not spaced else ~here  # first byte of a word, or of the white space before it
    word[1:] &= here[1:] & ~here[:-1] if not spaced else here[:-1]
    word[inner] = here[inner] if not spaced else True
    word[0] = here[0] if not spaced else True
    if not spaced:
        first = here.copy()
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    else:
        first = ~here
        after = here[1:] & ~here[:-1]  # a word starts
        first[1:] &= here[:-1]
        first[:-1] |= after  # the last of the white space before it
        first[1:] |= after & (data[:-1] != 32)
        first[1:] |= here[1:] & here[:-1] & (kind[1:] != kind[:-1])
    if len(inner):
        at_end = inner[~here[inner - 1] & here[inner]] if spaced else inner[:0]  # white space that ends a text is one piece
        if len(at_end):
            before = at_end - 1
            keep = (before > 0) & ~here[np.maximum(before - 1, 0)] & ~np.isin(before, inner)
            first[before[keep]] = False
    first[inner] = here[inner] if not spaced else True
    first[0] = here[0] if not spaced else True
    lower = blob if spaced else blob.translate(LOWER)
    odd = [_places(CONTRACTION, lower)] if b"'" in blob else []
    special = _places(SPECIAL, blob) if b"<|" in blob else np.empty(0, np.int64)
    odd.append(special)
    if not blob.isascii():
        odd += [np.flatnonzero((data >= 0xC0) & ~LATIN[data]), _places(APART, blob)]
    odd_at = np.concatenate(odd)
    if len(odd_at):
        starts = np.flatnonzero(word)
        mine = np.unique(np.searchsorted(starts, odd_at, "right") - 1)
        _whole(first, starts[mine], np.append(starts, n)[mine + 1])
    if spaced and not blob.isascii() and WIDE_SPACE.search(blob):
        rows = np.unique(np.searchsorted(offsets, _places(WIDE_SPACE, blob), "right") - 1)
        _whole(first, offsets[rows], offsets[rows + 1])
    starts = np.flatnonzero(first)
    if spaced:
        codes, names = _named(data, np.append(starts, n))
    else:
        upto = np.concatenate([[0], np.cumsum(here, dtype=np.int64)])
        low = np.frombuffer(lower, np.uint8)
        if len(special):  # a word that may hold a special token keeps its case
            low, words = low.copy(), np.append(np.flatnonzero(word), n)
            for k in np.unique(np.searchsorted(words, special, "right") - 1).tolist():
                low[words[k] : words[k + 1]] = data[words[k] : words[k + 1]]
        codes, names = _named(low[here], np.append(upto[starts], upto[-1]))
    return Words(codes, np.diff(np.searchsorted(starts, offsets)), names)


def _whole(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """No piece starts inside the ranges a to b, only at a."""
    edge = np.zeros(len(first) + 1, np.int32)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    first &= np.cumsum(edge[:-1]) == 0
    first[a] = True
