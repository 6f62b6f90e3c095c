"""Token ids in Simple-8b files: 64-bit words, each a 4-bit selector and 60 bits of equal fields.

File: magic; the words of all blocks; block table (first word of each block); exceptions; document
table (ids, null flags, token counts); footer. A block holds BLOCK ids (the last one fewer) and is
coded by itself, so a reader takes any block range by its offsets and decodes all words of a
selector at once. An id of more than 60 bits is an escape: its word holds a place in the exceptions.

Edge cases: null and empty texts hold the end id alone; null document ids come first; rows that
repeat an id are written in order of text; very long texts run over as many blocks as they need;
other columns are ignored; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import shared_dir, ship, sliced, trimmed, utf8
from ledgerline.llm.files import new_file, open_file
from ledgerline.llm.units import library_encoder

MAGIC = b"S8IDS\x00\x00\x01"
BLOCK = 4096
#: (ids a word, bits an id) by selector; 15 is the escape.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
COUNTS = np.array([c for c, _ in PACKINGS] + [0, 1], np.int64)
FILE_ROW = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
FOOTER = struct.Struct("<QQQQQ8s")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words of each block, exceptions. Each word takes as many ids as fit; blocks go in step."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + 60), np.uint64)
    grid[:, :BLOCK].reshape(-1)[:] = 0
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    size = np.full(blocks, BLOCK, np.int64)
    if blocks:
        size[-1] = n - BLOCK * (blocks - 1)
    top = int(ids.max()) if n else 0
    best = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for s in range(len(PACKINGS) - 1, -1, -1):
        c, bits = PACKINGS[s]
        if top < 1 << bits:
            best[:] = s
            continue
        sums = np.zeros((blocks, BLOCK + 61), np.int32)
        np.cumsum(grid < np.uint64(1 << bits), axis=1, out=sums[:, 1:])
        best[sums[:, c : c + BLOCK] - sums[:, :BLOCK] == c] = s
    chosen = np.zeros((blocks, BLOCK), bool)
    rows, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(rows):
        chosen[rows, at] = True
        at = at + COUNTS[best[rows, at]]
        go = at < size[rows]
        rows, at = rows[go], at[go]
    r, p = np.nonzero(chosen)
    s = best[r, p]
    words = s.astype(np.uint64)
    for k, (c, bits) in enumerate(PACKINGS):
        own = np.flatnonzero(s == k)
        if len(own):
            fields = grid[r[own][:, None], p[own][:, None] + np.arange(c)]
            words[own] |= np.bitwise_or.reduce(fields << (4 + bits * np.arange(c)).astype(np.uint64), axis=1)
    odd = np.flatnonzero(s == ESCAPE)
    words[odd] |= np.arange(len(odd), dtype=np.uint64) << np.uint64(4)
    return words, np.bincount(r, minlength=blocks), grid[r[odd], p[odd]]


def unpack(words: np.ndarray, per_block: np.ndarray, n: int, exceptions: np.ndarray) -> np.ndarray:
    """The n ids of whole blocks, the words of a selector at a time."""
    blocks = len(per_block)
    s = (words & np.uint64(15)).astype(np.int64)
    took = COUNTS[s]
    row = np.repeat(np.arange(blocks), per_block)
    ends = np.cumsum(took)
    before = np.concatenate([[0], ends])[np.cumsum(per_block) - per_block]
    at = ends - took - before[row]
    grid = np.zeros((blocks, BLOCK + 60), np.uint64)
    for k, (c, bits) in enumerate(PACKINGS):
        own = np.flatnonzero(s == k)
        if len(own):
            fields = words[own][:, None] >> (4 + bits * np.arange(c)).astype(np.uint64) & np.uint64((1 << bits) - 1)
            grid[row[own][:, None], at[own][:, None] + np.arange(c)] = fields
    odd = np.flatnonzero(s == ESCAPE)
    if len(odd):
        grid[row[odd], at[odd]] = exceptions[(words[odd] >> np.uint64(4)).astype(np.int64)]
    return grid[:, :BLOCK].reshape(-1)[:n]


class Writer:
    """Takes documents in order; packs whole blocks as they fill."""

    def __init__(self, out, pending: int = 64 * BLOCK):
        self.out, self.pending = out, pending
        self.parts: list[np.ndarray] = []
        self.held = self.n_ids = self.n_words = 0
        self.block_words: list[np.ndarray] = []
        self.exceptions: list[np.ndarray] = []
        self.n_exceptions = 0
        self.docs: list[int] = []
        self.nulls = bytearray()
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: list[int]) -> None:
        self.docs += [0 if d is None else d for d in doc_ids]
        self.nulls += bytes(d is None for d in doc_ids)
        self.counts += counts
        self.parts.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.pending:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)
        words, per_block, odd = pack(ids[:n])
        if len(odd):  # places in the exceptions count over the file
            own = (words & np.uint64(15)) == ESCAPE
            words[own] += np.uint64(self.n_exceptions << 4)
        self.out.write(words.astype("<u8").tobytes())
        self.n_words += len(words)
        self.block_words.append(per_block)
        self.exceptions.append(odd)
        self.n_exceptions += len(odd)
        self.parts, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        per_block = np.concatenate(self.block_words)
        offsets = np.concatenate([[0], np.cumsum(per_block)]).astype("<u8")
        for x in (offsets, np.concatenate(self.exceptions).astype("<u8"), np.array(self.docs, "<i8"), np.frombuffer(bytes(self.nulls), np.uint8), np.array(self.counts, "<i8")):
            self.out.write(x.tobytes())
        self.out.write(FOOTER.pack(len(self.docs), self.n_ids, len(per_block), self.n_words, self.n_exceptions, MAGIC))


class Reader:
    """Reads block ranges of a file; the tables are read at once, the words as they are asked for."""

    def __init__(self, file):
        self.file = file
        end = file.size() - FOOTER.size
        n_docs, self.n_ids, blocks, n_words, n_odd, magic = FOOTER.unpack(file.read_at(FOOTER.size, end))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = len(MAGIC) + 8 * n_words

        def table(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(file.read_at(n * np.dtype(kind).itemsize, at), kind)
            at += found.nbytes
            return found

        self.offsets = table("<u8", blocks + 1).astype(np.int64)
        self.exceptions = table("<u8", n_odd)
        docs, nulls, self.counts = table("<i8", n_docs), table("u1", n_docs), table("<i8", n_docs)
        self.docs = [None if z else d for d, z in zip(docs.tolist(), nulls.tolist())]

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks a to b."""
        first, last = int(self.offsets[a]), int(self.offsets[b])
        words = np.frombuffer(self.file.read_at(8 * (last - first), len(MAGIC) + 8 * first), "<u8")
        return unpack(words, np.diff(self.offsets[a : b + 1]), min(self.n_ids, b * BLOCK) - a * BLOCK, self.exceptions)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Any range of ids."""
        a, b = start // BLOCK, -(-end // BLOCK)
        return self.blocks(a, b)[start - a * BLOCK : end - a * BLOCK] if end > start else np.empty(0, np.uint64)

    def documents(self, most: int = 256 * BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
        """(number, start, ids) of each document, reading about `most` ids at a time."""
        ends = np.cumsum(self.counts)
        i = 0
        while i < len(ends):
            start = int(ends[i] - self.counts[i])
            j = max(i + 1, int(np.searchsorted(ends, start + most, "right")))
            held = self.ids(start, int(ends[j - 1]))
            for k in range(i, j):
                yield k, int(ends[k] - self.counts[k]), held[int(ends[k] - self.counts[k]) - start : int(ends[k]) - start]
            i = j


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str | None = None, kind: str = "folded", id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes one file a range of ids (kind: how texts are cut for the encoder); returns for each file, in order: uri, docs, ids, base (ids before it)."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_dir(spark, "token-ids")
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri, made = f"{folder}/ids-{part:06d}.s8b", None
        for batch in batches:
            if made is None and batch.num_rows:
                made = new_file(uri)
                writer = Writer(made.__enter__())
            encoder = library_encoder(path, kind)
            for part_ in sliced(batch, 1):
                ids, counts = encoder.encode(part_.column(1), end_id)
                writer.add(part_.column(0).to_pylist(), ids, counts.tolist())
        if made is not None:
            writer.close()
            made.__exit__(None, None, None)
            yield pa.RecordBatch.from_pylist([{"part": part, "uri": uri, "docs": len(writer.docs), "ids": writer.n_ids}], FILE_ROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted(dealt.mapInArrow(trimmed(run), "part int, uri string, docs long, ids long").collect())  # one row a file
    base, out = 0, []
    for f in files:
        out.append({"uri": f.uri, "docs": f.docs, "ids": f.ids, "base": base})
        base += f.ids
    return out


def read_ids(spark, files: list[dict], keep: bool = False) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32; with keep also its ids."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * keep
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_file(uri) as f:
                    reader, out = Reader(f), []
                    for k, start, ids in reader.documents():
                        out.append((reader.docs[k], base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] if keep else [])))
                        if len(out) >= 2000:
                            yield _batch(out, keep)
                            out = []
                    if out:
                        yield _batch(out, keep)

    table = spark.createDataFrame([(f["uri"], f["base"]) for f in files], "uri string, base long")
    return table.repartition(len(files)).mapInArrow(trimmed(run), schema)


def _batch(rows: list[tuple], keep: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows))], names)
