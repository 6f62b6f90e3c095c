"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

Documents are encoded once; what is longer than a sequence gives whole sequences and a remainder.
Only the histogram of remainders (one count a length) reaches the driver. There the lengths are
placed longest first: a count of equal pieces goes into the pattern with the most room, splitting
its count, or opens a new pattern. Where that leaves too much padding (very many equal lengths), a
counted share of those remainders is cut to the size of the room and the plan is made again, as long
as that lowers the padding by a hundredth; then single packs are dissolved into the room of others.
What stays is at most PADDING of all, or, where few documents leave nothing to share, less than a
sequence for each pattern (tests hold both).
Patterns are joined back by rank: the k-th piece of a length belongs to the pattern whose rank
range has k. Ranks come from running counts within the part that wrote a document plus the counts
of the parts before, so no text or id is moved.

Edge cases: null and empty texts are one end id; a document of any length is cut into whole
sequences; repeated rows are documents of their own; null ids are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import shared_dir, ship, sliced, trimmed, utf8, written
from ledgerline.llm.files import new_file, open_file
from ledgerline.llm.units import library_encoder

SEQUENCE = 1024
PADDING = 0.005


def shortest_pack_first(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a pack, longest first) and how many packs have each."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (free := max((f for f, packs in room.items() if packs), default=0)) >= length:  # the shortest packs
            packs = room[free]
            pattern = max(packs)
            n = packs.pop(pattern)
            used = min(n, left)
            if n > used:
                packs[pattern] = n - used
            room[free - length][pattern + (length,)] += used
            left -= used
        each = size // length
        if left >= each:
            room[size - each * length][(length,) * each] += left // each
        if left % each:
            room[size - left % each * length][(length,) * (left % each)] += 1
    return sorted(((p, n) for packs in room.values() for p, n in packs.items()), reverse=True)


def plan(counts: dict[int, int], size: int = SEQUENCE, padding: float = PADDING) -> tuple[dict[int, list[tuple[int, tuple[int, ...]]]], list[tuple[tuple[int, ...], int]]]:
    """Cuts by length (how many of its remainders, into which parts; in rank order) and the patterns."""
    cuts: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    whole = {k: v for k, v in counts.items() if v}
    parts: dict[int, int] = defaultdict(int)
    patterns, before = shortest_pack_first(whole, size), None
    while True:
        waste = sum((size - sum(p)) * n for p, n in patterns)
        if waste <= padding * size * sum(n for _, n in patterns) or waste < size or before is not None and waste > 0.99 * before:
            break
        before = waste
        new_cuts = 0
        for pattern, n in sorted(patterns, key=lambda x: -(size - sum(x[0])) * x[1]):
            free = size - sum(pattern)
            share = n * free // size  # so many packs fill the room of the others
            if not share:
                continue
            for length in dict.fromkeys(pattern):
                take = min(share * pattern.count(length), whole.get(length, 0))
                if length <= free or not take:
                    continue
                cut = (free,) * (length // free) + ((length % free,) if length % free else ())
                cuts[length].append((take, cut))
                whole[length] -= take
                for c in cut:
                    parts[c] += take
                new_cuts += take
        if not new_cuts:
            break
        total = defaultdict(int, whole)
        for k, v in parts.items():
            total[k] += v
        patterns = shortest_pack_first({k: v for k, v in total.items() if v}, size)
    return cuts, _fill(dict(patterns), whole, cuts, size, padding)


def _fill(patterns: dict[tuple[int, ...], int], whole: dict[int, int], cuts: dict, size: int, padding: float) -> list[tuple[tuple[int, ...], int]]:
    """Dissolves the emptiest packs one by one into the room of the others; for what has no counts to share: less than a
    sequence a pattern, so the steps are bounded by the patterns, whatever the documents."""
    most = 2000 + 4 * len(patterns)
    by_room: dict[int, set[tuple[int, ...]]] = defaultdict(set)
    for p in patterns:
        by_room[size - sum(p)].add(p)
    packs, waste = sum(patterns.values()), sum((size - sum(p)) * n for p, n in patterns.items())

    def change(p: tuple[int, ...], by: int) -> None:
        patterns[p] = patterns.get(p, 0) + by
        (by_room[size - sum(p)].add if patterns[p] else by_room[size - sum(p)].discard)(p)
        if not patterns[p]:
            del patterns[p]

    for _ in range(most):
        if waste <= padding * size * packs or waste < size:
            break
        room = max((r for r, own in by_room.items() if own), default=0)
        victim = max((p for p in by_room[room] if all(whole.get(x, 0) >= p.count(x) for x in p)), default=None)
        if victim is None:
            break
        change(victim, -1)
        for length in victim:
            left, cut = length, []
            while left:
                rooms = [r for r, own in by_room.items() if own and r]
                part = min(left, max((r for r in rooms if r <= left), default=left))
                into = next((max(by_room[r]) for r in sorted(rooms) if r >= part), ())
                if into:
                    change(into, -1)
                change(into + (part,), 1)
                packs += not into
                cut.append(part)
                left -= part
            if len(cut) > 1:
                cuts[length].append((1, tuple(cut)))
                whole[length] -= 1
        packs -= 1
        waste -= size
    return sorted(patterns.items(), reverse=True)


class Assignment:
    """Where the piece of a rank goes: per length, rank ranges with their sequence and offset."""

    def __init__(self, counts: dict[int, int], size: int = SEQUENCE):
        self.size = size
        cuts, patterns = plan(counts, size)
        self.cuts: dict[int, list[tuple[int, int, tuple[int, ...], list[int]]]] = {}
        used = {k: v - sum(n for n, _ in cuts.get(k, [])) for k, v in counts.items()}  # ranks of uncut remainders come first
        self.uncut = dict(used)
        for length, own in cuts.items():
            first, rows = self.uncut[length], []
            for n, parts in own:
                bases = []
                for p in parts:
                    bases.append(used.get(p, 0))
                    used[p] = used.get(p, 0) + n
                rows.append((first, first + n, parts, bases))
                first += n
            self.cuts[length] = rows
        ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        sequence = 0
        for pattern, n in patterns:
            offset = 0
            for length in pattern:
                ranges[length].append((taken[length], sequence, offset))
                taken[length] += n
                offset += length
            sequence += n
        if dict(taken) != {k: v for k, v in used.items() if v}:
            raise RuntimeError("the plan does not place every piece")
        self.ranges = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in ranges.items()}
        self.sequences = sequence

    def place(self, length: int, rank: int) -> tuple[int, int]:
        starts, sequences, offsets = self.ranges[length]
        i = int(np.searchsorted(starts, rank, "right")) - 1
        return int(sequences[i]) + rank - int(starts[i]), int(offsets[i])

    def pieces(self, length: int, rank: int) -> Iterator[tuple[int, int, int]]:
        """(length, sequence, offset) of each part of the remainder with this rank."""
        for first, end, parts, bases in self.cuts.get(length, []) if rank >= self.uncut[length] else []:
            if first <= rank < end:
                for p, base in zip(parts, bases):
                    yield p, *self.place(p, base + rank - first)
                return
        yield length, *self.place(length, rank)


def encoded(docs: DataFrame, path: str, end_id: int, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each document (uint32) with its part and, in the part, its rank among equal remainders and the whole sequences before it."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, full = TaskContext.get().partitionId(), defaultdict(int), 0
        for batch in batches:
            encoder = library_encoder(path, "spaced")
            for piece in sliced(batch, 1):
                flat, counts = encoder.encode(piece.column(1), end_id)
                ranks = np.empty(len(counts), np.int64)
                for i, r in enumerate((counts % size).tolist()):
                    ranks[i] = seen[r]
                    seen[r] += 1
                wholes = counts // size
                fulls = full + np.cumsum(wholes) - wholes
                full += int(wholes.sum())
                ends = 4 * np.concatenate([[0], np.cumsum(counts)])
                blobs = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), part, np.int32)), piece.column(0), pa.array(counts), pa.array(ranks), pa.array(fulls), blobs], ["part", "doc_id", "n", "rank", "full_before", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), "part int, doc_id long, n long, rank long, full_before long, ids binary")


def pack_documents(docs: DataFrame, path: str, end_id: int, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep also its ids."""
    spark = docs.sparkSession
    ids = written(encoded(docs, path, end_id, size, id_col, text_col), "packing-ids")
    by_part = written(ids.groupBy("part", (F.col("n") % size).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.floor(F.col("n") / size)).cast("long").alias("f")), "packing-counts")
    counts = {row.r: row.c for row in by_part.groupBy("r").agg(F.sum("c").alias("c")).collect() if row.r}  # one row a length
    plan_ = Assignment(counts, size)
    # Counts of the parts before: for each length, and (as length -1) for whole sequences.
    order = Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = by_part.groupBy("part").agg(F.sum("f").alias("c")).select("part", F.lit(-1).alias("r"), "c")
    before = by_part.select("part", "r", "c").union(whole).withColumn("c", F.coalesce(F.sum("c").over(order), F.lit(0)))
    folder = shared_dir(spark, "packing-offsets")

    def offsets(key, table):
        with new_file(f"{folder}/{key[0].as_py()}.arrow") as out:
            out.write(np.stack([table["r"].to_numpy().astype(np.int64), table["c"].to_numpy().astype(np.int64)]).tobytes())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())})

    before.groupBy("part").applyInArrow(offsets, "part int").agg(F.count(F.lit(1))).collect()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<bigint>" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, base = None, {}
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep
        for batch in batches:
            out: list[tuple] = []
            for part, doc, n, rank, full_before, blob in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if part != loaded:
                    with open_file(f"{folder}/{part}.arrow") as f:
                        r, c = np.frombuffer(f.read(), np.int64).reshape(2, -1)
                    loaded, base = part, dict(zip(r.tolist(), c.tolist()))
                pieces = [(size, plan_.sequences + base[-1] + full_before + k, 0) for k in range(n // size)]
                if n % size:
                    pieces += plan_.pieces(n % size, base[n % size] + rank)
                at = 0
                for length, sequence, offset in pieces:
                    own = blob[4 * at : 4 * (at + length)]
                    out.append((doc, at, length, zlib.crc32(own), n, sequence, offset, *([np.frombuffer(own, "<u4").astype(np.int64)] if keep else [])))
                    at += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.int64()) if m == "ids" else pa.int64()) for m, c in zip(names, zip(*out))], names)

    return ids.mapInArrow(trimmed(run), schema).withColumnRenamed("doc_id", id_col)
