"""SimHash near-dedup: 64-bit fingerprints, exact tiled comparison, connected components.

A fingerprint links to every other within `radius` bits. Equal fingerprints are one node, so a
group of copies costs one row. The 64 bits are cut into radius + 2 blocks: two fingerprints within
the radius agree on at least two whole blocks, so every link falls into a bucket keyed by some pair
of blocks. Inside a bucket the fingerprints are sorted by population count and compared tile by
tile with exclusive-or and bit counts; a tile pair whose population counts differ by more than the
radius is skipped (with 64 even bits, 53 of 100 pairs of fingerprints differ by more than 3; most
buckets hold two or three fingerprints and are one tile). A bucket of more than BIG fingerprints is
not compared by the task that meets it: its tiles, one a population count or a hashed part of one,
become pairs of tiles, dealt as rows, so that any number of tasks share it. A bucket or a pair hands
on a spanning forest of its links, never all pairs.

Edge cases: null and word-free texts have fingerprint zero and link like any other; repeated rows
and ids are nodes of their own fingerprint; very long texts are hashed whole, in stretches; an empty
table gives an empty result; other columns are ignored. Of several rows with one id, each is
returned. Null ids come out with the component of their fingerprint; a component of null ids only
has a null component_id. keep_one decides by row: of rows that repeat the least id, the first in its
file stays; null ids come last.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_chunk, join_skewed, keep_rows, marked, on_files, ship, utf8, written
from ledgerline.llm.components import connected_components

SEED = 42
TILE = 2048
BIG = 16_384


def shingle_hashes(text: bytes, k: int = 3) -> np.ndarray:
    """XXH64 of each k-word shingle of the ASCII-lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    if k == 3:
        return np.fromiter((h(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2)
    return np.fromiter((h(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1)


def fingerprint(text: bytes, k: int = 3) -> int:
    """Bit b is one if it is set in over half of the shingle hashes (as an unsigned number)."""
    hashes = shingle_hashes(text, k)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        part = hashes[a : a + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the carried columns: the fingerprint as a signed long with the same bits."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), k) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *carry])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), *carry)
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return by_chunk(rows, run, "doc_id long, fp long" + kinds)


def _join_groups(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of the nodes i and j; group[x] is the least node of x's group."""
    while True:
        a, b = group[i], group[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(group, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            further = group[group]
            if np.array_equal(further, group):
                break
            group[:] = further


def _roots(fps: np.ndarray, radius: int, split: int | None = None) -> np.ndarray:
    """For distinct fingerprints, the index of the root of each one's group within the radius (compared tile by tile).
    split: only those before it against those from it on."""
    n = len(fps)
    ones = np.bitwise_count(fps).astype(np.int16)
    group = np.arange(n)
    sides = [np.arange(n)] * 2 if split is None else [np.arange(split), np.arange(split, n)]
    sides = [side[np.argsort(ones[side], kind="stable")] for side in sides]
    for a in range(0, len(sides[0]), TILE):
        left = sides[0][a : a + TILE]
        least, most = ones[left[0]], ones[left[-1]]
        for b in range(a if split is None else 0, len(sides[1]), TILE):
            right = sides[1][b : b + TILE]
            if ones[right[0]] - most > radius:  # sorted by population count: no later tile is nearer
                break
            if least - ones[right[-1]] > radius:
                continue
            near = np.bitwise_count(fps[left][:, None] ^ fps[right][None]) <= radius
            near &= group[left][:, None] != group[right][None]
            i, j = np.nonzero(near)
            if len(i):
                _join_groups(group, left[i], right[j])
    return group


def bucket_keys(column: str, radius: int, blocks: int | None = None):
    """An array of bucket keys: the bits of each pair of blocks, with the pair's number."""
    blocks = blocks or radius + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = lambda i: F.shiftrightunsigned(F.col(column), edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1)
    keys = []
    for number, (i, j) in enumerate(combinations(range(blocks), 2)):
        width = edges[j + 1] - edges[j]
        keys.append(F.shiftleft(F.shiftleft(part(i), width).bitwiseOR(part(j)), 5).bitwiseOR(F.lit(number).cast("long")))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = 3, big: int = BIG) -> DataFrame:
    """(a, b): a spanning forest of each bucket's links between distinct fingerprints (column fp)."""
    ship(distinct.sparkSession)
    n = max(8, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            two = starts[ends - starts == 2]
            if len(two):  # most buckets: compared all at once
                two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
                a.append(fps[two]), b.append(fps[two + 1])
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                own = fps[s:e]
                roots = _roots(own, radius)
                moved = np.flatnonzero(roots != np.arange(len(own)))
                if len(moved):
                    a.append(own[roots[moved]]), b.append(own[moved])
            if a:
                a_, b_ = (np.concatenate(x).view(np.int64) for x in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(a_), pa.array(b_), pa.array(np.zeros(len(a_), bool))], ["a", "b", "later"])

        def later(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64)), pa.array(np.ones(len(keys), bool))], ["a", "b", "later"])

        held_k, held_f, passed = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            held_k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            if len(held_k) and passed is not None and held_k[0] == passed:  # the rest of a large bucket
                k = int(np.searchsorted(held_k, passed, "right"))
                yield later(held_k[:k], held_f[:k])
                held_k, held_f = held_k[k:], held_f[k:]
            last = int(np.searchsorted(held_k, held_k[-1], "left")) if len(held_k) else 0
            if last:  # the last key may go on in the next batch
                yield from out(held_k[:last], held_f[:last])
                held_k, held_f = held_k[last:], held_f[last:]
            if len(held_k) > big:
                passed = int(held_k[0])
                yield later(held_k, held_f)
                held_k, held_f = held_k[:0], held_f[:0]
        if len(held_k):
            yield from out(held_k, held_f)

    keyed = distinct.select(F.explode(bucket_keys("fp", radius)).alias("key"), "fp")
    found = written(keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(groups, "a long, b long, later boolean"), "simhash-links")
    forest = found.where("NOT later").select("a", "b")
    large = found.where("later").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    return forest.union(tile_links(large, radius, big)) if large.limit(1).count() else forest


def tile_links(large: DataFrame, radius: int, big: int = BIG) -> DataFrame:
    """(a, b): forests of the links in large buckets (key, fp), by pairs of tiles of at most about `big` fingerprints."""
    n = max(8, int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ones = F.bit_count("fp").alias("ones")
    parts = written(large.groupBy("key", ones).agg(F.ceil(F.count(F.lit(1)) / big).cast("int").alias("parts")), "simhash-tiles")
    tiles = parts.select("key", "ones", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left, right = (tiles.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("ones", "part")]) for side in "lr")
    near = (F.col("r_ones") - F.col("l_ones")).between(0, radius) & ((F.col("l_ones") < F.col("r_ones")) | (F.col("l_part") <= F.col("r_part")))
    # Pairs of tiles, not of fingerprints: their number is that of the comparisons of tiles to be made.
    pairs = left.join(right.hint("shuffle_hash"), "key").where(near).withColumn("pair", F.xxhash64("key", "l_ones", "l_part", "r_ones", "r_part"))
    same = (F.col("l_ones") == F.col("r_ones")) & (F.col("l_part") == F.col("r_part"))
    sides = written(
        pairs.select("key", F.col("l_ones").alias("ones"), F.col("l_part").alias("part"), "pair", F.lit(0).alias("side")).union(
            pairs.where(~same).select("key", F.col("r_ones").alias("ones"), F.col("r_part").alias("part"), "pair", F.lit(1).alias("side"))
        ),
        "simhash-pairs",
    )
    placed = large.withColumn("ones", F.bit_count("fp")).join(parts, ["key", "ones"]).select("key", "ones", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "fp")
    dealt = placed.join(sides, ["key", "ones", "part"]).select("pair", "side", "fp").repartition(n, "pair").sortWithinPartitions("pair", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(side: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            split = int((side == 0).sum())
            roots = _roots(fps, radius, split if split < len(fps) else None)
            moved = np.flatnonzero(roots != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[x].view(np.int64)) for x in (roots[moved], moved)], ["a", "b"])

        held: list[np.ndarray] = [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint64)]
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate([x, y]) for x, y in zip(held, new)]
            cuts = [0, *(np.flatnonzero(np.diff(held[0])) + 1).tolist()] if len(held[0]) else [0]
            for x, y in zip(cuts, cuts[1:]):
                yield out(held[1][x:y], held[2][x:y])
            held = [x[cuts[-1] :] for x in held]
        if len(held[0]):
            yield out(held[1], held[2])

    return dealt.mapInArrow(compare, "a long, b long")


def _components(rows: DataFrame, least: str, radius: int) -> DataFrame:
    """Of rows (fp and a column to take the least of): fp, n, least, root of each distinct fingerprint; written."""
    distinct = written(rows.groupBy("fp").agg(F.min(least).alias(least), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    comp = connected_components(links(distinct.select("fp"), radius))
    return written(distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, k: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links within the radius."""
    rows = written(fingerprints(docs, id_col, text_col, k), "simhash")
    named = _components(rows, "doc_id", radius)
    roots = written(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "simhash-roots")
    verdict = written(join_skewed(named.select("fp", "n", "root"), roots, "root", "nodes").select("fp", "n", "component_id"), "simhash-verdict")
    return join_skewed(rows, verdict, "fp", "n").select("doc_id", "fp", "component_id")


def with_hex(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns."""
    docs = on_files(docs)
    found = fingerprints(marked(docs), id_col, text_col, carry=("__file", "__row"))
    rows = found.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row").alias("first"))
    named = _components(rows, "first", radius)
    return keep_rows(docs, named.groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
