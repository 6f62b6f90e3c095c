"""Threshold-scaled document sketches.

The sketch of a text is every 64-bit hash of its five-word shingles that lies below a fixed
fraction (1 / SCALE) of the hash range, and its LEAST smallest hashes where that gives fewer, so a
short text is sketched by all or most of its shingles. Up to some hash a sketch holds every one the
text has: two sketches are compared up to the lesser of these bounds. Sketches of any texts merge by
union, and their intersections estimate likeness (shared over all) and containment (shared over the
one text's own) whatever the difference in length.

Error against the exact likeness of all shingles: none for two texts of up to LEAST shingles; beyond
that the standard deviation is at most 0.5 / sqrt(hashes compared), that is below 0.063 with 64 of
them (68 to 512 words) and below 0.5 / sqrt(words / SCALE) for longer texts (0.045 at 1,000 words).

Next documents are found without a global sort: documents are dealt to ranges of doc_id, each
range's first document is dealt to the range before it as well, and a task walks its ranges in order.

Edge cases: null text counts as empty; a text of fewer words than a shingle has one shingle of all
its words, an empty one the shingle of no words; equal texts have equal sketches; of rows with one
id the order is by text; null ids come first; a single document is its own next one; an empty table
gives an empty result; very long texts are sketched whole; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ship, utf8

SCALE = 8
LEAST = 64
WORDS = 5
SEED = 1


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < 500_000 and len(word) < 64:
            self[word] = h
        return h


_word_hash = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3; its multipliers are fixed values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """One hash for each run of `words` words, in order; order within the run counts."""
    if len(_word_hash) >= 500_000:
        _word_hash.clear()
    found = text.split()
    h = np.fromiter(map(_word_hash.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    acc = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for i in range(min(words, len(h))):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return acc


def _kept(hashes: np.ndarray, scale: int) -> np.ndarray:
    """Of sorted distinct hashes those below 2^64 / scale, and the LEAST smallest."""
    return hashes[: max(LEAST, int(np.searchsorted(hashes, np.uint64((1 << 64) // scale))))]


def sketch(text: bytes, scale: int = SCALE, words: int = WORDS) -> np.ndarray:
    """The sorted hashes kept of a text's shingles."""
    h = shingles(text, words)
    if len(h) > 8 * LEAST:  # most texts: no need to sort what lies far above
        low = np.unique(h[h < np.uint64((1 << 64) // scale)])
        if len(low) >= LEAST:
            return low
    return _kept(np.unique(h), scale)


def bound(s: np.ndarray, scale: int = SCALE) -> int:
    """The sketch holds every hash of its text up to this one."""
    if len(s) < LEAST:
        return (1 << 64) - 1
    return max((1 << 64) // scale - 1, int(s[LEAST - 1]))


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return _kept(np.union1d(a, b), scale)


def _compared(a: np.ndarray, b: np.ndarray, scale: int) -> tuple[int, int, int]:
    """Hashes of a, of b and of both, up to where both are whole."""
    upto = np.uint64(min(bound(a, scale), bound(b, scale)))
    a, b = a[: np.searchsorted(a, upto, "right")], b[: np.searchsorted(b, upto, "right")]
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of all shingles of the two texts that both have."""
    n, m, shared = _compared(a, b, scale)
    return shared / (n + m - shared) if n + m else 0.0


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of a's shingles that b has."""
    n, _, shared = _compared(a, b, scale)
    return shared / n if n else 0.0


def packed(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def unpacked(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def id_ranges(docs: DataFrame, id_col: str, n: int) -> list[int]:
    """First ids of at most n ranges of about equal size; each is an id of the table."""
    at = ",".join(f"{i / n!r}D" for i in range(1, n))
    row = docs.agg(F.min(id_col).alias("a"), F.expr(f"percentile_approx(`{id_col}`, array({at}), {20 * n})").alias("b")).first()
    return sorted({row["a"], *row["b"]}) if row["a"] is not None else []


def range_number(col: str, edges: list[int], wide: int = 64) -> Column:
    """The number of edges that are at most the id, in two steps: blocks of edges, then edges of one block."""
    blocks = [edges[i : i + wide] for i in range(0, len(edges), wide)]
    below = lambda arr: F.size(F.filter(arr, lambda e: e <= F.col(col)))
    listed = lambda ids: f"array({','.join(f'CAST({i} AS BIGINT)' for i in ids)})"  # noqa: E731  as text: one call, whatever the number of ranges
    heads = F.expr(listed([b[0] for b in blocks]))
    inner = F.expr(f"array({','.join(map(listed, blocks))})")
    block = F.greatest(below(heads), F.lit(1))
    return F.when(F.col(col).isNull(), F.lit(1)).otherwise((block - 1) * wide + below(F.element_at(inner, block))).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """Per document its sketch, the sketch of its edited text, and likeness and containment with it and with the next document."""
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    edges = id_ranges(rows.select("doc_id"), "doc_id", 4 * n) or [0]
    nulls = rows.where("doc_id IS NULL").limit(1).count() > 0
    number = range_number("doc_id", edges)
    # A range's first rows also stand at the end of the range before it; the very first at the end of the last.
    edge = F.expr(f"array({','.join(f'CAST({e} AS BIGINT)' for e in edges)})")
    starts = F.col("doc_id") == F.element_at(edge, number)
    if nulls:
        starts = F.col("doc_id").isNull() | (starts & (number > 1))
    before = F.when(number == 1, F.lit(len(edges))).otherwise(number - 1)
    own = F.struct(number.alias("r"), F.lit(0).alias("tail"))
    placed = F.when(F.coalesce(starts, F.lit(False)), F.array(own, F.struct(before.cast("int").alias("r"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    dealt = rows.select(F.inline(placed), "doc_id", "text").repartition(n, "r").sortWithinPartitions("r", "tail", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, seen_tail = None, [], None
        for batch in batches:
            for r, tail, doc, text in zip(*(batch.column(i) for i in range(4))):
                r, tail = r.as_py(), tail.as_py()
                if tail and seen_tail == r:
                    continue  # only the first of the rows that follow a range
                text = text.as_buffer().to_pybytes()
                own = sketch(text, scale, words)
                if held is not None and held[0] == r:
                    out.append(compared(*held[1:], text, own))
                if tail:
                    seen_tail, held = r, None
                else:
                    held = (r, doc.as_py(), text, own)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, names)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, names)

    names = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[(c, pa.float64()) for c in ("near_edited", "near_next", "contained_edited", "contained_next")]])

    def compared(doc: int | None, text: bytes, own: np.ndarray, after: bytes, after_sketch: np.ndarray) -> dict:
        chars = text.decode()
        half = len(chars) // 2
        edited = (chars[: len(chars) - half] + after.decode()[:half]).encode()
        other = sketch(edited, scale, words)
        return {
            "doc_id": doc, "n_chars": len(chars), "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": packed(own), "edited_fingerprint": packed(other),
            "near_edited": likeness(own, other, scale), "near_next": likeness(own, after_sketch, scale), "contained_edited": containment(own, other, scale), "contained_next": containment(own, after_sketch, scale),
        }

    return dealt.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
