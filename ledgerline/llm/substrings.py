"""Substring dedup: words covered by a run of `window` words that also starts earlier go.

1. Each document is cut into segments: maximal runs of windows with one minimizer (the least hash
   of the GRAM-word runs in the window). Equal windows have equal minimizers, so dealing segments by
   minimizer brings all copies of a window to one shard, whatever the number of shards.
2. A minimizer met once cannot bring a copy. The others are found by a count with partial
   aggregation; only their segments go on. A minimizer of more than HOT windows would make a shard
   too large; its windows are dealt one by one, by the hash of the whole window.
3. A task that cuts segments hands on equal ones once, with all their places, so a passage in very
   many documents reaches a shard as one row a task.
4. A shard goes through blocks of whole minimizers. The first segment of each minimizer goes into a
   compressed FM-index; the others, which are not in it, are streamed through it by backward search.
   That gives a match length for each word. Where it reaches `window`, the index knows the earliest
   place of these words, and the window goes if that is before its own. What matched nowhere is
   indexed in a second round, whose sorted suffixes show what repeats among it.
5. The ranges to remove go back to documents.

Positions are (document id, text hash, word): rows that repeat an id are told apart by their text,
and rows that are equal in both are not earlier than each other. Edge cases: null text has no words;
texts of fewer words than a window lose none; very long texts are cut like others; null ids come
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_chunk, ship, trimmed, utf8, written
from ledgerline.llm.fingerprints import _mix
from ledgerline.llm.fmindex import FmIndex, Suffixes, least_of_groups
from ledgerline.llm.words import single_spaced, words_of

WINDOW = 20
GRAM = 6
HOT = 20_000
LONGEST = 256
BLOCK_BYTES = 2 << 20
HELD_BYTES = 16 << 20
PLACES = 22  # bits of a place within a stretch of words
LEAST_ID = -(1 << 63)


def word_hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in names), np.uint64, len(names))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    n = len(h) - size + 1
    acc = np.zeros(max(0, n), np.uint64)
    for i in range(size if n > 0 else 0):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n] + np.uint64(1))
    return acc


def least_runs(g: np.ndarray, width: int, bits: int = PLACES) -> np.ndarray:
    """Place of the least of each `width` neighbouring hashes.

    Less is by the upper 40 bits, then the leftmost: that depends on what the window holds alone. The place goes into
    the low bits of the hash, so that plain minima of shifted arrays find it; longer arrays are done in stretches, each
    of which counts its places anew."""
    low, step = np.uint64((1 << bits) - 1), (1 << bits) - width
    high = ~np.uint64((1 << 24) - 1)
    out = np.empty(max(0, len(g) - width + 1), np.int64)
    for start in range(0, len(out), step):
        part = g[start : start + step + width - 1]
        now = (part & high) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            now = np.minimum(now[:-size], now[size:])
            size *= 2
        if size < width:
            now = np.minimum(now[: len(now) - (width - size)], now[width - size :])
        out[start : start + len(now)] = start + (now & low).astype(np.int64)
    return out


def segments(h: np.ndarray, lengths: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, minimizer, first window, windows, weight) of the segments of documents whose word hashes stand
    one after another. Weight 2: the segment may repeat itself."""
    offsets = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - window + 1, 0)
    total = int(counts.sum())
    if not total:
        return (np.empty(0, np.int64),) * 5
    doc = np.repeat(np.arange(len(lengths)), counts)
    first = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    place = first + offsets[doc]
    g = run_hashes(h, gram)
    at = least_runs(g, window - gram + 1)[place]
    least = g[at]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([starts, [total]]))
    moved = np.add.reduceat(np.concatenate([[0], at[1:] != at[:-1]]) * ~new, starts)
    weight = 1 + (moved > 0)
    if sizes.max() > LONGEST:
        pieces = -(-sizes // LONGEST)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end = np.repeat(starts, pieces) + k * LONGEST, np.repeat(starts + sizes, pieces)
        weight = np.repeat(weight, pieces)
        starts, sizes = begin, np.minimum(LONGEST, end - begin)
    return doc[starts], least[starts].view(np.int64), first[starts], sizes, weight


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """key: the id, null as the least; mark: tells rows of one id apart; rest: columns to hand through."""
    text = utf8(text_col)
    rest = F.struct(*carry) if carry else F.lit(0)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"), rest.alias("rest"))


def _occurrences(keyed: DataFrame, window: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes, counts, names = words_of(batch.column(2))
        i, m, a, c, w = segments(word_hashes(names)[codes] if len(names) else np.empty(0, np.uint64), counts, window)
        if len(m):
            i = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(m), batch.column(0).take(i), batch.column(1).take(i), pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(w.astype(np.int32))], ["m", "key", "mark", "a", "c", "w"])

    return by_chunk(keyed.select("key", "mark", "text"), run, "m long, key long, mark long, a int, c int, w int")


def candidates(keyed: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Per document the segments whose minimizer may bring a copy: key, mark, segs (m, a, c, hot)."""
    found = _occurrences(keyed, window)
    twice = found.groupBy("m").agg(F.sum("w").alias("w"), F.sum("c").alias("n")).where("w > 1").select("m", (F.col("n") > hot).alias("hot"))
    kept = found.select("m", "key", "mark", "a", "c").join(twice.hint("merge"), "m")
    return written(kept.groupBy("key", "mark").agg(F.collect_set(F.struct("a", "c", "m", "hot")).alias("segs")), "substring-candidates")


SEGMENT = "m long, key long, mark long, a int, content binary, places array<struct<key: long, mark: long, a: int>>"
PLACE = pa.struct([("key", pa.int64()), ("mark", pa.int64()), ("a", pa.int32())])


class _Held:
    """Distinct segment contents, each with its minimizer and its places."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.minimizer = array("q")
        self.owner, self.key, self.mark, self.a = array("q"), array("q"), array("q"), array("q")
        self.bytes = 0

    def add(self, m: int, content: bytes, key: int, mark: int, a: int) -> None:
        n = self.number.setdefault(content, len(self.number))
        if n == len(self.minimizer):
            self.minimizer.append(m)
            self.bytes += len(content) + 100
        self.owner.append(n)
        self.key.append(key)
        self.mark.append(mark)
        self.a.append(a)
        self.bytes += 32

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row a content; its places in order, the first one in columns of its own."""
        owner, key, mark, a = (np.array(x, np.int64) for x in (self.owner, self.key, self.mark, self.a))
        order = np.lexsort((a, mark, key, owner))
        owner, key, mark, a = owner[order], key[order], mark[order], a[order]
        first = np.searchsorted(owner, np.arange(len(self.number)))
        places = pa.StructArray.from_arrays([pa.array(key), pa.array(mark), pa.array(a.astype(np.int32))], fields=list(PLACE))
        listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), places)
        out = pa.RecordBatch.from_arrays([pa.array(np.array(self.minimizer, np.int64)), pa.array(key[first]), pa.array(mark[first]), pa.array(a[first].astype(np.int32)), pa.array(list(self.number), pa.binary()), listed], ["m", "key", "mark", "a", "content", "places"])
        for i in range(0, out.num_rows, 8192):
            yield out.slice(i, 8192)


def _cut(joined: DataFrame, window: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The candidate segments' words; equal ones that a task holds at a time are one row."""
    ship(joined.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            edges, fields = batch.column(3).offsets.to_numpy().tolist(), [batch.column(3).values.field(f).to_numpy(zero_copy_only=False).tolist() for f in ("a", "c", "m", "hot")]
            base = edges[0]
            for i, (key, mark, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                text = text.as_buffer().to_pybytes()
                joint, ends = single_spaced(text)
                starts, joint, own = np.append(0, ends[:-1] + 1), joint.tobytes(), None
                for a, c, m, hot in zip(*(f[edges[i] - base : edges[i + 1] - base] for f in fields)):
                    if not hot:
                        held.add(m, joint[starts[a] : ends[a + c + window - 2]], key, mark, a)
                    else:
                        if own is None:
                            codes, _, names = words_of(pa.array([text], pa.large_binary()))
                            own = run_hashes(word_hashes(names)[codes], window).view(np.int64)
                        for j in range(a, a + c):
                            held.add(int(own[j]), joint[starts[j] : ends[j + window - 1]], key, mark, j)
                    if held.bytes > held_bytes:
                        yield from held.rows()
                        held = _Held()
        if held.number:
            yield from held.rows()

    return joined.select("key", "mark", "text", "segs", "rest").mapInArrow(trimmed(run), SEGMENT)  # rest: so that both joins read one exchange


class Block(NamedTuple):
    """Segments in order of (minimizer, place): word numbers from 1, 0 after each segment."""

    text: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    m: np.ndarray
    key: np.ndarray
    mark: np.ndarray
    a: np.ndarray

    def take(self, rows: np.ndarray, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> Block:
        """Some segments, or parts of them (rows repeat then)."""
        begins, ends = self.begins[rows] if begins is None else begins, self.ends[rows] if ends is None else ends
        sizes = ends - begins + 1
        new_ends = np.cumsum(sizes) - 1
        new_begins = new_ends - sizes + 1
        at = np.repeat(begins - new_begins, sizes) + np.arange(int(sizes.sum()))
        text = self.text[np.minimum(at, len(self.text) - 1)].copy()
        text[new_ends] = 0
        return Block(text, new_begins, new_ends, self.m[rows], self.key[rows], self.mark[rows], self.a[rows] + begins - self.begins[rows])

    def owner(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place)

    def positions(self, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, mark, word) of places in the text."""
        own = np.minimum(self.owner(place), len(self.ends) - 1)
        return self.key[own], self.mark[own], self.a[own] + place - self.begins[own]

    def ranks(self) -> np.ndarray:
        """Numbers of all places that order windows by position, equal for equal positions. Windows of two segments of one
        text never interleave, so segments are ordered, and places within one."""
        order = np.lexsort((self.a, self.mark, self.key))
        new = np.zeros(len(order), np.int64)
        new[1:] = (np.diff(self.key[order]) != 0) | (np.diff(self.mark[order]) != 0) | (np.diff(self.a[order]) != 0)
        row = np.empty(len(order), np.int64)
        row[order] = np.cumsum(new)
        sizes = self.ends - self.begins + 1
        return np.repeat(row * int(sizes.max(initial=1)) - self.begins, sizes) + np.arange(len(self.text))

    def starts(self, window: int) -> np.ndarray:
        """Where windows start."""
        inside = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(inside, self.begins, 1)
        np.add.at(inside, np.maximum(self.ends - window + 1, self.begins), -1)
        return np.flatnonzero(np.cumsum(inside[:-1]) > 0)


def _before(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Positions of a that come before those of b."""
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


def _repeated(block: Block, suffixes: Suffixes, window: int) -> np.ndarray:
    """The places of the block's windows that also stand at an earlier one of its places, from the sorted suffixes."""
    rank = block.ranks()[suffixes.order]
    least = least_of_groups(suffixes.first, rank)
    later = np.zeros(len(block.text), bool)
    later[suffixes.order] = least[suffixes.groups()] < rank
    starts = block.starts(window)
    return starts[later[starts]]


def streamed_windows(index: FmIndex, indexed: Block, block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics of a block that is not in the index: where its windows are that the index holds at an
    earlier place, and where those that it lacks."""
    lengths, lows = index.matching_statistics(block.text, block.begins, block.ends)
    starts = block.starts(window)
    full = lengths[starts] >= window
    met = starts[full]
    first = index.first_place(lows[met]).astype(np.int64)
    return met[_before(indexed.positions(first), block.positions(met))], starts[~full]


def leaders_first(m: np.ndarray) -> tuple[np.ndarray, int]:
    """The order that puts the first segment of each minimizer ahead of all others, and how many these are."""
    lead = np.concatenate([[True], m[1:] != m[:-1]])
    return np.argsort(~lead, kind="stable"), int(lead.sum())


def removed_windows(block: Block, leading: int, window: int = WINDOW) -> np.ndarray:
    """Where the windows of whole minimizers are that also start earlier (places in the block's text). The first `leading`
    segments are the leaders; words are numbered in order of first use, so the index knows the least numbers only."""
    gone = []
    leaders, others = np.arange(leading), np.arange(leading, len(block.m))
    indexed = block.take(leaders)
    suffixes = Suffixes(indexed.text, window)
    own = _repeated(indexed, suffixes, window)
    gone.append(block.begins[leaders][indexed.owner(own)] + own - indexed.begins[indexed.owner(own)])
    if len(others):
        index = FmIndex(indexed.text, window, indexed.ranks(), suffixes)
        rest = block.take(others)
        back = lambda b, at: block.begins[others][b.owner(at)] + at - b.begins[b.owner(at)]
        earlier, new = streamed_windows(index, indexed, rest, window)
        gone.append(back(rest, earlier))
        if len(new):
            cut = np.flatnonzero((np.diff(new) != 1) | (np.diff(rest.owner(new)) != 0))
            first, last = new[np.concatenate([[0], cut + 1])], new[np.concatenate([cut, [len(new) - 1]])]
            rows = rest.owner(first)
            left = rest.take(rows, first, last + window)
            again = _repeated(left, Suffixes(left.text, window), window)
            o = left.owner(again)
            gone.append(back(rest, first[o] + again - left.begins[o]))
    return np.concatenate(gone)


def block_of(m: np.ndarray, key: np.ndarray, mark: np.ndarray, a: np.ndarray, content: pa.Array) -> Block:
    """Segments as a block; words are numbered in order of first use."""
    codes, counts, _ = words_of(content)
    ends = np.cumsum(counts + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    text[np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)] = codes.astype(np.int64) + 1
    return Block(text, ends - counts, ends, m, key, mark, a)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in tables of whole minimizers of about `most` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        m = batch.column(0).to_numpy()
        start = 0
        if size > most and held:
            last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
            start = int(np.argmax(m != last)) if (m != last).any() else len(m)
            if start < len(m):
                yield pa.Table.from_batches([*held, batch.slice(0, start)])
                held, size = [], 0
            else:
                start = 0
        upto = np.cumsum(np.diff(np.frombuffer(batch.column(4).buffers()[1], np.int32)[batch.column(4).offset : batch.column(4).offset + batch.num_rows + 1]))
        news = np.flatnonzero(m[1:] != m[:-1]) + 1
        while True:
            before = int(upto[start - 1]) if start else 0
            k = int(np.searchsorted(upto, before + max(0, most - size)))
            cut = news[np.searchsorted(news, max(k, start), "right") :][:1]
            if k >= batch.num_rows or not len(cut):
                break
            yield pa.Table.from_batches([*held, batch.slice(start, int(cut[0]) - start)])
            held, size, start = [], 0, int(cut[0])
        held.append(batch.slice(start))
        size += int(upto[-1]) - (int(upto[start - 1]) if start else 0)
    if held:
        yield pa.Table.from_batches(held)


def _ranges(segments_: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, mark, f, t): the ranges of words to remove, from each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, block_bytes):
            order, leading = leaders_first(table.column(0).to_numpy())
            table = table.take(pa.array(order)).combine_chunks()
            m, key, mark, a = (table.column(i).to_numpy().astype(np.int64) for i in range(4))
            block = block_of(m, key, mark, a, table.column(4).chunk(0))
            gone = np.sort(removed_windows(block, leading, window))
            cut = np.flatnonzero((np.diff(gone) != 1) | (np.diff(block.owner(gone)) != 0))
            first, last = (gone[np.concatenate([[0], cut + 1])], gone[np.concatenate([cut, [len(gone) - 1]])]) if len(gone) else (gone, gone)
            o = block.owner(first)
            out = [(key[o], mark[o], a[o] + first - block.begins[o], a[o] + last - block.begins[o] + window)]
            # A later place of the same segment: all its windows stand at the first place.
            listed = table.column(5).chunk(0)
            flat, own = listed.flatten(), np.repeat(np.arange(table.num_rows), listed.value_lengths().to_numpy())
            k, r, w = (flat.field(f).to_numpy().astype(np.int64) for f in ("key", "mark", "a"))
            later = np.flatnonzero(_before((key[own], mark[own], a[own]), (k, r, w)))
            words = block.ends - block.begins
            out.append((k[later], r[later], w[later], w[later] + words[own[later]]))
            k, r, f, t = (np.concatenate(x) for x in zip(*out))
            for i in range(0, len(k), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(r[part]), pa.array(f[part].astype(np.int32)), pa.array(t[part].astype(np.int32))], ["key", "mark", "f", "t"])

    ship(segments_.sparkSession)
    n = max(8, int(segments_.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = segments_.repartition(n, "m").sortWithinPartitions("m", "key", "mark", "a")
    return dealt.mapInArrow(trimmed(run), "key long, mark long, f int, t int")


def matching_intervals(docs: DataFrame, against: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """(id, f, t): the intervals of words of each document, as long as they go, all of whose runs of `window` words stand
    somewhere in `against`. The shards of `against` are indexed, the documents are streamed through them. Rows that repeat
    an id are told apart by their text and report each its own; documents without a match report nothing."""
    ship(docs.sparkSession)
    sides = [_keyed(df, id_col, text_col, []) for df in (against, docs)]
    met = [_occurrences(side, window) for side in sides]
    # Minimizers of both sides; those of very many windows are dealt window by window.
    sizes = [df.groupBy("m").agg(F.sum("c").alias(f"n{i}")) for i, df in enumerate(met)]
    both = written(sizes[0].join(sizes[1], "m").select("m", (F.col("n0") + F.col("n1") > hot).alias("hot")), "interval-minimizers")
    rows = []
    for i, side in enumerate(sides):
        shared = met[i].join(both.hint("merge"), "m")
        segs = written(shared.groupBy("key", "mark").agg(F.collect_set(F.struct("a", "c", "m", "hot")).alias("segs")), "interval-segments")
        rows.append(_cut(side.join(segs.hint("merge"), ["key", "mark"]), window).withColumn("streamed", F.lit(i == 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, block_bytes):
            table = table.combine_chunks()
            streamed = table.column("streamed").to_numpy().astype(bool)
            own = [table.column(i).to_numpy().astype(np.int64) for i in range(4)]
            # The indexed rows first.
            order = np.argsort(streamed, kind="stable")
            block = block_of(streamed[order].astype(np.int64), own[1][order], own[2][order], own[3][order], table.column(4).chunk(0).take(pa.array(order)))
            held, asked = np.flatnonzero(~streamed[order]), np.flatnonzero(streamed[order])
            if not len(held) or not len(asked):
                continue
            rest = block.take(asked)
            index = FmIndex(block.take(held).text, window)
            lengths, _ = index.matching_statistics(rest.text, rest.begins, rest.ends)
            full = np.flatnonzero(lengths >= window)
            if not len(full):
                continue
            cut = np.flatnonzero((np.diff(full) != 1) | (np.diff(rest.owner(full)) != 0))
            first, last = full[np.concatenate([[0], cut + 1])], full[np.concatenate([cut, [len(full) - 1]])]
            row = rest.owner(first)
            f, t = first - rest.begins[row], last - rest.begins[row] + window
            places = table.column(5).chunk(0).take(pa.array(order[asked[row]]))  # equal segments of a task: one match, many places
            many, flat = np.repeat(np.arange(len(row)), places.value_lengths().to_numpy()), places.flatten()
            a = flat.field("a").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("mark"), pa.array((a + f[many]).astype(np.int32)), pa.array((a + t[many]).astype(np.int32))], ["key", "mark", "f", "t"])

    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows[0].unionByName(rows[1]).repartition(n, "m").sortWithinPartitions("m", "streamed", "key", "mark", "a")
    found = dealt.mapInArrow(trimmed(run), "key long, mark long, f int, t int").groupBy("key", "mark").agg(F.sort_array(F.collect_set(F.struct("f", "t"))).alias("r"))
    # Intervals of neighbouring segments overlap by window - 1 words: where the next one starts no later than a window would, they are one.
    step = lambda done, r: F.when((F.size(done) > 0) & (r["f"] <= F.element_at(done, -1)["t"] - (window - 1)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["f"].alias("f"), F.greatest(F.element_at(done, -1)["t"], r["t"]).alias("t"))))).otherwise(F.concat(done, F.array(r)))
    joined = F.aggregate("r", F.expr("CAST(array() AS array<struct<f: int, t: int>>)"), step)
    return found.select(F.when(F.col("key") != LEAST_ID, F.col("key")).alias(id_col), F.inline(joined))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT, keep: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256; with keep also the kept text, null where nothing went, and the
    removed word ranges. carry: columns of docs to return as fields of `rest`, and the text with them."""
    ship(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col, list(carry))
    found = candidates(keyed, window, hot)
    joined = keyed.join(found.hint("merge"), ["key", "mark"])
    ranges = _ranges(_cut(joined, window), window)
    runs = ranges.groupBy("key", "mark").agg(F.collect_set(F.struct("f", "t")).alias("gone"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<struct<f: int, t: int>>" * keep

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, gone, sha, texts, ranges = [], [], [], [], []
        for text, runs_ in zip(batch.column(1), batch.column(2).to_pylist()):
            joint, ends = single_spaced(text.as_buffer().to_pybytes())
            n.append(len(ends))
            lost = 0
            if runs_:
                edge = np.zeros(len(ends) + 1, np.int64)
                for r in runs_:
                    edge[r["f"]] += 1
                    edge[r["t"]] -= 1
                stays = np.cumsum(edge)[:-1] == 0
                lost = len(ends) - int(stays.sum())
                joint = joint[np.repeat(stays, np.diff(ends, prepend=-1))]
            gone.append(lost)
            kept = joint[:-1].tobytes()
            sha.append(hashlib.sha256(kept).hexdigest())
            if keep:
                texts.append(kept.decode() if lost else None)
                ranges.append(runs_ or [])
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)]
        if keep:
            cols += [pa.array(texts, pa.string()), pa.array(ranges, pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())])))]
        if carry:
            cols += [batch.column(3), batch.column(1)]
        yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept", "removed"] * keep
    final = keyed.join(runs.hint("merge"), ["key", "mark"], "left")
    final = final.select(F.when(F.col("key") != LEAST_ID, F.col("key")).alias("doc_id"), "text", "gone", "rest")
    if carry:
        rest = final.schema["rest"].dataType.simpleString()
        names += ["rest", "text"]
        schema += f", rest {rest}, text binary"
    return by_chunk(final, run, schema).withColumnRenamed("doc_id", id_col)
