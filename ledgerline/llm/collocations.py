"""Phrases that stick together, per language, by hierarchical pair naming.

Texts in lower case (A-Z) are split at .,;:!? and line breaks into pieces, and pieces into words. A
word of `least` occurrences or more gets a global id. A phrase of k words is the pair of two phrases
of k-1 words that overlap, its first and its last ones; where both have ids, so does the place, and
the pair is counted. Pairs of `least` occurrences get ids in turn: a phrase below that cannot be
part of one above it. A pair's two ids are its parent pointers: a chain of first parents gives the
counts of all its beginnings, a chain of last parents those of all its ends, which is what scoring
the cuts needs; and a phrase is subsumed if a pair that has it as a parent is as frequent (if a
longer candidate is, so is every phrase between them).

Texts are read once. A task keeps a chunk's words as numbers of its own in a table, which never moves; what moves is its
distinct names with their counts, packed by buckets of names. A bucket sums the counts of all chunks, gives
ids to the frequent names and answers each chunk; answers are noted beside the chunks (a file a chunk). Most pairs are rare,
so a pair is handed on only if its slot, a hash of its ids, is met `least` times in all chunks together: slots are counted
the same way, as gaps and counts of a few bytes a pair, and there are as many as an eighth of the words. A frequent pair's
slot always is; a rare pair that shares such a slot falls to the exact count. So a group holds what chunks say of
one bucket or range of slots, a frequent name is one entry a chunk, and buckets follow spark.sql.shuffle.partitions.
Counts and products are exact: products are decimals of 38 digits.

Edge cases: null and blank texts have no words; null languages count as `und`; words of any length
and phrases over very long texts are whole; rows count each, whatever their ids; other columns are
ignored; an empty table, or one without frequent words, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import join_skewed, remove, scratch, shared_dir, ship, trimmed, utf8, written
from ledgerline.llm.files import new_file, open_file
from ledgerline.llm.fingerprints import _mix
from ledgerline.llm.substrings import word_hashes
from ledgerline.llm.words import LOWER, _named, flat

#: Where pieces end (.,;:!? and x0A to x0D), and what stands between words (space and tab).
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(10, 14)]] = True
BETWEEN = np.zeros(256, bool)
BETWEEN[[32, 9]] = True
#: A chunk holds this many words at least, if a task has them.
CHUNK_WORDS = 1_500_000
#: Slots in a range, and words for each slot.
RANGE_BITS, LOAD = 20, 8
#: Of a phrase of count a in a language of `words` words, at the cut after its first i + 1 words; heads[i] and tails[i] are
#: the counts of its first and its last i + 1 words. Exact up to 38 digits.
SCORE = """CAST(CAST(1000 * CAST(a AS DECIMAL(19)) AS DECIMAL(22)) * CAST(words AS DECIMAL(16)) AS DECIMAL(38))
    DIV CAST(CAST(heads[i] AS DECIMAL(19)) * CAST(tails[size(tails) - 1 - i] AS DECIMAL(19)) AS DECIMAL(38))"""
ROWS = "chunk long, lang string, seq binary, bucket int, words array<string>, first array<bigint>, last array<bigint>, code array<int>, n array<bigint>"
KINDS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("seq", pa.binary()), ("bucket", pa.int32()), ("words", pa.list_(pa.string())), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("code", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
ANSWERS = "chunk long, code array<int>, ids array<bigint>, id long, lang string, phrase string, first long, last long, a long"


def rows_of(size: int, /, **columns) -> pa.RecordBatch:
    """A batch of ROWS; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in KINDS], schema=KINDS)


def packed(bucket: np.ndarray, *columns) -> tuple[list[int], list[list]]:
    """The buckets that are met, and each column's values bucket by bucket."""
    order = np.argsort(bucket, kind="stable")
    met, first = np.unique(bucket[order], return_index=True)
    return met.tolist(), [[part.tolist() for part in np.split(c[order], first[1:])] for c in columns]


def buckets_of(docs: DataFrame) -> int:
    return max(32, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def words_and_ends(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The numbers of the words of all texts, with -1 where a piece or a text ends; and the distinct words."""
    blob, offsets = flat(column)
    low = np.frombuffer(blob.translate(LOWER), np.uint8)
    apart = ENDS[low]
    here = ~(apart | BETWEEN[low])
    edge = np.zeros(len(low) + 1, bool)  # a text starts or ends here
    edge[offsets] = True
    first, last = here.copy(), here.copy()
    first[1:] &= ~here[:-1] | edge[1:-1]
    last[:-1] &= ~here[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    codes, names = _named(low[here], np.concatenate([[0], np.cumsum(stops - starts)]))
    cuts = np.unique(np.searchsorted(starts, np.concatenate([np.flatnonzero(apart), offsets])))
    return np.insert(codes.astype(np.int32), cuts, -1), names


class Held:
    """The words of one language that a task has met since its last chunk."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, column: pa.Array) -> None:
        codes, names = words_and_ends(column)
        number = self.number
        own = np.fromiter((number.setdefault(name, len(number)) for name in names), np.int32, len(names))
        self.parts.append(np.where(codes < 0, -1, own[codes]) if len(own) else codes)
        self.size += len(codes)

    def rows(self, chunk: int, lang: str, buckets: int) -> Iterator[pa.RecordBatch]:
        seq = np.concatenate(self.parts).astype(np.int32)
        yield rows_of(1, chunk=[chunk], lang=[lang], seq=[seq.tobytes()])
        names = list(self.number)
        if names:
            text = np.array([w.decode() for w in names], object)
            met, (words, code, n) = packed((word_hashes(names) % np.uint64(buckets)).astype(np.int64), text, np.arange(len(names)), np.bincount(seq[seq >= 0], minlength=len(names)))
            yield rows_of(len(met), chunk=[chunk] * len(met), lang=[lang] * len(met), bucket=met, words=words, code=code, n=n)


def chunks_of_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = CHUNK_WORDS) -> DataFrame:
    """A table of chunks of one language: a row with its words as numbers, and rows with its distinct words by bucket."""
    ship(docs.sparkSession)
    buckets = buckets_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Held] = {}
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            of = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                held.setdefault(lang, Held()).add(batch.column(1).take(pa.array(np.flatnonzero(of == k))))
            if sum(h.size + 8 * len(h.number) for h in held.values()) >= most:
                for lang, h in held.items():
                    yield from h.rows(chunk, lang, buckets)
                    chunk += 1
                held = {}
        for lang, h in held.items():
            yield from h.rows(chunk, lang, buckets)
            chunk += 1

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    return written(docs.select(lang, utf8(text_col).alias("text")).mapInArrow(trimmed(run), ROWS), "word-chunks")


def squeezed(seq: np.ndarray) -> np.ndarray:
    """Without repeated -1, and without names that stand alone between two of them."""
    named = seq >= 0
    beside = np.zeros(len(seq), bool)
    beside[1:] |= named[:-1]
    beside[:-1] |= named[1:]
    seq = np.where(named & beside, seq, -1)
    stays = seq >= 0
    stays[1:] |= seq[:-1] >= 0
    return seq[stays]


def noted(answers: DataFrame, chunks: DataFrame, label: str) -> str:
    """The folder of a file a chunk with what was answered to it, for every chunk."""
    folder = shared_dir(chunks.sparkSession, label)

    def note(key, table):
        with new_file(f"{folder}/{key[0].as_py()}.arrow") as out, pa.ipc.new_file(out, table.schema) as to:
            to.write_table(table)
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    every = answers.unionByName(chunks.where("seq IS NOT NULL").select("chunk"), allowMissingColumns=True)
    every.groupBy("chunk").applyInArrow(note, "n long").agg(F.sum("n")).collect()  # one row
    return folder


def note_of(folder: str, chunk: int) -> pa.Table:
    with open_file(f"{folder}/{chunk}.arrow") as f:
        return pa.ipc.open_file(f.read()).read_all()


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def named(table: DataFrame, least: int, of_words: bool, label: str) -> DataFrame:
    """Answers to the chunks (code, ids: which of its names are frequent), and the frequent names (id, ..., a)."""
    kinds = pa.schema([("chunk", pa.int64()), ("code", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("id", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("a", pa.int64())])

    def run(key, rows):
        sizes = rows["code"].combine_chunks().value_lengths().to_numpy()
        own = np.repeat(np.arange(rows.num_rows), sizes)
        code, n = _flat(rows, "code"), _flat(rows, "n")
        if of_words:
            keys = pc.binary_join_element_wise(rows["lang"].combine_chunks().take(pa.array(own)), rows["words"].combine_chunks().flatten(), "\n").dictionary_encode()  # no word holds a line feed
            number, listed = keys.indices.to_numpy(), keys.dictionary
        else:
            first, last = _flat(rows, "first"), _flat(rows, "last")
            f, f_at = np.unique(first, return_inverse=True)
            g, g_at = np.unique(last, return_inverse=True)
            listed, number = np.unique(f_at * len(g) + g_at, return_inverse=True)
        total = np.zeros(len(listed), np.int64)
        np.add.at(total, number, n)
        kept = np.flatnonzero(total >= least)
        ids = np.full(len(listed), -1, np.int64)
        ids[kept] = (key[0].as_py() << 40) + np.arange(len(kept))
        found = np.flatnonzero(ids[number] >= 0)
        ends = np.concatenate([[0], np.cumsum(np.bincount(own[found], minlength=rows.num_rows))]).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
        k, m = rows.num_rows, len(kept)
        chunk, codes, answered = rows["chunk"].combine_chunks(), lists(code[found].astype(np.int32)), lists(ids[number[found]])
        if of_words:
            text = [t.rpartition("\n") for t in listed.take(pa.array(kept)).to_pylist()]
            name = [pa.array([t[0] for t in text], pa.string()), pa.array([t[2] for t in text], pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())]
        else:
            name = [pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.array(f[listed[kept] // len(g)]), pa.array(g[listed[kept] % len(g)])]
        answers = [chunk, codes, answered, *(pa.nulls(k, t.type) for t in list(kinds)[3:])]
        names = [pa.nulls(m, t.type) for t in list(kinds)[:3]] + [pa.array(ids[kept]), *name, pa.array(total[kept])]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(answers, schema=kinds), pa.RecordBatch.from_arrays(names, schema=kinds)])

    return written(table.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(run, ANSWERS), label)


class Pairs:
    """The adjacent pairs of a chunk's named places."""

    def __init__(self, seq: bytes, note: pa.Table, slots: int):
        code, ids = _flat(note, "code"), _flat(note, "ids")
        seq = np.frombuffer(seq, np.int32)
        own = np.full(max(int(seq.max(initial=-1)), int(code.max(initial=-1))) + 2, -1, np.int32)  # the last one for -1
        own[code] = np.arange(len(code), dtype=np.int32)
        seq = squeezed(own[seq])
        self.both = (seq[:-1] >= 0) & (seq[1:] >= 0)
        names, self.number, self.times = np.unique(seq[:-1][self.both].astype(np.int64) * max(1, len(ids)) + seq[1:][self.both], return_inverse=True, return_counts=True)
        self.first, self.last = (ids[names // len(ids)], ids[names % len(ids)]) if len(names) else (ids[:0], ids[:0])
        with np.errstate(over="ignore"):
            self.hash = _mix(_mix(self.first.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + self.last.astype(np.uint64))
        self.slots, self.of_slot = np.unique(self.hash & np.uint64(slots - 1), return_inverse=True)

    def ranges(self) -> list[tuple[int, int, int]]:
        """(range, from, to) of the slots that are met."""
        of = (self.slots >> np.uint64(RANGE_BITS)).astype(np.int64)
        met, first = np.unique(of, return_index=True)
        return list(zip(met.tolist(), first.tolist(), [*first[1:].tolist(), len(of)]))


def possible(chunks: DataFrame, notes: str, slots: int, least: int) -> DataFrame:
    """(chunk, range, bits): which of a chunk's slots are met `least` times in all chunks."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs = Pairs(seq.as_py(), note_of(notes, chunk), slots)
                times = np.zeros(len(pairs.slots), np.int64)
                np.add.at(times, pairs.of_slot, pairs.times)
                out = []
                for r, a, b in pairs.ranges():
                    gaps = np.diff(pairs.slots[a:b].astype(np.int64) - (r << RANGE_BITS), prepend=0)
                    out.append((r, gaps.astype(np.uint16 if gaps.max() < 1 << 16 else np.uint32).tobytes(), np.minimum(times[a:b], least).astype(kind).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out)), *(pa.array(c) for c in zip(*out))], ["chunk", "range", "gaps", "times"])

    def add(key, rows):
        total = np.zeros(1 << RANGE_BITS, np.int64)
        at, times = [], []
        for gaps, n in zip(rows["gaps"].to_pylist(), rows["times"].to_pylist()):
            times.append(np.frombuffer(n, kind))
            at.append(np.cumsum(np.frombuffer(gaps, np.uint16 if len(gaps) == 2 * len(times[-1]) else np.uint32), dtype=np.int64).astype(np.int32))
            total[at[-1]] += times[-1]
        return pa.table({"chunk": rows["chunk"], "range": rows["range"], "bits": pa.array([np.packbits(total[x] >= least).tobytes() for x in at], pa.binary())})

    counted = chunks.where("seq IS NOT NULL").select("chunk", "seq").mapInArrow(trimmed(run), "chunk long, range long, gaps binary, times binary")
    return counted.groupBy("range").applyInArrow(add, "chunk long, range long, bits binary")


def pairs_of(chunks: DataFrame, notes: str, answers: str, slots: int, label: str, path: str) -> DataFrame:
    """The table of the next length: each chunk's places by number, and its possible pairs by bucket."""
    buckets = buckets_of(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs = Pairs(seq.as_py(), note_of(notes, chunk), slots)
                note = note_of(answers, chunk)
                bits = dict(zip(note["range"].to_pylist(), note["bits"].to_pylist()))
                stays = np.zeros(len(pairs.slots), bool)
                for r, a, b in pairs.ranges():
                    stays[a:b] = np.unpackbits(np.frombuffer(bits[r], np.uint8), count=b - a)
                kept = stays[pairs.of_slot]
                if not kept.any():
                    continue
                code = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)
                out = np.full(len(pairs.both), -1, np.int32)
                out[pairs.both] = code[pairs.number]
                yield rows_of(1, chunk=[chunk], seq=[squeezed(out).tobytes()])
                met, (first, last, codes, n) = packed((pairs.hash[kept] % np.uint64(buckets)).astype(np.int64), pairs.first[kept], pairs.last[kept], code[kept], pairs.times[kept])
                yield rows_of(len(met), chunk=[chunk] * len(met), bucket=met, first=first, last=last, code=codes, n=n)

    return written(chunks.where("seq IS NOT NULL").select("chunk", "seq").mapInArrow(trimmed(run), ROWS), label, path)


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang", most: int = CHUNK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of each length: id, lang, phrase, a (count), first and last (ids of its parents),
    heads and tails (counts of its beginnings and ends of 1, 2, ... words); and the words of each language."""
    spark = docs.sparkSession
    chunks = chunks_of_words(docs, text_col, lang_col, most)
    totals = written(chunks.where("bucket IS NOT NULL").groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words")), "lang-words")
    words = totals.agg(F.sum("words")).first()[0] or 0
    slots = 1 << max(16, (words // LOAD).bit_length())
    none = F.array().cast("array<bigint>")
    levels, before = [], None
    for k in range(1, longest + 1):
        found = named(chunks, least, k == 1, f"names-{k}")
        own = found.where("id IS NOT NULL")
        if k == 1:
            levels.append(own.select("id", "lang", "phrase", "a", "first", "last", none.alias("heads"), none.alias("tails")))
        else:
            up = levels[-1]
            first = up.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("front"), F.array_append("heads", F.col("a")).alias("heads"))
            last = up.select(F.col("id").alias("last"), F.substring_index("phrase", " ", -1).alias("word"), F.array_append("tails", F.col("a")).alias("tails"))
            level = own.select("id", "a", "first", "last").join(first, "first").join(last, "last").select("id", "lang", F.concat_ws(" ", "front", "word").alias("phrase"), "a", "first", "last", "heads", "tails")
            levels.append(written(level, f"phrases-{k}"))
        if k == longest or levels[-1].isEmpty():
            break
        with scratch(spark) as stay:
            notes = noted(found.where("id IS NULL").select("chunk", "code", "ids"), chunks, "names-of-chunks")
            bits = noted(possible(chunks, notes, slots, least), chunks, "slots-of-chunks")
            path = shared_dir(spark, f"pair-chunks-{k + 1}")
            stay.append(path)
            chunks = pairs_of(chunks, notes, bits, slots, f"pair-chunks-{k + 1}", path)
        if before:
            remove(spark, [before])
        before = path
    return levels, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang", most: int = CHUNK_WORDS) -> DataFrame:
    """Per language the first `top` phrases: lang, rank, phrase, a, l, r, n, score (a thousand times how much likelier the
    phrase is than its two parts side by side, at the cut where that is least)."""
    levels, totals = phrases(docs, least, longest, text_col, lang_col, most)
    if len(levels) == 1:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    kept = None
    for k in range(1, len(levels)):
        own = levels[k].select("id", "lang", "phrase", "a", "heads", "tails")
        if k + 1 < len(levels):
            longer = levels[k + 1]
            over = longer.select(F.col("first").alias("id"), F.col("a").alias("b")).union(longer.select(F.col("last").alias("id"), F.col("a").alias("b"))).groupBy("id").agg(F.max("b").alias("b"))
            own = own.join(over, "id", "left").where("b IS NULL OR b < a").drop("b")
        kept = own.drop("id") if kept is None else kept.unionByName(own.drop("id"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("__phrases")).join(totals, "lang")
    scored = join_skewed(kept, written(sizes, "lang-phrases"), "lang", "__phrases")
    cut = F.expr(f"array_min(transform(sequence(0, size(heads) - 1), i -> named_struct('score', {SCORE}, 'i', i)))")
    rows = scored.withColumn("cut", cut).select("lang", "phrase", "a", F.expr("heads[cut.i]").alias("l"), F.expr("tails[size(tails) - 1 - cut.i]").alias("r"), F.col("words").alias("n"), "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", place).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
