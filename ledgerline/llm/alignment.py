"""Alignment of two tokenizers over the same bytes: minimal groups of tokens, links, and corpus counts of linked ids.

A text is encoded by both tokenizers. Tokens of the one and the other that share a byte are joined by
an edge of a bipartite graph; union-find over the edges gives its components, which are the minimal
groups: the byte ranges between offsets where tokens of both end. Inside a component, tokens whose
byte ranges end together are linked.

A task numbers the distinct pairs of linked ids of a chunk of documents and keeps each document's
links as those numbers. Only the pairs, with their counts in the chunk, are shuffled: their corpus
counts are summed with partial aggregation, and go back to the chunks, one row a pair and chunk
however often it stands there. A pair's rank among those of its second id follows from the
counts, of which there are at most as many as pairs of ids.

Texts are taken as one space and the text, for a vocabulary whose pieces start with a space; special
tokens in texts are plain text. Texts of over a mebibyte are cut at single spaces between words,
where both tokenizers start a piece anyway, so memory follows the longest run without such a place.

Edge cases: null and empty texts, and texts that one of the tokenizers does not give back byte by
byte (a text that holds U+2581, for one), have no tokens: zeros, and '' for the groups; repeated
rows are counted each; null ids are kept; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ship, sliced, trimmed, utf8, written
from ledgerline.llm.units import LibraryUnits, UnitEncoder, byte_alphabet
from ledgerline.llm.words import Words, _named, flat, pieces_of

LONG = 1 << 20


def gathered(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of blob one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return blob[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Tokens(NamedTuple):
    """A tokenizer: its encoder, the bytes of each id, and each id in decimal with room for one more sign."""

    encoder: UnitEncoder
    blob: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    digits: np.ndarray
    digit_starts: np.ndarray
    digit_lengths: np.ndarray

    @classmethod
    def of(cls, encoder: UnitEncoder, names: list[bytes]) -> Tokens:
        lengths = np.array([*map(len, names)], np.int64)
        signs = [b"%d," % i for i in range(len(names))]
        wide = np.array([*map(len, signs)], np.int64)
        raw = lambda parts: np.frombuffer(b"".join(parts), np.uint8)
        return cls(encoder, raw(names), np.cumsum(lengths) - lengths, lengths, raw(signs), np.cumsum(wide) - wide, wide)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.encoder.encode(texts)
        return ids.astype(np.int64), counts


class PieceUnits:
    """Ids of parts of a text by a SentencePiece file. A text is cut between characters that no piece holds side by side:
    merges never reach across. Parts are encoded in one call, with line feeds between them, which no piece holds."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        own = self.library
        side = np.zeros((256, 256), bool)  # last byte of a character, first byte of the next
        for i in ids:
            if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i)):
                chars = [c.encode() for c in own.id_to_piece(i).replace("▁", " ")]
                for a, b in zip(chars, chars[1:]):
                    side[a[-1], b[0]] = True
        if side[10].any() or side[:, 10].any() or own.encode("\n") != [own.piece_to_id("▁"), own.piece_to_id("<0x0A>")]:
            raise ValueError(f"{path} has pieces with line feeds, or another treatment of white space")
        self.feed = own.piece_to_id("<0x0A>")
        self.apart = ~side
        self.apart[:, 0x80:0xC0] = False  # inside a character

    def cut(self, column: pa.Array) -> Words:
        blob, offsets = flat(column)
        data = np.frombuffer(blob, np.uint8)
        if not len(data):
            return Words(np.empty(0, np.int32), np.zeros(len(column), np.int64), [])
        first = np.empty(len(data), bool)
        first[1:] = self.apart[data[:-1], data[1:]]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        codes, names = _named(data, np.append(starts, len(data)))
        return Words(codes, np.diff(np.searchsorted(starts, offsets)), names)

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flats, counts, at = [], [], 0
        while at < len(units):
            size, upto = 0, at
            while upto < len(units) and (upto == at or size < 1 << 16):
                size += len(units[upto])
                upto += 1
            part = units[at:upto]
            # A line feed as a unit leaves two between its neighbours' own: it is put aside here.
            ids = np.array(self.library.encode(b"\n".join([b"", *(b"" if u == b"\n" else u for u in part)]).decode()), np.int64)
            marks = np.append(np.flatnonzero(ids == self.feed), len(ids))
            n = np.diff(marks) - 1
            own = ids[marks[0] :]
            own = own[own != self.feed]
            feeds = np.array([u == b"\n" for u in part])
            if feeds.any():
                place = (np.cumsum(n) - n)[feeds]
                own, n = np.insert(own, place, self.feed), n + feeds
            flats.append(own)
            counts.append(n)
            at = upto
        return np.concatenate(flats or [np.empty(0, np.int64)]).astype(np.uint32), np.concatenate(counts or [np.empty(0, np.int64)])


_sides: dict[str, Tokens] = {}


def byte_level(path: str) -> Tokens:
    """A byte-level file of the tokenizers library."""
    if path not in _sides:
        units = LibraryUnits(path, "spaced", plain=True)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        names = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            names[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        _sides[path] = Tokens.of(UnitEncoder(lambda texts: pieces_of(texts, True), units), names)
    return _sides[path]


def pieces(path: str) -> Tokens:
    """A SentencePiece file whose pieces start with U+2581 for a space."""
    if path not in _sides:
        units = PieceUnits(path)
        own = units.library
        names = [bytes([int(own.id_to_piece(i)[3:-1], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]
        _sides[path] = Tokens.of(UnitEncoder(units.cut, units), names)
    return _sides[path]


def components(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """The least node of each node's component: union-find over all edges (u, v) at once, larger roots under smaller ones."""
    parent = np.arange(nodes)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        parent[np.maximum(a, b)] = np.minimum(a, b)  # of several, one wins; the others come again
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent


class Aligned(NamedTuple):
    """Of a run of texts: ends of the tokens of both (bytes from the first text's start), the group of each, and the links."""

    ends_a: np.ndarray
    ends_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Aligned:
    """Both tokenisations cover the same bytes."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    n = len(ends_a)
    # Every byte range between neighbouring ends lies in one token of each side: that is an edge.
    cuts = np.union1d(ends_a, ends_b)
    u, v = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    # Nodes are numbered by where they start, so that the least node of a component is its first.
    order = np.argsort(np.concatenate([ends_a - lengths_a, ends_b - lengths_b]), kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    root = components(number[u], number[n + v], len(order))
    group = np.cumsum(root == np.arange(len(order))) - 1  # by root; roots come in order of bytes
    group = group[root]
    group_a, group_b = group[number[:n]], group[number[n:]]
    # A component's members are linked where they end together.
    at = np.searchsorted(ends_b, ends_a)
    link_a = np.flatnonzero(ends_b[at] == ends_a) if n else np.empty(0, np.int64)
    link_b = at[link_a]
    assert np.array_equal(group_a[link_a], group_b[link_b])
    return Aligned(ends_a, ends_b, group_a, group_b, link_a, link_b)


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All groups as `a1,a2|b1;`, and the end of each group in these bytes."""
    n = int(found.group_a[-1]) + 1 if len(ids_a) else 0
    in_a, in_b = np.bincount(found.group_a, minlength=n), np.bincount(found.group_b, minlength=n)
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    place_a, place_b = np.arange(len(ids_a)) + (upto_b - in_b)[found.group_a], np.arange(len(ids_b)) + upto_a[found.group_b]
    starts, lengths = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.int64)
    base = len(a.digits)
    starts[place_a], starts[place_b] = a.digit_starts[ids_a], b.digit_starts[ids_b] + base
    lengths[place_a], lengths[place_b] = a.digit_lengths[ids_a], b.digit_lengths[ids_b]
    out = gathered(np.concatenate([a.digits, b.digits]), starts, lengths)
    ends = np.cumsum(lengths)
    out[ends[place_a[upto_a - 1]] - 1] = ord("|")
    closing = ends[place_b[upto_b - 1]]
    out[closing - 1] = ord(";")
    return out, closing


def segments(texts: pa.Array, most: int = LONG) -> tuple[pa.Array, np.ndarray]:
    """Each text after one space; texts of over `most` bytes in several rows, cut before a single space between two
    characters of ASCII. Null and empty texts have no row. With the row of each segment."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    rows = np.flatnonzero(sizes)
    if not len(rows) or sizes.max() <= most:
        return pc.binary_join_element_wise(pa.scalar(b" "), texts.take(pa.array(rows)), pa.scalar(b"")), rows
    out, row = [], []
    for i in rows.tolist():
        text = b" " + texts[i].as_py()
        a = 0
        if len(text) > most:
            data = np.frombuffer(text, np.uint8)
            seen = (data > 32) & (data < 127)
            places = np.flatnonzero((data[1:-1] == 32) & seen[:-2] & seen[2:]) + 1
            while len(text) - a > most:
                k = np.searchsorted(places, a + most)
                if k == len(places):
                    break
                out.append(text[a : places[k]])
                row.append(i)
                a = int(places[k])
        out.append(text[a:])
        row.append(i)
    return pa.array(out, pa.binary()), np.array(row)


class Rows:
    """Gathers what is known of the rows of one batch, segment by segment."""

    def __init__(self, n: int, keep: bool):
        self.sound = np.ones(n, bool)
        self.totals = np.zeros((n, 4), np.int64)  # tokens of both, groups, links
        self.hashes: dict[int, object] = {}
        self.texts: dict[int, list[bytes]] = {}
        self.pairs: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.keep = keep

    def add(self, texts: pa.Array, row: np.ndarray, a: Tokens, b: Tokens) -> None:
        blob, offsets = flat(texts)
        data = np.frombuffer(blob, np.uint8)
        sides = []
        for side in (a, b):
            ids, counts = side.encode(texts)
            lengths = side.lengths[ids]
            given = gathered(side.blob, side.starts[ids], lengths)
            sides.append((ids, counts, lengths, given))
        bad = np.zeros(len(row), bool)
        for ids, counts, lengths, given in sides:
            if not np.array_equal(given, data):
                edges = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
                bad |= [not np.array_equal(given[edges[i] : edges[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(len(row))]
        if bad.any():
            self.sound[row[bad]] = False
            sides = [(ids[np.repeat(~bad, counts)], counts[~bad], lengths[np.repeat(~bad, counts)], None) for ids, counts, lengths, _ in sides]
            row = row[~bad]
        if not len(row):
            return
        (ids_a, n_a, lengths_a, _), (ids_b, n_b, lengths_b, _) = sides
        found = align(lengths_a, lengths_b)
        out, closing = written_groups(ids_a, ids_b, found, a, b)
        pair = ids_a[found.link_a] << 32 | ids_b[found.link_b]
        last_a = np.cumsum(n_a)
        groups = np.concatenate([[0], found.group_a[last_a - 1] + 1])  # groups up to the end of each segment
        links = np.concatenate([[0], np.searchsorted(found.link_a, last_a)])
        ends = np.concatenate([[0], closing])[groups]
        for k, i in enumerate(row.tolist()):
            self.totals[i] += (n_a[k], n_b[k], groups[k + 1] - groups[k], links[k + 1] - links[k])
            self.pairs[i].append(pair[links[k] : links[k + 1]])
            text = out[ends[k] : ends[k + 1]].tobytes()
            if self.keep:
                self.texts.setdefault(i, []).append(text)
            known = self.hashes.get(i)
            if known is None:
                self.hashes[i] = hashlib.sha256(text[:-1])
            else:
                known.update(b";" + text[:-1])

    def batch(self, doc_id: pa.Array, chunk: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The documents, then the distinct pairs."""
        n = len(doc_id)
        self.totals[~self.sound] = 0
        pairs = [p if self.sound[i] else [] for i, p in enumerate(self.pairs)]
        flat_pairs = [x for p in pairs for x in p]
        names, codes = np.unique(np.concatenate(flat_pairs or [np.empty(0, np.int64)]), return_inverse=True)
        codes = codes.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
        ends = np.concatenate([[0], np.cumsum(self.totals[:, 3])])
        sha = [self.hashes[i].hexdigest() if i in self.hashes and self.sound[i] else "" for i in range(n)]
        groups = [b"".join(self.texts[i])[:-1].decode() if i in self.texts and self.sound[i] else "" for i in range(n)] if self.keep else [None] * n
        links = [codes[ends[i] : ends[i + 1]].tobytes() for i in range(n)]
        size = pa.array(np.full(n, codes.itemsize), pa.int64())
        columns = [pa.array(np.full(n, chunk)), doc_id, *(pa.array(x) for x in self.totals.T.copy()), pa.array(sha), pa.array(groups, pa.string()), pa.array(links, pa.binary()), size, *(pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
        k = len(names)
        times = np.bincount(codes, minlength=k).astype(np.int64)
        nulls = [pa.nulls(k, f.type) for f in schema][1:-3]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), *nulls, pa.array(np.arange(k, dtype=np.int32)), pa.array(names), pa.array(times)], schema=schema)


TOTALS = ("n_a", "n_b", "n_groups", "n_links")
SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, width long, code int, pair long, n long"
KINDS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in TOTALS), ("groups_sha256", pa.string()), ("groups", pa.string()), ("links", pa.binary()), ("width", pa.int64()), ("code", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])


def encoded(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, limit: int = 2 << 20, long: int = LONG) -> DataFrame:
    """A table of chunks: a row a document (its links by number), and a row a distinct pair of ids with its number and count."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), pieces(path_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in sliced(batch, 1, limit):
                rows = Rows(part.num_rows, keep)
                texts, row = segments(part.column(1), long)
                at = 0
                sizes = pc.binary_length(texts).to_numpy()
                while at < len(row):  # a long text's segments a few at a time
                    upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), limit)) + at)
                    rows.add(texts.slice(at, upto - at), row[at:upto], a, b)
                    at = upto
                yield from rows.batch(part.column(0), chunk, KINDS)
                chunk += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return written(rows.mapInArrow(trimmed(run), SCHEMA), "aligned")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Per pair of linked ids (pair = a << 32 | b): its count over the corpus and whether that is the highest of its b."""
    counts = written(chunks.where("code IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    best = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.select("pair", b, "count").join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, **sizes: int) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of its b), count_sum
    (counts of its links' pairs), groups_sha256; with keep also groups, the text that is hashed."""
    chunks = encoded(docs, path_a, path_b, id_col, text_col, keep, **sizes)
    own = chunks.where("code IS NOT NULL").select("chunk", "code", "pair").join(pair_counts(chunks), "pair").select(F.col("chunk").alias("in_chunk"), "code", "count", "best")
    texts = chunks.where("code IS NULL").select("chunk", "doc_id", *TOTALS, "groups_sha256", "groups", "links", "width")

    def total(docs: pa.Table, known: pa.Table) -> pa.Table:
        code = known["code"].to_numpy()
        count, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        count[code], best[code] = known["count"].to_numpy(), known["best"].to_numpy()
        n_best, count_sum = [], []
        for links, width in zip(docs["links"].to_pylist(), docs["width"].to_pylist()):
            own = np.frombuffer(links, np.uint16 if width == 2 else np.uint32)
            n_best.append(int(best[own].sum()))
            count_sum.append(int(count[own].sum()))
        done = docs.drop_columns(["chunk", "links", "width", "groups_sha256", "groups"])
        done = done.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        for c in ("groups_sha256", "groups")[: 1 + keep]:
            done = done.append_column(c, docs[c])
        return done

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * keep
    return texts.groupBy("chunk").cogroup(own.groupBy("in_chunk")).applyInArrow(total, schema).withColumnRenamed("doc_id", id_col)
