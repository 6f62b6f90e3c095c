"""Exact top-k by integer inner product: vectors by descending length, partial sums in a rotated space, and bounds.

Components become floor(256 * x). Of equal vectors only k + 1 rows can be among a query's k best (the
row itself may be one of them), so equal vectors are reduced to one with its first k + 1 rows before
anything else, and equal queries to one.

1. The Gram matrix of all vectors is summed by task and row; its singular vectors are the rotation
   that puts most of a vector's length into its first coordinates.
2. Candidates are dealt by descending length to ranges and packed into blocks. Queries get a first
   threshold, their k-th best score among the HEAD longest candidates.
3. Queries are dealt to groups by reach, the least length that a candidate needs to meet the
   threshold (by Cauchy-Schwarz, threshold / length of the query). A group visits the ranges from the
   longest on, as far as its reach goes; each (group, range) is a key, its rows are sorted with the
   queries first and then the blocks by descending length, and a task streams them.
4. Against a block, a query's partial sum over the first coordinates plus the product of the lengths
   of the two rests bounds its score from above. Pairs whose bound is below the query's threshold are
   left out, the others are scored in whole numbers, and the threshold rises.

The result is exact: a pair is left out only where its bound, with room for rounding, is below the
k-th best score of its query. Each range hands on at most k vectors a query, and keys number about
(queries x vectors) / PAIRS, or as many as keep all cores busy.

Edge cases: vectors that are null or empty, or that hold null or non-finite components (256 times a
component counts), take no part; of vectors of several sizes the shorter ones count as filled up with
zeros; a zero vector scores 0; rows that repeat an id are rows of their own, each a query for all
other rows; null ids are no queries and, as candidates, come last among ties; a score past 64 bits
counts as the largest or smallest 64-bit number; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import join_skewed, ship, trimmed, written

HEAD = 4096
#: Pairs of a query and a vector that a task meets at most, where there are enough to keep all cores busy.
PAIRS = 1 << 33
#: Components in a block of candidates, and in a group of queries.
BLOCK, GROUP = 1 << 17, 1 << 22
MOST_RANGES = 1 << 14
LONG = (1 << 63) - 1


def whole(vector: str | Column) -> Column:
    """floor(256 * x) of each component, as doubles (exact), or null where the vector takes no part."""
    scaled = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double") * 256)
    sound = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # -0.0 and 0.0 are one number, here and as a key
    return F.when(sound & (F.size(scaled) > 0), F.transform(scaled, lambda x: F.expr("0D") + F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    out = np.zeros((len(lengths), size))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scores(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (q, v) of rows."""
    if not len(q):
        return np.empty(0, np.int64)
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if most < 2.0**53:
        if len(q) * 4 > len(queries) * len(vectors):
            return (queries @ vectors.T)[q, v].astype(np.int64)
        return np.einsum("ij,ij->i", queries[q], vectors[v]).astype(np.int64)
    exact = (sum(int(a) * int(b) for a, b in zip(queries[i].tolist(), vectors[j].tolist())) for i, j in zip(q.tolist(), v.tolist()))
    return np.fromiter((min(max(x, -LONG - 1), LONG) for x in exact), np.int64, len(q))


class Best:
    """The k best vectors of each query of a group so far; thresholds rise with them."""

    def __init__(self, queries: np.ndarray, floors: np.ndarray, rotation: np.ndarray, k: int):
        self.queries, self.k, self.rotation = queries, k, rotation
        self.floors = floors.astype(np.float64)
        self.turned = queries @ rotation
        self.lengths = np.linalg.norm(queries, axis=1)
        # The first coordinates: those that hold nine tenths of the queries' squared length, half of all at most.
        share = np.cumsum((self.turned**2).sum(0))
        self.cut = int(min(np.searchsorted(share, 0.9 * share[-1]) + 1, max(1, len(share) // 2)))
        self.rest = np.linalg.norm(self.turned[:, self.cut :], axis=1)
        self.found = tuple(np.empty(0, np.int64) for _ in range(4))  # query, score, order of the id, vector
        self.met = self.scored = 0

    def meet(self, vectors: np.ndarray, lengths: np.ndarray, order: np.ndarray, number: np.ndarray) -> None:
        """A block, by descending length. order: what ties are broken by; number: the vector's own."""
        room = 1 + 1e-9
        if np.all(self.lengths * lengths[0] * room + 1 < self.floors):
            return
        turned = vectors @ self.rotation
        rest = np.linalg.norm(turned[:, self.cut :], axis=1)
        for a in range(0, len(self.queries), 1024):
            part = slice(a, a + 1024)
            size, floors = self.lengths[part], self.floors[part]
            # No shorter candidate than the reach of the part's most far-reaching query.
            reach = np.where(floors <= 0, 0, (floors - 1) / (np.maximum(size, 1e-9) * room)).min()
            upto = int(np.searchsorted(-lengths, -reach, "right"))
            if not upto:
                continue
            bound = self.turned[part, : self.cut] @ turned[:upto, : self.cut].T
            bound += np.outer(self.rest[part], rest[:upto])
            bound += np.outer(size, lengths[:upto]) * 1e-9 + 1
            q, v = np.nonzero(~(bound < floors[:, None]))  # a bound past all numbers leaves its pair in
            self.met += bound.size
            self.scored += len(q)
            got = scores(self.queries[part], vectors[:upto], q, v)
            stays = got >= floors[q]
            self._add(q[stays] + a, got[stays], order[v[stays]], number[v[stays]])

    def _add(self, *new: np.ndarray) -> None:
        if not len(new[0]):
            return
        q, s, o, v = (np.concatenate(pair) for pair in zip(self.found, new))
        by = np.lexsort((o, -s.astype(np.float64), q)) if np.abs(s.astype(np.float64)).max() < 2.0**52 else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(s[i]), o[i])))
        q, s, o, v = q[by], s[by], o[by], v[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        stays = place < self.k
        self.found = tuple(x[stays] for x in (q, s, o, v))
        last = place[stays] == self.k - 1
        at = self.found[0][last]
        self.floors[at] = np.maximum(self.floors[at], self.found[1][last].astype(np.float64) * (1 - 1e-15 * np.sign(self.found[1][last])))


def gram(vectors: DataFrame, size: int) -> np.ndarray:
    """The sum of the outer products of all vectors: a task sums its own, then each row of the matrix is summed."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 13):
                x = _matrix(batch.column(0).slice(a, 1 << 13), size)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size, dtype=np.int64)), "row": pa.array(list(total), pa.list_(pa.float64()))})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for row in table["row"].combine_chunks().flatten().to_numpy().reshape(-1, size):
            total += row
        return pa.table({"i": table["i"][:1], "row": pa.array([total], pa.list_(pa.float64()))})

    kind = "i long, row array<double>"
    rows = vectors.select("vector").mapInArrow(own, kind).groupBy("i").applyInArrow(add, kind).collect()  # size x size numbers
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)])


def rotation_of(total: np.ndarray) -> np.ndarray:
    """Singular vectors, those of the largest singular values first. Only speed depends on them."""
    scale = np.abs(total).max(initial=0)
    if not np.isfinite(scale) or not scale:
        return np.eye(len(total))
    return np.linalg.svd(total / scale)[0]


def search(vectors: DataFrame, queries: DataFrame, k: int, size: int, parallelism: int | None = None, pairs: int = PAIRS, head: int = HEAD) -> DataFrame:
    """(query, number, score) of the k best vectors of each query, ties to the lower `order`. vectors: number, vector,
    order (a long; tables of distinct vectors); queries: number, vector."""
    spark = vectors.sparkSession
    ship(spark)
    n, wanted = vectors.count(), queries.count()
    turn = rotation_of(gram(vectors, size))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    cores = parallelism or spark.sparkContext.defaultParallelism
    keys = max(2 * cores, math.ceil(n * wanted / pairs))
    groups = max(1, math.ceil(wanted * size / GROUP), math.ceil(math.sqrt(keys / 50)) if keys > 2 * cores else 1)
    ranges = min(max(1, math.ceil(keys / groups)), MOST_RANGES, max(1, math.ceil(n / 256)))
    block = max(1, BLOCK // size)

    longest = vectors.withColumn("length", length).orderBy(F.desc("length"), "number").limit(max(1, min(head, (1 << 18) // size))).collect()  # `head` rows
    top = np.zeros((len(longest), size))
    for i, r in enumerate(longest):
        top[i, : len(r.vector)] = r.vector
    top_lengths = np.array([r.length for r in longest])
    top_order, top_number = np.array([r.order for r in longest], np.int64), np.array([r.number for r in longest], np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                x = _matrix(part.column(1), size)
                best = Best(x, np.full(len(x), -math.inf), turn, k)
                best.meet(top, top_lengths, top_order, top_number)
                reach = np.where(best.floors <= 0, 0, best.floors / np.maximum(best.lengths, 1e-9) * (1 - 1e-9))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best.floors), pa.array(reach)], ["number", "vector", "floor", "reach"])

    asked = written(queries.select("number", "vector").mapInArrow(trimmed(first), "number long, vector array<double>, floor double, reach double"), "asked")
    edges = written(vectors.withColumn("length", length).repartitionByRange(ranges, F.desc("length"), "number").withColumn("range", F.pmod(F.spark_partition_id(), F.lit(ranges))), "ranges")
    far = edges.groupBy("range").agg(F.max("length").alias("longest"))  # a row a range: MOST_RANGES at most
    packed = edges.select("range", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), (-F.col("length")).alias("place"), "number", "vector", "order", F.lit(0.0).alias("floor"))
    grouped = asked.repartitionByRange(groups, "reach", "number").withColumn("group", F.pmod(F.spark_partition_id(), F.lit(groups)))
    sent = grouped.join(F.broadcast(far), F.col("longest") * (1 + 1e-9) >= F.col("reach")).select("range", "group", F.lit(0).alias("kind"), F.lit(0.0).alias("place"), "number", "vector", F.lit(0).cast("long").alias("order"), "floor")
    dealt = packed.unionByName(sent).repartition(ranges * groups, "range", "group").sortWithinPartitions("range", "group", "kind", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kind, held, best = None, 0, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None:
                q, s, o, v = best.found
                yield pa.RecordBatch.from_arrays([pa.array(asked_for[q]), pa.array(v), pa.array(s), pa.array(o)], ["query", "number", "score", "order"])

        def flush() -> None:
            nonlocal best, held, asked_for
            if held and kind == 0:
                table = pa.Table.from_batches(held).combine_chunks()
                x, floors = _matrix(table["vector"].combine_chunks(), size), table["floor"].to_numpy()
                asked_for = table["number"].to_numpy()
                best = Best(x, floors, turn, k)
            elif held and best is not None:
                table = pa.Table.from_batches(held).combine_chunks()
                for a in range(0, table.num_rows, block):
                    part = table.slice(a, block)
                    best.meet(_matrix(part["vector"].combine_chunks(), size), -part["place"].to_numpy(), part["order"].to_numpy(), part["number"].to_numpy())
            held = []

        asked_for = np.empty(0, np.int64)
        rows = 0
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.int64) << 33 | batch.column(1).to_numpy().astype(np.int64) << 1 | batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.diff(at)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                now = (int(at[a]) >> 1, int(at[a]) & 1)
                if now != (key, kind):
                    flush()
                    rows = 0
                    if now[0] != key:
                        yield from done()
                        best = None
                    key, kind = now
                held.append(batch.slice(a, b - a))
                rows += b - a
                if kind == 1 and rows >= block:
                    flush()
                    rows = 0
        flush()
        yield from done()

    hits = dealt.mapInArrow(trimmed(run), "query long, number long, score long, order long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "order"))
    return hits.withColumn("place", place).where(F.col("place") <= k).select("query", "number", "score")


def top_k(rows: DataFrame, k: int = 5, asked: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", **sizes: int) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row where `asked` holds (default: its id is divisible by 50), the k other
    rows with the highest scores; ties go to the smaller id."""
    spark = rows.sparkSession
    asked = F.coalesce(F.col(id_col) % 50 == 0 if asked is None else asked, F.lit(False))
    own = rows.select(F.col(id_col).cast("long").alias("id"), asked.alias("asked"), whole(vector_col).alias("vector")).where("vector IS NOT NULL")
    own = written(own.withColumns({"row": F.monotonically_increasing_id(), "key": F.sha2(F.col("vector").cast("string"), 256)}), "vectors")
    size = own.agg(F.max(F.size("vector"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    if not size:
        return spark.createDataFrame([], schema)
    # The first k + 1 rows of each distinct vector; ties between rows of one id go to either.
    by_id = Window.partitionBy("key").orderBy(F.asc_nulls_last("id"), "row")
    members = own.select("key", "id", "row", "vector").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    members = written(members, "members")
    # Numbers of vectors in order of their first ids: ties between vectors are ties between those.
    first = members.where("nth = 1").select("key", F.col("row").alias("number"), "vector", F.coalesce("id", F.lit(LONG)).alias("order"))
    copies = own.where("asked").groupBy("key").agg(F.count(F.lit(1)).alias("__copies"))
    wanted = written(first.join(copies, "key"), "queries")
    hits = search(first.select("number", "vector", "order"), wanted.select("number", "vector"), k + 1, size, **sizes)
    numbers = first.select("key", F.col("number").alias("of"))
    listed = members.join(numbers, "key").select("of", "id", "row")
    best = hits.join(listed, hits["number"] == listed["of"]).select("query", "score", "id", "row")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    best = best.withColumn("place", place).where(F.col("place") <= k + 1)
    listing = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "row", "score"))).alias("hits"))  # k + 1 at most
    one = written(listing.join(wanted.select(F.col("number").alias("query"), "key", "__copies"), "query").select("key", "hits", "__copies"), "hits")
    found = join_skewed(own.where("asked").select("id", "row", "key"), one, "key", "__copies")
    others = F.slice(F.filter("hits", lambda h: h["row"] != F.col("row")), 1, k)
    return found.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
