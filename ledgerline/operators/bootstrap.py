"""Bootstrap intervals by reweighting: a cluster's weight in a replicate is a function of its key.

A weight is a Poisson(1) count of a 32-bit hash of cluster and replicate, so a replicate needs no draw, no
order, no resampled rows and no join, and both arms of a comparison share the weights. Rows are summed to
clusters first; a task then multiplies its clusters with all replicates at once and hands on one row a
replicate and group of cells, so replicates x tasks rows move, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.hashing import POISSON_ONE, keyed_sha
from ledgerline.operators.metrics import ratio
from ledgerline.operators.running import cuts_of
from ledgerline.shipping import ship
from ledgerline.storage import written

REPLICATES = 1000
#: The multipliers of the 32-bit hash.
SPREAD, MIX = 0x9E3779B1, 0x45D9F3B
#: From which hash on a cluster is drawn once, twice, ...
DRAWN = [int(p * (1 << 32)) + 1 for p in POISSON_ONE]
BLOCK = 100
#: Sums of replicates that a task holds before it hands them on, and weights that it works with at a time.
HELD_BYTES, WEIGHT_BYTES = 64 << 20, 32 << 20


def cluster_hash(cluster: Column, salt: str = "boot") -> Column:
    """32 bits of a keyed hash of the cluster; a null cluster is an error at run time."""
    bits = F.conv(F.substring(keyed_sha(salt, cluster), 1, 8), 16, 10).cast("bigint")
    return F.when(cluster.isNull(), F.raise_error(F.lit("a row has no cluster")).cast("bigint")).otherwise(bits)


def _mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, which wrap."""
    x = x.astype(np.uint32)
    t = np.empty_like(x)
    for _ in range(2):
        x ^= np.right_shift(x, 16, out=t)
        x *= np.uint32(MIX)
    x ^= np.right_shift(x, 16, out=t)
    return x


def weights(clusters: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each cluster (a hash) is drawn in each replicate: clusters x replicates."""
    rep = _mixed((replicates.astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD) & np.uint64(0xFFFFFFFF))
    u = _mixed(clusters.astype(np.uint32)[:, None] ^ rep[None])
    out = np.zeros(u.shape, np.uint8)
    for d in DRAWN:
        out += u >= np.uint32(d)
    return out


def weights_sql(clusters: str, key: str, replicates: int, salt: str = "boot") -> str:
    """DuckDB SQL of (key, rep, w) for a table with one row a cluster."""
    half = lambda a, b: f"xor({a}, {a} >> 16) * {MIX} % 4294967296 AS {b}"
    drawn = " + ".join(f"(u >= {d})::INT" for d in DRAWN)
    return f"""(SELECT {key}, rep, ({drawn})::BIGINT AS w FROM (
        SELECT {key}, rep, xor(h, r) AS x0, {half("x0", "x1")}, {half("x1", "x2")}, xor(x2, x2 >> 16) AS u
        FROM (SELECT {key}, ('0x' || substr(sha256('{salt}:' || {key}), 1, 8))::BIGINT AS h FROM {clusters}),
             (SELECT rep, (rep + 1) * {SPREAD} % 4294967296 AS y0, {half("y0", "y1")}, {half("y1", "y2")}, xor(y2, y2 >> 16) AS r FROM range({replicates}) t(rep))))"""


def replicated_sums(df: DataFrame, cluster: Column, values: Sequence[str], replicates: int = REPLICATES, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rep, values): the sums of the values in each replicate, each cluster weighted as often as it is drawn."""
    per = df.groupBy(*keys, cluster_hash(cluster).alias("h")).agg(*[F.sum(v).alias(v) for v in values])
    return summed_weights(per, keys, values, replicates)


def summed_weights(per: DataFrame, keys: Sequence[str], values: Sequence[str], replicates: int) -> DataFrame:
    """(keys, rep, values): per has rows of keys, h (a cluster's hash) and values; they are multiplied where they lie, and a
    task hands on one row a replicate and combination of keys each time it holds HELD_BYTES."""
    per = per.select(*keys, "h", *[F.col(v).cast("double").alias(v) for v in values])
    ship(per.sparkSession)
    schema = ", ".join([f"`{k}` {per.schema[k].dataType.simpleString()}" for k in keys] + ["rep long"] + [f"`{v}` double" for v in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple, int] = {}
        total = np.zeros((0, replicates, len(values)))

        def rows() -> Iterator[pa.RecordBatch]:
            for k, i in number.items():
                own = [pa.array([v] * replicates, kind) for v, kind in zip(k, kinds)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(replicates)), *[pa.array(total[i, :, j]) for j in range(len(values))]], [*keys, "rep", *values])

        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(len(keys) + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(values))], axis=1)
            # Each key column as a dictionary: only distinct combinations are met in Python.
            code, names = np.zeros(len(h), np.int64), [()]
            for i in range(len(keys)):
                coded = batch.column(i).dictionary_encode(null_encoding="encode")
                listed = coded.dictionary.to_pylist()
                kinds_met, code = np.unique(code * len(listed) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
                names = [(*names[k // len(listed)], listed[k % len(listed)]) for k in kinds_met.tolist()]
            order = np.argsort(code, kind="stable")
            first = np.searchsorted(code[order], np.arange(len(names)))
            own = x[order]
            place = np.array([number.setdefault(k, len(number)) for k in names])
            if len(number) > len(total):
                total = np.concatenate([total, np.zeros((len(number) - len(total), replicates, len(values)))])
            for a in range(0, replicates, BLOCK):
                w = weights(h[order], np.arange(a, min(a + BLOCK, replicates))).astype(np.float64)
                for i, (b, e) in enumerate(zip(first, [*first[1:], len(order)])):
                    total[place[i], a : a + w.shape[1]] += w[b:e].T @ own[b:e]
            if total.nbytes > HELD_BYTES:
                yield from rows()
                number, total = {}, np.zeros((0, replicates, len(values)))
        yield from rows()

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(per.schema[k].dataType) for k in keys]
    return per.mapInArrow(run, schema).groupBy(*keys, "rep").agg(*[F.sum(v).alias(v) for v in values])


def interval(per_rep: DataFrame, value: str, keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Percentile interval, linear between neighbours (one value a replicate and key)."""
    a = (1 - level) / 2
    return per_rep.groupBy(*keys).agg(F.percentile(value, a).alias("low"), F.percentile(value, 1 - a).alias("high"), F.count(value).alias("reps"))


def index_interval(per_rep: DataFrame, value: str, keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Interval by index into the sorted values, outwards: no interpolation. Replicates without a value do not count."""
    a = (1 - level) / 2
    held = per_rep.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("__v"))  # one value a replicate
    last = F.size("__v") - 1
    at = lambda i: F.get("__v", i.cast("int"))
    return held.select(*keys, at(F.floor(F.round(last * a, 9))).alias("low"), at(F.ceil(F.round(last * (1 - a), 9))).alias("high"), F.size("__v").cast("bigint").alias("reps"))


def cluster_auroc(df: DataFrame, cluster: str, question: str, label: Column, score: Column, replicates: int = REPLICATES, rows_each: int = 50_000) -> DataFrame:
    """(rep, question, auroc) with the cluster drawn as a whole; null where a replicate has one class.

    Rows are summed per (question, score, cluster) and scores cut into ranges of about rows_each such cells. A range of
    several scores is one task's, a question at a time: cells in order, replicates in blocks of WEIGHT_BYTES. A score that
    fills a range, however many clusters have it, is one by itself: all its cells are tied, so their sums by replicate are
    enough, and these are added up where the cells lie (replicated_sums), a task holding HELD_BYTES of them. What
    pairs of ranges add follows from their sums, replicates x ranges rows a question."""
    ship(df.sparkSession)
    rows = df.select(F.col(cluster).alias("c"), F.col(question).alias("q"), label.cast("int").alias("y"), score.cast("double").alias("s")).where("s IS NOT NULL AND NOT isnan(s) AND y IS NOT NULL")
    counted = rows.groupBy("q", "s", cluster_hash(F.col("c")).alias("h")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    cells = written(counted, "score-cells")
    cuts = cuts_of(cells, "s", rows_each=rows_each)[0]
    parts = cells.withColumns({"r": cuts.number(F.col("s")), "tied": cuts.is_point(F.col("s"))})
    schema = f"rep long, q {rows.schema['q'].dataType.simpleString()}, r int, pos double, neg double, won double"

    def run(key, table):
        s = table["s"].to_numpy()
        order = np.argsort(s, kind="stable")
        h, p, n = (table[c].to_numpy()[order].astype(np.float64 if c != "h" else np.uint64) for c in ("h", "pos", "neg"))
        first = np.flatnonzero(np.concatenate([[True], np.diff(s[order]) != 0]))
        out, step = [], max(1, WEIGHT_BYTES // (8 * len(s)))
        for a in range(0, replicates, step):
            w = weights(h, np.arange(a, min(a + step, replicates))).astype(np.float64)
            wp, wn = (np.add.reduceat(w * x[:, None], first, axis=0) for x in (p, n))
            below = np.cumsum(wn, axis=0) - wn
            out.append(np.stack([wp.sum(0), wn.sum(0), (wp * (below + wn / 2)).sum(0)], axis=1))
        found = np.concatenate(out)
        return pa.table({"rep": pa.array(np.arange(replicates)), "q": pa.array([key[0].as_py()] * replicates, table.schema.field("q").type), "r": pa.array([key[1].as_py()] * replicates, pa.int32()), **{c: pa.array(found[:, i]) for i, c in enumerate(("pos", "neg", "won"))}})

    per = parts.where("NOT tied").groupBy("q", "r").applyInArrow(run, schema)
    if cuts.heavy:
        tied = summed_weights(parts.where("tied").select("q", "r", "h", "pos", "neg"), ["q", "r"], ["pos", "neg"], replicates)
        per = per.unionByName(tied.withColumn("won", F.col("pos") * F.col("neg") / 2))
    below = Window.partitionBy("rep", "q").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    total = per.withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    return total.groupBy("rep", F.col("q").alias(question)).agg(ratio(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auroc"))


def stratified_accuracy_difference(df: DataFrame, unit: str, truth: str, a: str, b: str, replicates: int = REPLICATES) -> DataFrame:
    """(rep, difference of balanced accuracies b - a) on the same draws; each unit is weighted within its class."""
    marked = df.select(F.col(unit), F.col(truth).alias("t"), F.lit(1).alias("n"), (F.col(a) == F.col(truth)).cast("int").alias("ha"), (F.col(b) == F.col(truth)).cast("int").alias("hb"))
    per = replicated_sums(marked, F.col(unit), ["n", "ha", "hb"], replicates, ["t"]).where("n > 0")
    return per.groupBy("rep").agg((F.avg(ratio(F.col("hb"), F.col("n"))) - F.avg(ratio(F.col("ha"), F.col("n")))).alias("difference"))


def stratified_metrics(df: DataFrame, unit: str, truth: str, pred: str, classes: Sequence, replicates: int = REPLICATES) -> DataFrame:
    """(rep, accuracy, balanced_accuracy, macro_f1): the forced-answer metrics of each replicate. Units are drawn within
    their class: a replicate's cells are scaled to the class's size, so every class keeps its share."""
    cell = lambda t, p: F.when((F.col(truth) == t) & (F.col(pred).eqNullSafe(p) if p is not None else ~F.coalesce(F.col(pred).isin(*classes), F.lit(False))), 1).otherwise(0)
    names = {(i, j): f"c{i}_{j}" for i in range(len(classes)) for j in range(len(classes) + 1)}
    marked = df.select(F.col(unit), *[cell(classes[i], classes[j] if j < len(classes) else None).alias(c) for (i, j), c in names.items()])
    size = marked.agg(*[sum(F.sum(names[i, j]) for j in range(len(classes) + 1)).alias(f"n{i}") for i in range(len(classes))])  # one row
    per = replicated_sums(marked, F.col(unit), list(names.values()), replicates).crossJoin(F.broadcast(size))
    drawn = lambda i: sum((F.col(names[i, j]) for j in range(len(classes) + 1)), F.lit(0.0))
    scaled = lambda i, j: F.coalesce(F.try_divide(F.col(names[i, j]) * F.col(f"n{i}"), drawn(i)), F.lit(0.0))
    every = range(len(classes))
    there = [F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in every]
    recall = [ratio(scaled(i, i), F.col(f"n{i}")) for i in every]
    f1 = [ratio(2 * scaled(i, i), F.col(f"n{i}") + sum((scaled(k, i) for k in every), F.lit(0.0))) for i in every]
    mean = lambda xs: ratio(sum((F.coalesce(x, F.lit(0.0)) * t for x, t in zip(xs, there)), F.lit(0.0)), sum(there, F.lit(0)))
    accuracy = ratio(sum((scaled(i, i) for i in every), F.lit(0.0)), sum((F.col(f"n{i}") for i in every), F.lit(0)))
    return per.select("rep", accuracy.alias("accuracy"), mean(recall).alias("balanced_accuracy"), mean(f1).alias("macro_f1"))


def cluster_macro_accuracy(df: DataFrame, cluster: str, question: str, label: str, pred: str, replicates: int = REPLICATES) -> DataFrame:
    """(rep, balanced_accuracy): mean over questions of the balanced accuracy, whole clusters drawn; unreadable is wrong."""
    right = F.coalesce(F.col(pred) == F.col(label), F.lit(False)).cast("int")
    marked = df.select(F.col(cluster), F.col(question).alias("q"), F.col(label).alias("y"), F.lit(1).alias("n"), right.alias("hit"))
    per = replicated_sums(marked, F.col(cluster), ["n", "hit"], replicates, ["q", "y"]).where("n > 0")
    return per.groupBy("rep", "q").agg(F.avg(ratio(F.col("hit"), F.col("n"))).alias("ba")).groupBy("rep").agg(F.avg("ba").alias("balanced_accuracy"))
