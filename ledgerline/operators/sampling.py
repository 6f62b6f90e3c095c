"""Deterministic samples: order is a keyed hash, so the same rows come out whatever the partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.hashing import keyed_sha
from ledgerline.storage import shared_dir, written


def first_by_hash(df: DataFrame, prefix: str, key: str, k: int) -> DataFrame:
    """k rows in order of their hash (a bounded top-k, not a full sort)."""
    return df.orderBy(keyed_sha(prefix, key), key).limit(k)


def per_class(df: DataFrame, label: str, key: str, n: int, prefix: str) -> DataFrame:
    """n of each class; a smaller n is a subset of a larger one. The window keeps n rows a task before the shuffle."""
    w = Window.partitionBy(label).orderBy(keyed_sha(prefix, key), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shared_across(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """The persons of one task's sample, reused for its sibling tasks."""
    return df.join(sample.select(key).distinct(), key, "left_semi")


def minimum_positives(df: DataFrame, key: str, tasks: Sequence[str], least: int, n: int, prefix: str) -> DataFrame:
    """At least `least` positives of each task, then filled to n, in hash order; df has one row per key and 0/1 tasks."""
    ranked = df.withColumn("h", keyed_sha(prefix, key))
    must = None
    for t in tasks:
        own = ranked.where(F.col(t) == 1).orderBy("h", key).limit(least).select(key)
        must = own if must is None else must.union(own)
    flagged = ranked.join(must.distinct().withColumn("must", F.lit(1)), key, "left")
    return flagged.orderBy(F.coalesce("must", F.lit(0)).desc(), "h", key).limit(n).drop("h", "must")


def greedy_cover(df: DataFrame, key: str, columns: Sequence[str], each: int, k: int, prefix: str) -> DataFrame:
    """(key): k rows so that every (column, value) is carried `each` times, rarest first, then filled up. df has one row a key.

    A round a (column, value): how often the rows chosen so far carry it, and the others, is one row of counts; what it still
    needs is a bounded top-k in hash order of the rows that carry it and are not chosen, added to the table of the chosen.
    Rows stay in Spark: the driver sees the values (label columns have few) and a row a round."""
    spark = df.sparkSession
    labels = [F.col(c).cast("string").alias(c) for c in columns]
    ranked = written(df.select(F.col(key), keyed_sha(prefix, key).alias("h"), *labels).where(F.coalesce(*map(F.col, columns)).isNotNull()), "cover")
    cells = ranked.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("cell")).where("cell.value IS NOT NULL")
    order = sorted((r.n, r.cell.column, r.cell.value) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a value
    path, chosen = shared_dir(spark, "cover-chosen"), None

    def add(pool: DataFrame, n: int) -> None:
        nonlocal chosen
        rest = pool if chosen is None else pool.join(chosen.select(key), key, "left_anti")
        rest.orderBy("h", key).limit(n).select(*ranked.columns).write.mode("append").parquet(path)
        chosen = spark.read.schema(ranked.schema).parquet(path)

    counts = [F.count_if(F.col(c) == value) for _, c, value in order]
    have = [0] * (len(order) + 1)
    for i, (_, column, value) in enumerate(order):
        if (need := min(each - have[i + 1], k - have[0])) > 0:
            add(ranked.where(F.col(column) == value), need)
            have = list(chosen.agg(F.count(F.lit(1)), *counts).first())
    if have[0] < k:
        add(ranked, k - have[0])
    return chosen.select(key)


def enriched_pool(df: DataFrame, person: str, scan: str, columns: Sequence[str], target: int, n: int, prefix: str) -> DataFrame:
    """One scan per person (first by hash), then scarcest (question, class) first up to target, then filled to n."""
    one = df.withColumn("h", keyed_sha(prefix, person, scan)).groupBy(person).agg(*[F.min_by(c, "h").alias(c) for c in [scan, *columns]])
    return one.join(greedy_cover(one, scan, columns, target, n, prefix), scan, "left_semi")


def tile_sample(tiles, row_key: str, n: int, prefix: str):
    """n of the row's tile list in hash order; all when there are no more. A per-row column, no shuffle."""
    keyed = F.transform(F.col(tiles), lambda t: F.struct(F.sha2(F.concat_ws(":", F.lit(prefix), F.col(row_key).cast("string"), t).cast("binary"), 256).alias("h"), t.alias("t")))
    return F.when(F.size(tiles) <= n, F.col(tiles)).otherwise(F.transform(F.slice(F.array_sort(keyed), 1, n), lambda z: z["t"]))


