"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is a folder with a Parquet table of (digest, keep_id, n): bucketed and sorted by the digest, so that
a batch of new documents is joined by sort-merge without moving the index. A batch is first
reduced to one row per digest with partial aggregation (a group of copies of any size leaves one
row per map task), anti-joined with the index, and what is new is appended.

Edge cases: null text counts as empty; empty texts are one group; repeated rows with one id are
copies of each other; extra columns are ignored; very long texts are hashed whole; an empty table
gives an empty result. A null id sorts after every other id: it stays only if all ids of its group
are null. keep_first decides by row, not by id: of rows that repeat an id, those with other texts
are judged by themselves, and of equal ones the first in its file stays.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import exists, join_skewed, keep_rows, marked, on_files, remove, shared_dir, written


def normalised(text: str | Column = "text") -> Column:
    """Every run of space, tab, LF, VT, FF and CR as one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: str | Column = "text") -> Column:
    """Lowercase SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """A table of the digests seen so far; bucketed by digest, files sorted by it.

    The folder is the index: `about` in it says how many buckets there are, and any session that opens the folder makes a
    table over its files. A folder that holds anything else is refused. Without a path an index is made for the session.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.path = (path or shared_dir(spark, "digest-index")).rstrip("/")
        self.name = name or f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if self.exists():
            self.buckets = spark.read.schema("buckets int").json(f"{self.path}/about").first()[0]
            self._open()
        elif exists(spark, self.path):
            raise ValueError(f"{self.path} is there already and is no digest index")

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/about/_SUCCESS")

    def _open(self) -> None:
        """A table of this session over the folder's files."""
        spark = self.spark
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, n BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'")
        found = [r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect() if r.col_name == "Location"][0]
        if re.sub("^file:/*", "/", found) != re.sub("^file:/*", "/", f"{self.path}/digests"):
            raise ValueError(f"the table {self.name} lies in {found}, not in {self.path}")
        spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Append (digest, keep_id, n); one file a bucket, since rows are dealt by digest first."""
        if not self.exists():
            self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.json(f"{self.path}/about")
            self._open()
        dealt = rows.select("digest", F.col("keep_id").cast("long"), F.col("n").cast("long")).repartition(self.buckets, "digest")
        dealt.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, [self.path])


def add_batch(index: DigestIndex, digests: DataFrame, id_col: str = "doc_id") -> None:
    """Append the digests of a batch (id, digest) that the index lacks, each with its smallest id and its count."""
    first = digests.groupBy("digest").agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("n"))
    if index.exists():
        first = first.join(index.read().select("digest").hint("merge"), "digest", "left_anti")
    index.append(first)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    With an index of earlier batches, a document whose digest is known is dropped in favour of the
    id kept then. group_size counts the copies of the batch that brought the digest. Of rows that
    repeat the kept id itself, all are kept rows: the decision is by id. Without an index one is made
    for the call and dropped.
    """
    own = index or DigestIndex(docs.sparkSession)
    rows = written(docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest")), "digests")
    add_batch(own, rows, "doc_id")
    # The merge with the index takes one row per digest; digests with very many copies meet theirs by broadcast.
    seen = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("__copies"))
    verdict = seen.join(own.read().select("digest", "keep_id", F.col("n").alias("group_size")).hint("merge"), "digest")
    verdict = written(verdict, "digest-verdict")
    if index is None:
        own.drop()
    return join_skewed(rows, verdict, "digest", "__copies").select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row of each group of equal texts, that with the smallest id, with all its columns; with an index of earlier
    batches only texts that it lacks, which are added to it."""
    docs = on_files(docs)
    own = index or DigestIndex(docs.sparkSession)
    rows = marked(docs).select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"), "__file", "__row")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row")
    stays = rows.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    if own.exists():
        stays = stays.join(own.read().select("digest").hint("merge"), "digest", "left_anti")
    stays = written(stays.select("digest", "first.*", "n"), "digest-first")
    own.append(stays.withColumnRenamed("doc_id", "keep_id"))
    if index is None:
        own.drop()
    return keep_rows(docs, stays)
