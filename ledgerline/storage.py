"""Intermediate tables: where driver and executors share them, and when they go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}  # the folders made so far, by application


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset, a local master gets a
    temporary folder; a cluster is refused, since its machines do not share one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerline-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") if "://" in found else f"file://{found.rstrip('/')}"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name (URI) below the shared folder."""
    path = f"{shared_root(spark)}/ledgerline-{label}-{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The folders that this application has named and not removed."""
    return _made.setdefault(spark.sparkContext.applicationId, [])


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows dealt evenly to a fixed number of tasks (the session's shuffle partitions), for work that is large beside
    the rows: small tables otherwise lie in one partition."""
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder of that name?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that shared_dir named."""
    own = made(spark)
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in own:
            own.remove(path)


def clean(spark: SparkSession) -> None:
    """Deletes every folder that the operators made in this application; their results cannot be read afterwards."""
    remove(spark, list(made(spark)))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, when left, the folders made inside it, but for those in the list it hands out."""
    own, stay = made(spark), []
    before = set(own)
    yield stay
    remove(spark, [p for p in own if p not in before and p not in stay])
