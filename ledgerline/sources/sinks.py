"""Sinks: appends, replacements, guarded samples, partitions, sidecars, side outputs."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.hashing import case_set_hash
from ledgerline.shipping import ship
from ledgerline.sources.readers import path_exists

HEAVY = ("dynamic_prompt", "prompt", "note", "summary", "patient_string")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def append_csv(df: DataFrame, path: str) -> None:
    """Rows appended as part files, each with its header."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def recover_table(spark: SparkSession, path: str) -> bool:
    """Puts a table back that a swap left without its name: the old one is beside the target until the new one has it."""
    fs, target = _fs(spark, path)
    if fs.exists(target):
        return False
    beside = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.*.old")) or []
    for status in sorted(beside, key=lambda s: -s.getModificationTime()):
        return bool(fs.rename(status.getPath(), target))
    return False


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the target, then swaps; a failed write leaves the old table, and a swap that broke off between its two
    renames is mended first (also by recover_table)."""
    spark, draft = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    recover_table(spark, path)
    df.write.parquet(draft)
    fs, target = _fs(spark, path)
    new, old = spark._jvm.org.apache.hadoop.fs.Path(draft), spark._jvm.org.apache.hadoop.fs.Path(f"{draft}.old")
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not move {draft} to {path}")
    if had:
        fs.delete(old, True)


def publish(df: DataFrame, path: str, hold: int = 86_400) -> str:
    """Writes a new version of a table below path and points readers to it: a version is a folder of its own, and the file
    `current`, which holds its name, is replaced in one rename. So a reader (published) finds the old version or the new one at
    any moment, and a write that fails changes nothing. A version goes `hold` seconds after another took its place, so that
    readers that have begun can end."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    root = path.rstrip("/")
    df.write.parquet(f"{root}/{version}")
    fs, draft = _fs(spark, f"{root}/{version}.current")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/current")
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(how, 1)
    over[0] = how.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(target), over)
    held = sorted((v for v in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root)) if v.isDirectory()), key=lambda v: -v.getModificationTime())
    for newer, old in zip(held, held[1:]):
        if old.getPath().getName() != version and newer.getModificationTime() <= (time.time() - hold) * 1000:
            fs.delete(old.getPath(), True)
    return version


def published(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that is current when this is called."""
    root = path.rstrip("/")
    fs, at = _fs(spark, f"{root}/current")
    source = fs.open(at)
    try:
        version = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return spark.read.parquet(f"{root}/{version}")


def write_once(df: DataFrame, path: str, key: str, force: bool = False) -> str:
    """A sample is not redrawn: an existing one must hold the same keys. Returns the hash of the key set."""
    own = case_set_hash(df, key)
    if path_exists(df.sparkSession, path) and not force:
        there = case_set_hash(df.sparkSession.read.parquet(path), key)
        if there != own:
            raise FileExistsError(f"{path} holds another sample ({there[:12]}, not {own[:12]})")
        return own
    df.write.mode("overwrite").parquet(path)
    return own


def by_id(df: DataFrame, path: str, key: str) -> None:
    """One folder an id; rows are dealt by it first, so a task opens few files."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def split_panel(wide: DataFrame, keys: list[str], members: list[str], path: str) -> None:
    """A wide panel result as one folder a member task."""
    long = wide.unpivot(keys, [F.col(m).cast("string").alias(m) for m in members], "task", "answer")
    long.write.mode("overwrite").partitionBy("task").parquet(path)


def with_sidecar(df: DataFrame, path: str, entity: str, inputs: dict[str, str], commit: str | None = None) -> dict:
    """Writes the table and a JSON beside it: counts, hashes of the inputs' contents by name, commit."""
    replace_table(df, path)
    row = df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities")).first()
    info = {"rows": row.rows, "entities": row.entities, "inputs": {k: hashlib.sha256(v.encode()).hexdigest() for k, v in inputs.items()}, "commit": commit}
    fs, p = _fs(df.sparkSession, f"{path.rstrip('/')}.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(info, sort_keys=True).encode()))
    out.close()
    return info


def log_attempts(df: DataFrame, path: str) -> None:
    """Append-only JSON lines."""
    df.write.mode("append").json(path)


def side_outputs(df: DataFrame, path: str, outcome: str = "outcome") -> None:
    """One folder an outcome: results and side lists are a partition of the input."""
    df.write.mode("overwrite").partitionBy(outcome).parquet(path)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> int:
    """One file a row (text or bytes) below the folder, each renamed into place whole; returns how many."""
    from pyarrow import fs as stores

    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        n = 0
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = stores.FileSystem.from_uri(f"{folder.rstrip('/')}/{file}")
                store.create_dir(path.rpartition("/")[0], recursive=True)
                draft = f"{path}.{uuid.uuid4().hex}.draft"
                with store.open_output_stream(draft) as out:
                    out.write(body.encode() if isinstance(body, str) else body)
                store.move(draft, path)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return df.select(name, content).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def document_text(df: DataFrame, key: str, order: list[str], line: str) -> DataFrame:
    """One text per id, lines in order."""
    from ledgerline.operators.timeline import ordered_text

    return ordered_text(df, [key], [F.col(o) for o in order], F.col(line), "notes")


def light(df: DataFrame) -> DataFrame:
    """Result rows without the heavy columns."""
    return df.drop(*HEAVY)
