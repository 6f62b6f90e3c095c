"""What the text operators share: shipping code, the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.files import new_file, open_file
from ledgerline.shipping import ship
from ledgerline.storage import clean, exists, made, remove, scratch, shared_dir, shared_root, written

__all__ = ["by_chunk", "chunks", "clean", "documents", "exists", "join_skewed", "keep_rows", "made", "marked", "on_files", "remove", "scratch", "shared_dir", "shared_root", "ship", "sliced", "trimmed", "utf8", "written"]


def on_files(docs: DataFrame) -> DataFrame:
    """docs, read from files whose rows can be told apart; written first if it is not a scan of files."""
    try:
        marked(docs).schema  # noqa: B018
        return docs
    except AnalysisException:
        return written(docs, "rows")


def marked(docs: DataFrame) -> DataFrame:
    """docs with __file and __row: the file and the place in it that a row was read from."""
    at = docs.metadataColumn("_metadata")
    return docs.withColumns({"__file": at["file_path"], "__row": at["row_index"]})


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs (on_files) whose __file and __row are in kept, with all their columns. No row is moved: what stays
    of a file is noted beside it, as one list of places, and the scan of the file leaves the rest out. Every file of docs
    has a note, if an empty one; a file whose note is gone when the result is read is an error, not an empty file."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark, "kept-rows")

    def name(file: str) -> str:
        return f"{folder}/{hashlib.md5(file.encode()).hexdigest()}.rows"

    def note(key, table):
        places = np.sort(table["__row"].to_numpy().astype(np.int64))
        with new_file(name(key[0].as_py())) as out:
            out.write(places[places >= 0].tobytes())
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    every = marked(docs).groupBy("__file").agg(F.lit(-1).cast("long").alias("__row"))
    kept.select("__file", F.col("__row").cast("long")).unionByName(every).groupBy("__file").applyInArrow(note, "n long").agg(F.sum("n")).collect()  # one row

    taken = {c.lower() for c in docs.columns}
    file, row = (next(c for c in (f"__{x}" + "_" * k for k in range(len(taken) + 1)) if c not in taken) for x in ("file", "row"))
    at = docs.metadataColumn("_metadata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, places = None, np.empty(0, np.int64)
        for batch in batches:
            files, rows = batch.column(file).dictionary_encode(), batch.column(row).to_numpy()
            stays = np.zeros(batch.num_rows, bool)
            for code, of in enumerate(files.dictionary.to_pylist()):
                if of != loaded:
                    with open_file(name(of)) as f:
                        loaded, places = of, np.frombuffer(f.read(), np.int64)
                own = np.flatnonzero(files.indices.to_numpy() == code)
                stays[own] = np.append(places, -1)[np.searchsorted(places, rows[own])] == rows[own]
            out = batch.select([c for c in batch.schema.names if c not in (file, row)])
            yield out.filter(pa.array(stays))

    return docs.withColumns({file: at["file_path"], row: at["row_index"]}).mapInArrow(trimmed(run), docs.schema)


def join_skewed(rows: DataFrame, one: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of one (one row a key, `count` = its rows): keys with over a thousandth of all rows by
    broadcast, of which there are fewer than a thousand whatever the input, the others by a merge. One plan; what `one`
    shuffles is shared by its parts."""
    share = one.crossJoin(F.broadcast(one.agg(F.sum(count).alias("__total"))))  # one row
    hot = F.col(count) * 1000 > F.col("__total")
    names = [c for c in one.columns if c != key]
    near = F.broadcast(share.where(hot).select(F.col(key), F.struct(*names).alias("__hot")))
    few = rows.join(near, key).select(*rows.columns, "__hot.*")
    rest = rows.join(near.select(key), key, "left_anti").join(share.where(~hot).select(*one.columns).hint("merge"), key)
    return few.unionByName(rest.select(*rows.columns, *names))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def chunks(lengths: list[int], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer row stands alone."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def trimmed(run: Callable) -> Callable:
    """A mapInArrow function that hands memory back when its task ends: workers stay for the next stage, and what their
    allocators hold would add to it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def sliced(batch: pa.RecordBatch, text: str | int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about limit bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for a, b in chunks(sizes, limit):
        yield batch.slice(a, b - a)


def by_chunk(df: DataFrame, fn: Callable[..., Iterator[pa.RecordBatch]], schema: str, text: str = "text", limit: int = 1 << 20, **options) -> DataFrame:
    """mapInArrow that hands fn pieces of about limit bytes of text, so memory follows neither batch nor partition."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, text, limit):
                yield from fn(piece, **options)

    return df.mapInArrow(trimmed(run), schema)
