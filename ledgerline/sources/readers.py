"""Sources: tables by name or path, delimited files, JSON lines, nested answers, XML events, logs, files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.running import RANGE_ROWS, carried_last
from ledgerline.shipping import ship


def task_rows(spark: SparkSession, table: str, task: str) -> DataFrame:
    """SELECT * FROM table WHERE task = :task, with a bound parameter; errors are not swallowed."""
    return spark.sql(f"SELECT * FROM {table} WHERE task = :task", args={"task": task})


def path_exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's own file systems, so any store it reads will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_or_table(spark: SparkSession, cache: str, table: str, task: str, schema: T.StructType | None = None) -> DataFrame:
    """The cached CSV of the table where there is one, else the table; rows of the task."""
    if path_exists(spark, cache):
        return delimited(spark, cache, schema=schema).where(F.col("task") == task)
    return task_rows(spark, table, task)


def sniff(spark: SparkSession, path: str, candidates: str = ",\t;|") -> str:
    """The delimiter that is most frequent in the first line (one row is read)."""
    head = spark.read.text(path).limit(1).first()
    line = head.value if head else ""
    return max(candidates, key=lambda c: (line.count(c), -candidates.index(c)))


def delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, text_ids: bool = True) -> DataFrame:
    """A CSV with a header: delimiter from its first line, quoted line breaks, malformed rows dropped. Without a schema
    every column is text, so a zero-padded id stays what it is."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sniff(spark, path)).option("mode", "DROPMALFORMED")
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", not text_ids).csv(path)


def file_place() -> Column:
    """Orders rows as their files have them: by file, by the place of the part of it that a task reads, then within it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def parquet_columns(spark: SparkSession, path: str, columns: Sequence[str], key: str | None = None, keys: Sequence | DataFrame | None = None) -> DataFrame:
    """Only the named columns; keys as a list become a pushed filter, as a table a semi-join."""
    df = spark.read.parquet(path)
    if isinstance(keys, DataFrame):
        df = df.join(keys.select(key), key, "left_semi")
    elif keys is not None:
        df = df.where(F.col(key).isin(list(keys)))
    return df.select(*columns)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def answers_document(spark: SparkSession, path: str, answer: T.StructType) -> DataFrame:
    """{'answers': {id: {...}}} as rows (id, ...)."""
    schema = T.StructType([T.StructField("answers", T.MapType(T.StringType(), answer))])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("answers").alias("id", "a")).select("id", "a.*")


XML_EVENT = "file string, encounter long, person string, timestamp string, i int, j int, code string, description string, unit string, text_value string"
#: Events of a batch, and bytes of a file that are parsed at a time.
XML_ROWS, XML_BYTES = 8192, 1 << 18


def xml_rows(stream, rows_each: int = XML_ROWS) -> Iterator[list[tuple]]:
    """Batches of (encounter, person, timestamp, i, j, code, name, unit, text) of a file, parsed as it is read: what is held
    is a batch, however many entries an encounter has. i numbers an encounter's entries, j an entry's events."""
    from xml.parsers import expat

    rows: list[tuple] = []
    path, texts = [], []
    encounter, person, time, i, j, event = -1, None, None, -1, -1, {}

    def opened(tag, attributes):
        nonlocal encounter, person, time, i, j, event
        path.append(tag)
        if tag == "encounter":
            encounter, person, i = encounter + 1, attributes.get("person"), -1
        elif path[-2:] == ["encounter", "entry"]:
            time, i, j = attributes.get("timestamp"), i + 1, -1
        elif path[-3:] == ["encounter", "entry", "event"]:
            j, event = j + 1, attributes
            texts.clear()

    def closed(tag):
        if path[-3:] == ["encounter", "entry", "event"]:
            rows.append((encounter, person, time, i, j, event.get("code"), event.get("name"), event.get("unit"), "".join(texts).strip() or None))
        path.pop()

    def told(text):
        if path[-1] == "event":
            texts.append(text)

    head = stream.read(XML_BYTES)
    declared = re.match(rb"\s*<\?xml[^>]*?\?>", head.removeprefix(b"\xef\xbb\xbf"))
    encoding = declared and re.search(rb"encoding\s*=\s*[\"']([^\"']+)", declared[0])
    parser = expat.ParserCreate(encoding[1].decode() if encoding else "utf-8")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, told
    parser.Parse(b"<files>")  # a file may hold several encounters without a root of their own
    data = head.removeprefix(b"\xef\xbb\xbf")[declared.end() if declared else 0 :]
    while data:
        parser.Parse(data)
        if len(rows) >= rows_each:
            yield rows[:]
            rows.clear()
        data = stream.read(XML_BYTES)
    parser.Parse(b"</files>", True)
    yield rows


def xml_events(spark: SparkSession, path: str) -> DataFrame:
    """encounter > entry(timestamp) > event, one row an event, numbered in document order; a file is one task's, which
    parses it as it reads. A file that is not well-formed is an error."""
    ship(spark)
    names = [part.split()[0] for part in XML_EVENT.split(", ")]

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub("^(file):/+", r"\1:///", file))
                with store.open_input_stream(at) as stream:
                    for rows in xml_rows(stream):
                        columns = list(zip(*rows)) or [()] * (len(names) - 1)
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip([[file] * len(rows), *columns], kinds)], names)

    rows = spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, XML_EVENT)
    doc = F.struct("file", F.lit(0).cast("bigint").alias("block"), F.col("encounter").alias("row")).alias("doc")
    return rows.select("person", F.try_to_timestamp("timestamp").cast("timestamp_ntz").alias("time"), "code", "description", "text_value", "unit", F.struct(doc, "i", "j").alias("doc_ord"))


def events_of_xml(xml: Column) -> Column:
    """Array of (time, code, value) of an XML text; entries in order."""
    col = lambda path: F.xpath(xml, F.lit(path))
    return F.arrays_zip(col("//event/../@timestamp").alias("time"), col("//event/@code").alias("code"), col("//event/text()").alias("value"))


def log_blocks(spark: SparkSession, path: str, header: str, value: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """(file, task, mean): a header line opens a block, the values after it belong to it. A long file's lines are spread
    over ranges of the parts that it is read in."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), file_place().alias("n"), "value")
    marked = lines.select("file", "n", F.nullif(F.regexp_extract("value", header, 1), F.lit("")).alias("h"), F.nullif(F.regexp_extract("value", value, 1), F.lit("")).try_cast("double").alias("v"))
    named = carried_last(marked, ["file"], [F.col("n.block"), F.col("n.row")], F.col("h"), "task", rows_each)
    return named.where("v IS NOT NULL AND task IS NOT NULL").groupBy("file", "task").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def result_files(spark: SparkSession, root: str, pattern: str = "*_results_*.csv") -> DataFrame:
    """Rows of every matching file below root, with the keys that its path holds: source/task/model/file."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("header", True).option("multiLine", True).option("escape", '"').csv(root)
    name = F.col("_metadata.file_path")
    part = lambda i: F.element_at(F.split(name, "/"), i)
    return df.select("*", part(-4).alias("source"), part(-3).alias("task"), part(-2).alias("model"), F.regexp_extract(part(-1), r"_results_(.+)\.csv$", 1).alias("experiment"))


def per_patient(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """{root}/*/{table}.parquet; columns are whatever the files have. With a schema no footers are read to find them out."""
    reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/*/{table}.parquet")


def looked_up(df: DataFrame, pairs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose (a, b) is among the pairs; one join instead of batches of IN lists."""
    return df.join(pairs.select(*on).distinct(), list(on), "left_semi")


def array_lookup(df: DataFrame, column: str, ids: Sequence, uid: str) -> DataFrame:
    """Rows with a listed id (within 64 bits) and a uid that is not blank."""
    sound = sorted({int(i) for i in ids if str(i).strip().lstrip("-").isdigit() and -(1 << 63) <= int(i) < 1 << 63})
    return df.where(F.col(column).cast("string").try_cast("bigint").isin(sound) & F.col(uid).isNotNull() & (F.trim(F.col(uid).cast("string")) != ""))


def existing(df: DataFrame, spark: SparkSession, folder: str, name: Column) -> DataFrame:
    """Rows whose file is in the folder: one listing, one semi-join."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("__file"))
    return df.join(listed.distinct(), name == F.col("__file"), "left_semi")


def volumes(spark: SparkSession, folder: str, pattern: str, decode, schema: str) -> DataFrame:
    """Binary files through an injected decoder (bytes, name) -> rows; a file at a time."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(list(decode(bytes(content), path.rsplit("/", 1)[-1])))

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(run, schema)


def volume_name(study: Column, series: Column) -> Column:
    return F.concat(study, F.lit("__"), series, F.lit(".nii.gz"))
