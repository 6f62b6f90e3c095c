"""WARC archives, compressed record by record with a Zstandard dictionary.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
Zstandard frame a record. A task builds its archive's dictionary from the first records it
archives (bounded by DICT_SAMPLE bytes), so an archive is read with nothing beside it. Each archive
starts with a warcinfo record. Of records with equal payloads the one with the smallest page id is
a response, the others are revisits that carry no payload.

No page is moved. The first of each group is found on (digest, id, place) rows with partial
aggregation and joined back to those rows, frequent payloads by broadcast; what it says of a file's
rows is noted beside it, and the pages are archived where they are read, an archive a task.

Payloads are equal if their SHA-1 is. Record ids are unique: a payload's first response has one of
page and payload, which revisits refer to; every other record's also names its archive and place in
it. Of rows that repeat the smallest page id with one payload, one is that first response.

Edge cases: null html is the empty payload, and empty payloads revisit each other; rows that repeat
a page id are records of their own, and with one payload all of them are responses if that id is the
smallest; null page ids come after all others, and their records refer to nothing; very long pages
are records like others; an empty table writes no archive and gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import join_skewed, marked, on_files, shared_dir, ship, utf8, written
from ledgerline.llm.files import new_file, open_file

SKIPPABLE = 0x184D2A5D
DICT_SIZE = 64 << 10
DICT_SAMPLE = 4 << 20
LEVEL = 3
#: Stands for a group without a page id.
NO_PAGE = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, *parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, (kind, *parts))))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, place: tuple = ()) -> bytes:
    """place: what tells the record from others of its page and payload; empty for the one that revisits refer to."""
    uri = "".join((url or "").split()) or None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id("page", page, digest, *place)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", None if page is None else str(page)), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers[3:3] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("page", first, digest)), ("X-Refers-To-Page", str(first))]
    return record(headers, http if revisit else http + payload)


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICT_SIZE, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_SIZE:]


class Archive:
    """Holds the first records until they suffice for a dictionary, then writes record by record."""

    def __init__(self, out, number: int):
        self.out, self.number, self.held, self.size, self.coder, self.records = out, number, [], 0, None, 0

    def add(self, rec: bytes) -> None:
        self.records += 1
        if self.coder is None:
            self.held.append(rec)
            self.size += len(rec)
            if self.size >= DICT_SAMPLE:
                self._start()
        else:
            self.out.write(self.coder.compress(rec))

    def _start(self) -> None:
        data = dictionary(self.held)
        self.out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True)
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", self.number)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC/1.1\r\n")
        for rec in [info, *self.held]:
            self.out.write(self.coder.compress(rec))
        self.held = []

    def close(self) -> None:
        if self.coder is None:
            self._start()


def read_archive(stream, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, decompressing frame by frame; memory is one record and one step."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    frame, made, rest = coder.decompressobj(), [], b""
    while True:
        data = rest or stream.read(step)
        if not data:
            break
        rest = b""
        made.append(frame.decompress(data))
        if frame.eof:
            rest = frame.unused_data
            yield parse(b"".join(made))
            frame, made = coder.decompressobj(), []
    if any(made):
        raise ValueError("the archive ends within a record")


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> list[str]:
    """Writes every page as a record; returns the archives' URIs (one row a task reaches the driver)."""
    spark = pages.sparkSession
    ship(spark)
    pages = on_files(pages)
    folder, notes = folder or shared_dir(spark, "warc"), shared_dir(spark, "warc-notes")
    page, html = F.col(id_col).cast("long").alias("page_id"), utf8(html_col).alias("html")
    rows = marked(pages).select("__file", "__row", page, F.unhex(F.sha1(html)).alias("digest"))
    place = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "__file", "__row"))
    verdict = written(rows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "warc-first")
    own = (F.col("page_id") == F.col("first.page_id")) & (F.col("__file") == F.col("first.__file")) & (F.col("__row") == F.col("first.__row"))
    told = join_skewed(rows, verdict, "digest", "n").select("__file", "__row", F.coalesce("first.page_id", F.lit(NO_PAGE)).alias("head"), F.coalesce(own, F.lit(False)).cast("long").alias("own"))
    name = lambda file: f"{notes}/{hashlib.md5(file.encode()).hexdigest()}.rows"

    def note(key, table):
        table = table.sort_by("__row")
        with new_file(name(key[0].as_py())) as out:
            out.write(np.stack([table[c].to_numpy() for c in ("__row", "head", "own")], axis=1).tobytes())
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    told.groupBy("__file").applyInArrow(note, "n long").agg(F.sum("n")).collect()  # one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = loaded = None
        for batch in batches:
            if made is None and batch.num_rows:
                number = TaskContext.get().partitionId()
                uri = f"{folder}/pages-{number:06d}.warc.zst"
                made = new_file(uri)
                archive = Archive(made.__enter__(), number)
            for page, link, html, file, row in zip(*(batch.column(i) for i in range(5))):
                if file.as_py() != loaded:
                    loaded = file.as_py()
                    with open_file(name(loaded)) as f:
                        known = np.frombuffer(f.read(), np.int64).reshape(-1, 3)
                _, head, first = known[np.searchsorted(known[:, 0], row.as_py())].tolist()
                payload, page, head = html.as_buffer().to_pybytes(), page.as_py(), None if head == NO_PAGE else head
                revisit = len(payload) >= least and head is not None and page != head
                archive.add(page_record(page, link.as_py(), payload, sha1_base32(payload), head, revisit, () if first else (number, archive.records)))
        if made is not None:
            archive.close()
            made.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([archive.records], pa.int64())})

    url = F.col(url_col) if url_col in pages.columns else F.lit(None)
    at = pages.metadataColumn("_metadata")
    dealt = pages.select(page, url.cast("string").alias("url"), html, at["file_path"].alias("file"), at["row_index"].alias("row"))
    return sorted(r.uri for r in dealt.mapInArrow(run, "uri string, records long").collect())


def read_archives(spark, uris: list[str], keep: bool = False) -> DataFrame:
    """Per page record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to; with keep also payload."""
    ship(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep
    if not uris:
        return spark.createDataFrame([], schema)
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * keep)

    def row(headers: dict[str, str], block: bytes) -> dict:
        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
        payload = block.partition(b"\r\n\r\n")[2]
        if headers["WARC-Type"] == "response":
            if len(payload) != size or sha1_base32(payload) != digest:
                raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
        page, first = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
        return {"page_id": None if page is None else int(page), "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": None if first is None else int(first), "payload": payload}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_file(uri) as stream:
                    out, size = [], 0
                    for headers, block in read_archive(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        out.append(row(headers, block))
                        size += 1 + len(block) * keep
                        if size >= (4 << 20 if keep else 2000):
                            yield pa.RecordBatch.from_pylist(out, kinds)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, kinds)

    return spark.createDataFrame([(u,) for u in uris], "uri string").repartition(len(uris)).mapInArrow(run, schema)
