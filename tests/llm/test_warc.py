"""Archives round-trip, revisits point at the smallest id, and the dictionary travels in the file."""

import hashlib
import io
import struct

import zstandard

from ledgerline.llm import warc


def test_archives_round_trip(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "ü" * 5000, "<p>a</p>", "\r\n\r\n<html>", ""] + [f"<html><body>{'word ' * (i % 50)}{i}</body></html>" for i in range(200)]
    rows = [(i * 2, f"http://x.test/{i} \r\n evil" if i % 3 else None, h, "clash") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    uris = warc.write_archives(pages.repartition(3))
    got = {r.page_id: r for r in warc.read_archives(spark, uris, keep=True).collect()}
    bodies = [(h or "").encode() for h in html]
    assert len(got) == len(rows)
    for i, body in enumerate(bodies):
        first, r = 2 * bodies.index(body), got[2 * i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.sha1_base32(body))
        assert (r.record_type, r.refers_to) == (("response", None) if first == 2 * i else ("revisit", first))
        assert bytes(r.payload) == (body if r.record_type == "response" else b"")
    assert len(warc.sha1_base32(b"")) == 32 and hashlib.sha1(b"").digest()
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_short_payloads_can_stay_responses(spark):
    pages = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef")], "page_id long, html string")
    kinds = {r.page_id: r.record_type for r in warc.read_archives(spark, warc.write_archives(pages, least=3)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_repeated_and_null_page_ids_have_records_of_their_own(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b"), (1, "c"), (3, "c")]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(2)
    uris = warc.write_archives(pages)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, uris).collect()), key=str)
    want = [(1, "response", None)] * 3 + [(2, "revisit", 1)] * 2 + [(3, "revisit", 1), (None, "response", None), (None, "response", None), (None, "revisit", 1)]
    assert got == sorted(want, key=str)
    headers = []
    for uri in uris:
        with warc.open_file(uri) as f:
            headers += [h for h, _ in warc.read_archive(f)]
    ids = [h["WARC-Record-ID"] for h in headers]
    assert len(set(ids)) == len(ids) == len(rows) + len(uris)
    assert {h["WARC-Refers-To"] for h in headers if "WARC-Refers-To" in h} <= set(ids)


def test_each_record_is_a_frame_of_its_own(monkeypatch):
    monkeypatch.setattr(warc, "DICT_SAMPLE", 20_000)
    out = io.BytesIO()
    a = warc.Archive(out, 0)
    for i in range(300):
        a.add(warc.page_record(i, f"http://x.test/{i}", f"<html><body class='page'>{i} {'lorem ipsum ' * (i % 9)}</body></html>".encode(), "D", None, False))
    a.close()
    data = out.getvalue()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE and data[8:12] == b"\x37\xa4\x30\xec"
    for step in (1, 7, 1 << 20):
        assert [h.get("X-Page-ID") for h, _ in warc.read_archive(io.BytesIO(data), step)] == [None, *map(str, range(300))]
