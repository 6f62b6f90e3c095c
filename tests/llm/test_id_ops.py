"""Simple-8b files and packing against round trips and the tokenizers library."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import idfiles, packing
from ledgerline.llm.units import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
TEXTS = [None, "", "a", "Hello  world\n\n", "word " * 5000, "same", "same", "ü" * 700, "x y z " * 340] + [f"text {i} " * (i % 37) for i in range(120)]


def frame(spark, texts):
    return spark.createDataFrame([(i * 3, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n long")


@pytest.mark.parametrize("top", [1, 2, 200, 49408, 1 << 33, 1 << 63])
def test_pack_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 59, 4096, 4097, 20_000):
        ids = (rng.random(n) ** 4 * top).astype(np.uint64)
        ids[rng.random(n) < 0.3] = 0
        words, per_block, odd = idfiles.pack(ids)
        assert np.array_equal(idfiles.unpack(words, per_block, n, odd), ids)


def test_file_reads_any_range_and_escapes():
    rng = np.random.default_rng(3)
    counts = [0, 5, 9000, 1, 40_000, 3]
    ids = rng.integers(0, 1 << 62, sum(counts)).astype(np.uint64)
    out = io.BytesIO()
    w = idfiles.Writer(out, pending=5000)
    at = 0
    for d, n in enumerate(counts):
        w.add([d if d else None], ids[at : at + n], [n])
        at += n
    w.close()
    r = idfiles.Reader(pa.PythonFile(io.BytesIO(out.getvalue()), "r"))
    assert r.docs == [None, 1, 2, 3, 4, 5] and r.counts.tolist() == counts
    assert np.array_equal(r.ids(4000, 12345), ids[4000:12345])
    assert np.array_equal(np.concatenate([x for _, _, x in r.documents(most=6000)]), ids)


def test_written_ids_come_back(spark):
    tok = Tokenizer.from_file(WORD)
    files = idfiles.write_ids(frame(spark, TEXTS).repartition(5), WORD, end_id=2)
    got = {r.doc_id: r for r in idfiles.read_ids(spark, files, keep=True).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        want = tok.encode(t or "", add_special_tokens=False).ids + [2]
        r = got[i * 3]
        assert (r.start, r.n_tokens, r.ids) == (start, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert idfiles.read_ids(spark, idfiles.write_ids(frame(spark, []), WORD, 2)).count() == 0


def check_plan(counts):
    a = packing.Assignment(counts)
    filled = {}
    for length, n in counts.items():
        for rank in range(n):
            parts = list(a.pieces(length, rank))
            assert sum(p for p, _, _ in parts) == length
            for p, s, o in parts:
                filled.setdefault(s, []).append((o, p))
    total = 0
    for s, pieces in filled.items():
        at = 0
        for o, p in sorted(pieces):
            assert o == at
            at += p
        assert at <= 1024
        total += 1024 - at
    assert sorted(filled) == list(range(a.sequences))
    return total / (1024 * max(1, a.sequences))


def test_plans_fill_sequences():
    rng = random.Random(1)
    assert check_plan({rng.randint(1, 1023): rng.randint(1, 60) for _ in range(300)}) < 0.02
    for hot in (700, 520, 341, 513, 1023):
        assert check_plan({hot: 900, 40: 3}) < 0.02
    assert check_plan({}) == 0 and check_plan({5: 1}) > 0.9


def test_packed_pieces_hold_every_id_once(spark):
    tok = Tokenizer.from_file(BYTE)
    rows = packing.pack_documents(frame(spark, TEXTS).repartition(3), BYTE, end_id=0, keep=True).collect()
    sequences, docs = {}, {}
    for r in rows:
        assert r.length == len(r.ids) <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    for i, t in enumerate(TEXTS):
        own = sorted(docs[i * 3])
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for _, ids, _ in own for x in ids] == want and {n for _, _, n in own} == {len(want)}
        assert [s for s, _, _ in own] == np.cumsum([0] + [len(ids) for _, ids, _ in own])[:-1].tolist()
    assert packing.pack_documents(frame(spark, []), BYTE, 0).count() == 0


def test_padding_at_the_scale_of_many_documents():
    rng = random.Random(6)
    for counts in ({n: rng.randint(1, 2_000_000) for n in range(1, 1024)}, {700: 10**9, 40: 10**6}, {513: 10**8, 514: 3, 2: 10**7}, {rng.randint(300, 1023): 10**7 for _ in range(9)}):
        cuts, patterns = packing.plan(dict(counts))
        parts = {}
        for length, own in cuts.items():
            for n, pieces in own:
                assert sum(pieces) == length
                counts[length] -= n
                for x in pieces:
                    parts[x] = parts.get(x, 0) + n
        for x, n in parts.items():
            counts[x] = counts.get(x, 0) + n
        placed = {}
        for p, n in patterns:
            assert sum(p) <= 1024
            for x in p:
                placed[x] = placed.get(x, 0) + n
        assert placed == {k: v for k, v in counts.items() if v}
        total = sum(n for _, n in patterns)
        assert sum((1024 - sum(p)) * n for p, n in patterns) <= (packing.PADDING + len(patterns) / total) * 1024 * total


def test_null_and_repeated_ids(spark):
    rows = [(None, "b a"), (None, "a"), (4, "x y"), (4, "x y"), (4, None), (4, "later")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tok = Tokenizer.from_file(WORD)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    got = sorted(idfiles.read_ids(spark, idfiles.write_ids(docs, WORD, end_id=2), keep=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.ids) for r in got] == [(i, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in order]
    packed = packing.pack_documents(docs, BYTE, end_id=0, keep=True).collect()
    byte = Tokenizer.from_file(BYTE)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.ids) for r in packed], key=key) == sorted([(i, byte.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows], key=key)
