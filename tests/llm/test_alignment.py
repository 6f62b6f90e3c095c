"""Alignment of two tokenizers against a plain version over the libraries."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerline.llm import alignment
from ledgerline.llm.units import byte_alphabet, tokenizer_path
from tests.llm.test_text_ops import TEXTS, noise

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
MORE = ["a", " ", "  ", "x \n y\n\n\nz ", "\n", "\n\n a", "<s>hi</s><0x41><unk>", "x▁y", "\x00a\tb\r\n", "日本語 テキスト", "a" * 700, "tail  ", "ﬁ ﬂ", "é 　  x", "don't  it's <|endoftext|>"]


def plain(texts):
    """Rows by the libraries and loops."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_alphabet())}
    rows, pairs = [], Counter()
    for text in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": [], "text": ""}
        rows.append(row)
        if not text:
            continue
        want = (" " + text).encode()
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        bytes_a = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            continue
        ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            row["links"].append((a[k - 1], b[m - 1]))
            i, j = k, m
        row |= {"n_a": len(a), "n_b": len(b), "n_groups": len(groups), "text": ";".join(groups)}
        pairs.update(row["links"])
    most = {}
    for (_, y), n in pairs.items():
        most[y] = max(most.get(y, 0), n)
    for row in rows:
        row |= {"n_links": len(row["links"]), "n_best": sum(pairs[p] == most[p[1]] for p in row["links"]), "count_sum": sum(pairs[p] for p in row["links"])}
    return rows


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 5, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, chunk string")


@pytest.mark.parametrize("sizes", [{}, {"limit": 300, "long": 40}])
def test_equals_the_plain_version(spark, sizes):
    texts = TEXTS + MORE + noise(300, 4) + ["one two  three\nfour five, six.\n\n" * 30 + "end"]
    got = {r.doc_id: r for r in alignment.align_documents(frame(spark, texts).repartition(3), A, B, keep=True, **sizes).collect()}
    want = plain(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (w["n_a"], w["n_b"], w["n_groups"], w["n_links"], w["text"]), (i, texts[i])
        assert (r.n_best, r.count_sum) == (w["n_best"], w["count_sum"])
        assert r.groups_sha256 == (hashlib.sha256(w["text"].encode()).hexdigest() if w["text"] else "")


def test_texts_that_do_not_come_back_have_no_tokens(spark):
    rows = alignment.align_documents(frame(spark, ["x▁y", None, "", "plain words", "plain words"]), A, B).orderBy("doc_id").collect()
    assert [r.n_a + r.n_b + r.n_groups + r.n_links + r.n_best + r.count_sum for r in rows[:3]] == [0, 0, 0]
    assert [r.groups_sha256 for r in rows[:3]] == ["", "", ""] and rows[3][1:] == rows[4][1:] and rows[3].n_best == rows[3].n_links > 0


def test_empty_table_and_null_ids(spark):
    assert alignment.align_documents(frame(spark, []), A, B).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = alignment.align_documents(docs, A, B).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"] and len({r[1:] for r in rows}) == 1


def test_union_find_gives_least_nodes():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        u, v = rng.integers(0, n, (2, int(rng.integers(0, 60))))
        seen = list(range(n))
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist()):
                seen[a] = seen[b] = min(seen[a], seen[b])
        assert alignment.components(u, v, n).tolist() == seen


def test_units_of_a_piece_vocabulary_equal_whole_texts():
    units = alignment.pieces(B)
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    texts = [t for t in noise(2000, 8) + MORE if t and "▁" not in t]  # that character never comes back
    ids, counts = units.encode(pa.array([(" " + t).encode() for t in texts]))
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == sp.encode(t), t
        at += n
