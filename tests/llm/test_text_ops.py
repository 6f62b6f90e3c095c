"""Sketches, BPE and token counts against brute force and the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import bpe, fingerprints, tokencount, units
from ledgerline.llm.units import tokenizer_path

WORD = tokenizer_path("word_bpe_49k.json")
BYTE = tokenizer_path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "aaa aaaa", "Hello, it's 'S WORLD x  y\n\n z ", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> X", "E\u0301 I\u0307 A\u030a K\u0327", "ΑΣ Σ é é İ 日本 🙂 ՘   q", "x" * 20_000, "same words", "same words", "one two three four five six seven " * 400]
ALPHABET = "abcdefghiABC'’.,!? \n\t 　0123éßñλ日🙂́ "


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")


def noise(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET[: rng.randint(2, len(ALPHABET))]) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_backtracking_equals_the_library(spark):
    texts = TEXTS + noise(400)
    tok = Tokenizer.from_file(WORD)
    for r in bpe.encode_decode(frame(spark, texts), WORD, keep=True).collect():
        want = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == tok.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(frame(spark, []), WORD).count() == 0


def test_backtracking_on_the_other_vocabulary():
    own, tok = bpe.BacktrackingBpe(BYTE), Tokenizer.from_file(BYTE)
    pieces = ["a" * 37, "abab" * 9, "entertainment", "zzzzzzzzzz", "The", "1234567890" * 3]
    for p, got in zip(pieces, own.encode_pieces(pieces)):
        assert own.ids[got].tolist() == tok.encode(p).ids


@pytest.mark.parametrize("path,kind", [(WORD, "folded"), (BYTE, "spaced")])
def test_unit_encoder_equals_the_library(path, kind):
    enc, tok = units.library_encoder(path, kind), Tokenizer.from_file(path)
    enc.most_units = 300  # the table is emptied on the way
    texts = [t or "" for t in TEXTS] + noise(1500, 2)
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        ids, counts = enc.encode(pa.array([t.encode() for t in part], pa.binary()))
        for t, n, e in zip(part, counts, np.cumsum(counts)):
            assert ids[e - n : e].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_fingerprints_of_edited_and_next_documents(spark):
    words = [f"w{i}" for i in range(900)]
    texts = [t or "" for t in TEXTS] + [" ".join(words), " ".join(words[:450]), " ".join(words[450:])]
    got = {r.doc_id: r for r in fingerprints.with_next(frame(spark, TEXTS + texts[-3:])).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        after, half, r = texts[(i + 1) % len(texts)], len(t) // 2, got[i]
        edited = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (fingerprints.sketch(x.encode()) for x in (t, edited, after))
        assert r.fingerprint == fingerprints.packed(a) and r.edited_fingerprint == fingerprints.packed(b)
        assert r.near_edited == fingerprints.likeness(a, b) and r.near_next == fingerprints.likeness(a, c)
        assert np.array_equal(fingerprints.unpacked(r.fingerprint), a)
    same = texts.index("same words")
    assert got[same].fingerprint == got[same + 1].fingerprint and got[same].near_next == 1.0
    whole, part = got[len(TEXTS)], got[len(TEXTS) + 1]
    assert abs(whole.contained_next - 0.5) < 0.15 and fingerprints.containment(fingerprints.unpacked(part.fingerprint), fingerprints.unpacked(whole.fingerprint)) == 1.0
    assert fingerprints.with_next(frame(spark, [])).count() == 0
    assert fingerprints.with_next(frame(spark, ["only one"])).first().near_next == 1.0


def test_next_document_crosses_ranges_and_nulls(spark):
    rows = [(i * 7 % 1000 if i != 3 else None, f"text {i}") for i in range(500)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()


def test_merged_sketch_is_the_sketch_of_all_shingles():
    a, b = (" ".join(f"{c}{i}" for i in range(300)).encode() for c in "ab")
    both = np.unique(np.concatenate([fingerprints.shingles(a), fingerprints.shingles(b)]))
    assert np.array_equal(fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b)), both[: max(64, int((both < np.uint64(1 << 61)).sum()))])


def exact(a, b):
    """Likeness and containment over sets of five-word shingles, written out."""
    sets = []
    for t in (a, b):
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]), len(sets[0] & sets[1]) / len(sets[0])


@pytest.mark.parametrize("size,most", [(1, 0), (4, 0), (30, 0), (68, 0), (150, 0.2), (500, 0.2), (3000, 0.12)])
def test_likeness_and_containment_against_sets_of_shingles(size, most):
    rng = random.Random(size)
    for share in (0.0, 0.3, 0.7, 1.0):
        a = [f"w{rng.randrange(3 * size)}" for _ in range(size)]
        cut = int(share * size)
        b = a[:cut] + [f"v{rng.randrange(3 * size)}" for _ in range(size - cut)]
        for x, y in ((a, b), (a, a[: max(1, size // 3)]), (a, a + b)):
            x, y = " ".join(x), " ".join(y)
            likely, inside = exact(x, y)
            sx, sy = fingerprints.sketch(x.encode()), fingerprints.sketch(y.encode())
            both_short = max(len(x.split()), len(y.split())) <= 67
            assert fingerprints.likeness(sx, sy) == pytest.approx(likely, abs=1e-12 if both_short else max(most, 0.25))
            assert fingerprints.containment(sx, sy) == pytest.approx(inside, abs=1e-12 if both_short else max(most, 0.35))


def brute_split(model, token):
    longest = max(map(len, model.score))
    best = [(0, 0)] + [None] * len(token)
    for e in range(1, len(token) + 1):
        options = [(best[s][0] - model.score[token[s:e]], best[s][1] + 1) for s in range(max(0, e - longest), e) if token[s:e] in model.score]
        best[e] = min([*options, (best[e - 1][0] - model.unknown, best[e - 1][1] + 1)])
    return best[-1][1], -best[-1][0]


def test_token_counts_equal_plain_dynamic_programming(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    model = tokencount.Unigram(path)
    texts = TEXTS + noise(300, 4)
    for r in tokencount.token_counts(frame(spark, texts), path).collect():
        found = [brute_split(model, tokencount.SPACE + w.decode()) for w in (texts[r.doc_id] or "").encode().split()]
        assert (r.n_pretokens, r.n_tokens) == (len(found), sum(f[0] for f in found))
        assert r.score == sum(f[1] for f in found) / 1e6


def test_trie_scores_a_shared_prefix_once():
    model = tokencount.Unigram(tokenizer_path("piece_bpe_32k.model"))
    trie = tokencount.PrefixTrie(model)
    a = trie.insert("▁international")
    nodes = len(trie)
    b = trie.insert("▁inter")
    assert len(trie) == nodes and trie.insert("▁international", 2) == a
    assert trie.count == {a: 3, b: 1}


@pytest.mark.parametrize("path,kind", [(WORD, "folded"), (BYTE, "spaced")])
def test_every_latin_character_is_split_as_the_library_splits_it(path, kind):
    tok, enc = Tokenizer.from_file(path), units.library_encoder(path, kind)
    chars = [chr(i) for i in range(1, 0x260) if chr(i) not in " \t\n\r\f\v"]
    texts = [t for c in chars for t in (c, f"x{c}y", f"x{c}", f"{c}9", f".{c}!", f"'{c}", f"{c}́")]
    if kind == "spaced":
        texts += [f" {t}" for t in texts] + [f"\n  {t}" for t in texts]
    ids, counts = enc.encode(pa.array([t.encode() for t in texts], pa.binary()))
    for t, n, e in zip(texts, counts, np.cumsum(counts)):
        assert ids[e - n : e].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_files_that_ask_for_another_splitter_are_refused(tmp_path):
    import json

    spec = json.load(open(BYTE))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="another normaliser"):
        units.LibraryUnits(str(other), "spaced")
    with pytest.raises(ValueError, match="another normaliser"):
        bpe.WordBpe(BYTE)


def test_terminal_counts_add_up_to_the_totals_of_documents(spark, monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = TEXTS + noise(200, 6) * 3
    docs = frame(spark, texts).repartition(5)
    want = {}
    for t in texts:
        for w in (t or "").encode().split():
            want[w.decode()] = want.get(w.decode(), 0) + 1
    got = tokencount.terminal_counts(docs, path).collect()
    assert {r.pretoken: r.n for r in got} == want
    assert sum(r.n * r.pieces for r in got) == sum(r.n_tokens for r in tokencount.token_counts(docs, path).collect())


def test_token_counts_of_an_empty_table_and_null_ids(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    assert tokencount.token_counts(frame(spark, []), path).collect() == [] == tokencount.terminal_counts(frame(spark, []), path).collect()
    rows = spark.createDataFrame([(None, "a b", 1), (3, None, 2), (3, "a b", 3), (3, "a b", 3)], "doc_id long, text string, n_tokens int")
    assert sorted((r.doc_id or -1, r.n_pretokens) for r in tokencount.token_counts(rows, path).collect()) == [(-1, 2), (3, 0), (3, 2), (3, 2)]


def test_bpe_of_null_and_repeated_ids_and_an_empty_table(spark):
    rows = spark.createDataFrame([(None, "b a", "x"), (3, None, "y"), (3, "b a", "z"), (3, "b a", "z")], "doc_id long, text string, ids string")
    got = bpe.encode_decode(rows, WORD).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 2), (3, 0), (3, 2), (3, 2)]
    assert bpe.encode_decode(frame(spark, []), WORD).count() == 0


def test_fingerprints_of_one_id_with_several_texts(spark):
    rows = spark.createDataFrame([(1, "b b b"), (1, "a a a"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_chars, r.near_next) for r in fingerprints.with_next(rows).collect())
    assert got == [(1, 5, 0.0), (1, 5, 0.0), (2, 0, 0.0)]
