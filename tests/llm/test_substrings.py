"""The FM-index against plain search, and substring dedup against a brute-force version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import substrings
from ledgerline.llm.fmindex import FmIndex


def plain(text, p):
    return [i for i in range(len(text) - len(p) + 1) if np.array_equal(text[i : i + len(p)], p)]


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5, 8, 20])
@pytest.mark.parametrize("top", [1, 2, 5, 300])
def test_backward_search_and_matching_statistics_of_foreign_documents(top, depth):
    rng = np.random.default_rng(depth)
    docs = [rng.integers(1, top + 1, rng.integers(0, 60)) for _ in range(20)]
    text = np.concatenate([np.append(d, 0) for d in docs])
    index = FmIndex(text, depth)
    for _ in range(40):
        at = rng.integers(0, len(text))
        p = text[at : at + rng.integers(1, depth + 1)]
        if 0 not in p:
            low, high = index.find(p)
            assert high - low == len(plain(text, p))
    assert index.find(np.array([top + 1])) == (0, 0)
    # Documents that are not in the index: parts of its own, with words between that it lacks.
    others = [np.concatenate([rng.integers(1, top + 3, rng.integers(0, 9)), docs[rng.integers(20)][rng.integers(0, 5) :], rng.integers(1, top + 3, 3)]) for _ in range(15)]
    stream = np.concatenate([np.append(d, 0) for d in others])
    ends = np.flatnonzero(stream == 0)
    begins = ends - np.array([len(d) for d in others])
    lengths, lows = index.matching_statistics(stream, begins, ends)
    spaced = f" {' '.join(map(str, text))} "
    for b, e in zip(begins, ends):
        for p in range(b, e):
            want = 0
            while want < depth and p + want < e and f" {' '.join(map(str, stream[p : p + want + 1]))} " in spaced:
                want += 1
            assert lengths[p] == want
            if want == depth:
                assert index.first_place(lows[p : p + 1])[0] == plain(text, stream[p : p + depth])[0]


def test_minimizers_are_chosen_alike_whatever_the_length():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    g[::7] = (np.uint64(5) << np.uint64(24)) + rng.integers(0, 1 << 20, len(g[::7])).astype(np.uint64)  # equal in the bits that count
    want = [min(range(i, i + 15), key=lambda j: (int(g[j]) >> 24, j)) for i in range(len(g) - 14)]
    for bits in (5, 6, 9, 22):
        assert substrings.least_runs(g, 15, bits).tolist() == want


def shard(rows):
    """Segments (m, key, mark, a, words) as a block."""
    rows = sorted(rows)
    order, leading = substrings.leaders_first(np.array([r[0] for r in rows]))
    rows = [rows[i] for i in order]
    return substrings.block_of(*(np.array([r[i] for r in rows], np.int64) for i in range(4)), pa.array([" ".join(r[4]).encode() for r in rows], pa.binary())), rows, leading


@pytest.mark.parametrize("seed", range(6))
def test_a_shard_removes_what_starts_earlier(seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(30)}" for _ in range(80)]
    rows = []
    for k in range(60):
        at, n = rng.randrange(40), rng.randint(4, 30)
        words = base[at : at + n]
        if rng.random() < 0.5:
            words[rng.randrange(n)] = "new"
        rows.append((rng.randrange(3), rng.randrange(20), rng.randrange(2), 100 * k, words))
    block, rows, leading = shard(rows)
    got = set(substrings.removed_windows(block, leading, 4).tolist())
    first = {}
    for m, key, mark, a, words in rows:
        for i in range(len(words) - 3):
            first[m, *words[i : i + 4]] = min(first.get((m, *words[i : i + 4]), (99,)), (key, mark, a + i))
    # Windows of different minimizers differ in words; here they are kept apart by comparing within one minimizer.
    want = {int(b) + i for b, (m, key, mark, a, words) in zip(block.begins, rows) for i in range(len(words) - 3) if min(v for k, v in first.items() if k[1:] == tuple(words[i : i + 4])) < (key, mark, a + i)}
    within = {int(b) + i for b, (m, key, mark, a, words) in zip(block.begins, rows) for i in range(len(words) - 3) if first[m, *words[i : i + 4]] < (key, mark, a + i)}
    assert within <= got <= want


def brute(rows, window):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t in rows}
    first, out = {}, {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    make = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    shared = [make(rng.randint(15, 70)) for _ in range(6)]
    texts = [None, "", "one two", "Ge " * 300, " ".join(make(19)), " ".join(make(20) * 3), "a b " * 400, "\t".join(make(25))]
    for _ in range(n):
        t = make(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            t[rng.randint(0, len(t)) :] = s[rng.randint(0, 5) : len(s) - rng.randint(0, 5)] + make(rng.randint(0, 30))
        texts.append(" ".join(t))
    return texts + texts[-5:] + [" ".join(shared[0])] * 20


@pytest.mark.parametrize("hot,block,held", [(substrings.HOT, substrings.BLOCK_BYTES, substrings.HELD_BYTES), (30, 600, 3000), (300, 1, 1)])
def test_matches_brute_force(spark, monkeypatch, hot, block, held):
    monkeypatch.setattr(substrings._ranges, "__defaults__", (block,))
    monkeypatch.setattr(substrings._cut, "__defaults__", (held,))
    rows = list(enumerate(corpus(hot)))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, content string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, hot=hot).collect()}
    assert got == brute(rows, substrings.WINDOW)


def test_few_words_repeat_themselves(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for i in range(15)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=8).collect()}
    assert got == brute(rows, 8)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (5, "other " + text), (7, text)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 30, 0), (5, 30, 30), (5, 30, 30), (5, 31, 30), (7, 30, 30)]
    alone = substrings.remove_repeats(spark.createDataFrame(rows[:2], "doc_id long, text string"), keep=True).collect()
    assert [r.n_removed for r in alone] == [0, 0] and alone[0].kept is None
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("window", [255, 256, 300])
def test_long_windows(spark, window):
    rng = random.Random(window)
    words = [f"w{rng.randrange(900)}" for _ in range(400)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words) + " y"), (3, " ".join(words[:window])), (4, " ".join(words[: window - 1])), (5, " ".join(words[50:320]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()}
    assert got == brute(rows, window) and got[2][1] == 400 and got[3][1] == window


@pytest.mark.parametrize("block,hot", [(substrings.BLOCK_BYTES, substrings.HOT), (200, substrings.HOT), (200, 3)])
def test_foreign_documents_report_their_intervals(spark, block, hot):
    window = 6
    against, docs = corpus(3, 40, 60), corpus(4, 40, 60)
    known = set()
    for t in against:
        w = (t or "").split()
        known |= {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}
    want = set()
    for i, t in enumerate(docs):
        w = (t or "").split()
        starts = [j for j in range(len(w) - window + 1) if tuple(w[j : j + window]) in known]
        for j in starts:
            if j - 1 not in starts:
                end = j
                while end + 1 in starts:
                    end += 1
                want.add((i, j, end + window))
    table = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = substrings.matching_intervals(table(docs), table(against), window=window, block_bytes=block, hot=hot)
    assert {(r.doc_id, r.f, r.t) for r in got.collect()} == want and want
    assert substrings.matching_intervals(table([]), table(against), window=window).count() == 0 == substrings.matching_intervals(table(docs), table([]), window=window).count()


def test_words_are_joined_without_a_list():
    for text in (b"", b" ", b"a", b" a\n\tbc  d", b"x y ", "\u00fc  \u00a0 b".encode(), b"\x1c a"):
        joint, ends = substrings.single_spaced(text)
        words = re.findall(rb"[^\x20\x09-\x0D]+", text)
        assert joint.tobytes() == b"".join(w + b" " for w in words)
        assert ends.tolist() == (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
