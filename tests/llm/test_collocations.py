"""Collocations against brute force, and exact arithmetic."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import collocations


def brute(rows, least, longest=5, top=2000):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in own.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in own.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["New", "york", "new", "York", "a", "the", "é", "É", " x", "日本", "e-mail", "of", "the", "the"]
    phrases = ["new york city hall is", "Rio de Janeiro", "the the the the the the", "of the"]
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(0, 40)):
            t.append(rng.choice(phrases) if rng.random() < 0.3 else rng.choice(words))
            t.append(rng.choice([" ", "  ", "\t", " ", ", ", ". ", "\n", "!", "\r\n", " : "]))
        out.append((rng.choice(["en", "en", "fr", None, ""]), "".join(t)))
    return out + [(None, None), ("en", None), ("en", ""), ("en", " .,; \n"), ("xx", "only once")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "clash", 5) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int")


@pytest.mark.parametrize("least,most,parts", [(8, collocations.CHUNK_WORDS, 3), (3, 50, 5), (40, 500, 1)])
def test_equals_brute_force(spark, least, most, parts):
    rows = corpus(least)
    got = sorted(map(tuple, collocations.collocations(frame(spark, rows).repartition(parts), least, most=most).collect()))
    assert got == brute(rows, least) and got


def test_first_rows_of_each_language(spark):
    rows = corpus(1)
    got = sorted(map(tuple, collocations.collocations(frame(spark, rows), 4, top=3).collect()))
    assert got == brute(rows, 4, top=3)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), 4, longest=3).collect())) == brute(rows, 4, longest=3)


def test_nothing_frequent_and_empty_tables(spark):
    for rows in ([], [("en", "a b c")], [(None, None)]):
        assert collocations.collocations(frame(spark, rows)).count() == 0
    assert collocations.collocations(frame(spark, [("en", "a. b, c\n" * 200)])).count() == 0  # words only, no pairs


def test_products_past_64_bits(spark):
    """The score of the plan's own expression, at counts that no small corpus has."""
    counts = [(3 * 10**14, 5 * 10**15, 10**15 + 1, 7 * 10**14), (10**9, 10**12 + 7, 10**9, 10**10), (100, 10**16 - 1, 100, 100)]
    df = spark.createDataFrame(counts, "a long, words long, l long, r long").selectExpr("*", "array(l) AS heads", "array(r) AS tails")
    from pyspark.sql import functions as F

    got = [r.s for r in df.select(F.expr(f"transform(array(0), i -> {collocations.SCORE})[0]").alias("s")).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in counts]
