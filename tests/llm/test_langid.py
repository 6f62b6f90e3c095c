"""The byte network: its gradients, its accuracy on held-out text, and odd rows."""

import random
import zlib

import numpy as np

from ledgerline.llm import langid

SYLLABLES = {"en": "the and ing that is of er ou".split(), "de": "der ung und sch ein ich ü ß".split(), "fr": "le de eau oi é è que ment".split()}


def text(lang, rng, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(text(lang, rng, rng.randint(5, 120)), lang) for lang in [rng.choice("en de fr".split()) for _ in range(n)]]


def test_gradients_match_differences():
    net = langid.ByteNet.fresh(["a", "b", "c"])
    for p in net.params():
        p[...] = p.astype(np.float32)
    rng = np.random.default_rng(2)
    windows, labels = rng.integers(0, 256, (5, 40)).astype(np.uint8), rng.integers(0, 3, 5)
    grads, _ = langid.gradients(net, windows, labels)
    for p, g in zip(net.params(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, eps = p[i], 1e-2
        p[i] = was + eps
        _, up = langid.gradients(net, windows, labels)
        p[i] = was - eps
        _, down = langid.gradients(net, windows, labels)
        p[i] = was
        assert abs((up - down) / (2 * eps) - g[i]) < 0.1 * abs(g[i]) + 2e-3


def test_held_out_accuracy_and_odd_rows(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate(corpus(600))]
    odd = [(1000, None, "en", "x"), (1001, "", "de", "x"), (1002, "123 !? 456", "en", "x"), (1003, text("de", random.Random(5), 30_000), None, "x"), (1004, rows[0][1], None, "x"), (1004, rows[0][1], None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = langid.train_and_identify(docs).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    tested = [(by_id[i].lang_pred, lang) for i, _, lang, _ in rows if by_id[i].held_out]
    assert len(tested) > 60 and np.mean([a == b for a, b in tested]) > 0.95
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[1003].lang_pred == "de" and (by_id[1004].lang_pred, by_id[1004].score) == (by_id[0].lang_pred, by_id[0].score)
    assert langid.train_and_identify(docs.limit(0)).count() == 0


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 1000):
        data = bytes(random.Random(n).randrange(97, 123) for _ in range(n))
        w = langid.windows_of(data)
        assert w.shape[1] == langid.WINDOW
        if n > langid.WINDOW:
            assert w[:-1].tobytes() == data[: (len(w) - 1) * langid.WINDOW] and w[-1].tobytes() == data[-langid.WINDOW :]


def test_model_ignores_row_order():
    s = [([t.encode()[:256], t.encode()[-256:]], lang) for t, lang in corpus(80)]
    a, b = langid.fit(s, steps=3), langid.fit(s[::-1], steps=3)
    assert all(np.array_equal(x, y) for x, y in zip(a.params(), b.params()))


def test_training_windows_come_from_the_whole_text(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=128_000))
    docs = spark.createDataFrame([(i, long, "en") for i in range(40)] + [(100, "short", "en"), (101, None, "en"), (102, "x", None)], "doc_id long, text string, lang string")
    rows = langid.training_rows(docs)
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in [*range(40), 100]) and all(len(w) == langid.DRAWS for w, _ in rows)
    assert {w for own, _ in rows for w in own if len(w) < 256} <= {b"short"}
    places = [long.encode().index(w) / len(long) for own, _ in rows for w in own if len(w) == 256]
    assert {int(10 * p) for p in places} == set(range(10))
    assert len(langid.training_rows(docs, most=7)) == 7


def plain_score(net, data):
    """One text through the network, an element at a time."""
    data = [32 if 9 <= b <= 13 else 48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in data]
    size = langid.WINDOW
    cuts = [data + [32] * (size - len(data))] if len(data) <= size else [data[i : i + size] for i in range(0, len(data) - size, size)] + [data[-size:]]
    total, weight = [0.0] * len(net.classes), 0.0
    for window in cuts:
        hidden = []
        for w, f, bias in zip(langid.WIDTHS, net.filters, net.filter_bias):
            for k in range(f.shape[1]):
                sums = [sum(float(net.embed[window[i + j]][e]) * float(f[j * langid.EMBED + e][k]) for j in range(w) for e in range(langid.EMBED)) for i in range(size - w + 1)]
                hidden.append(max(0.0, max(sums) + float(bias[k])))
        z = [sum(h * float(net.dense[i][c]) for i, h in enumerate(hidden)) + float(net.bias[c]) for c in range(len(net.classes))]
        p = np.exp(np.array(z) - max(z))
        letters = sum(97 <= b <= 122 or b >= 128 for b in window) + 1e-3
        total = [t + letters * x for t, x in zip(total, p / p.sum())]
        weight += letters
    return [t / weight for t in total]


def test_prediction_equals_a_plain_forward_pass():
    net = langid.ByteNet.fresh(["de", "en", "fr"], seed=3)
    texts = [b"Ab 9\t!", "\u00fcber ".encode() * 70, b"x" * 256, b"word " * 103]
    lang, score = langid.predict(net, texts)
    for t, got, s in zip(texts, lang, score):
        want = plain_score(net, t)
        assert got == net.classes[int(np.argmax(want))] and abs(s - max(want)) < 1e-5


def test_the_query_learns_the_languages_of_documents(spark):
    from ledgerline.llm.queries import op7_language_id

    got = {r.doc_id: r for r in op7_language_id(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang", "text").collect()
    tested = [got[r.doc_id].lang_pred == r.lang for r in docs if got[r.doc_id].held_out and got[r.doc_id].lang_pred != "und"]
    assert len(tested) > 100 and np.mean(tested) >= 0.97


def test_keeping_what_is_identified(spark):
    rows = [(i, t, lang, i) for i, (t, lang) in enumerate(corpus(120))] + [(None, "the and ing that", "en", 1007), (5, None, "en", 1008), (5, "12 34", "en", 1009)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int").repartition(3)
    net = langid.fit(langid.training_rows(docs))
    kept = langid.keep_identified(docs, net, 0.3)
    assert kept.schema == docs.schema
    ids = [r.lang_pred for r in kept.collect()]
    assert 1007 in ids and not {1008, 1009} & {*ids} and len(ids) >= 115
    assert langid.keep_identified(docs.limit(0), net, 0.3).count() == 0
