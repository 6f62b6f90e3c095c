"""The pipeline's stages against brute force on a small table with planted cases."""

import random
import re

import numpy as np

import corpus_pipeline
from ledgerline.llm import common, simhash

SYLLABLES = {"en": "the and ing that is of er ou".split(), "de": "der ung und sch ein ich ü ß".split()}


def words(lang, rng, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    texts = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        texts.append((" ".join(words(lang, rng, rng.randint(60, 200))), lang))
    passage = words("en", rng, 55)
    texts[3] = (" ".join(texts[3][0].split() + passage), "en")
    texts[9] = (" ".join(texts[9][0].split()[:30] + passage + texts[9][0].split()[30:]), "en")
    long = texts[5][0].split() * 1
    near = long[:]
    near[len(near) // 2] = "changed"
    rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, (t, lang) in enumerate(texts)]
    rows += [(100, texts[0][0], "de", "s0", 0), (101, texts[0][0].replace(" ", "  \n"), "de", "s0", 0), (102, " ".join(near), "en", "s1", 0)]
    rows += [(103, "123 456 !!!", "en", "s1", 0), (104, None, None, None, None), (105, "", "de", "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        steps[name] = docs
    for name in list(steps)[:-1]:
        assert steps[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r.doc_id for r in d.select("doc_id").collect()} for name, d in steps.items()}
    everything = {r[0] for r in rows}
    assert ids["language_id"] == everything - {103, 104, 105}
    assert ids["exact_dedup"] == ids["language_id"] - {100, 101}
    # Near duplicates by brute force.
    left = sorted(ids["exact_dedup"])
    fps = [simhash.fingerprint(dict((r[0], r[1]) for r in rows)[i].encode()) for i in left]
    comp = list(range(len(left)))
    for _ in left:
        comp = [min(comp[j] for j in range(len(left)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(left))]
    assert ids["simhash"] == {left[c] for c in comp}
    got = {r.doc_id: r for r in steps["substrings"].collect()}
    assert " ".join(passage) in got[3].text and " ".join(passage) not in got[9].text
    assert got[9].text == " ".join(texts[9][0].split()[:30] + texts[9][0].split()[85:]) and got[9].n_chars == len(got[9].text)
    before = {r.doc_id: r for r in steps["simhash"].collect()}
    assert all(got[i].text == before[i].text for i in got if i not in (9, 102))
    packed = steps["packing"].collect()
    assert {r.doc_id for r in packed} == set(got)
    total = {i: sum(r.length for r in packed if r.doc_id == i) for i in got}
    assert all(r.doc_tokens == total[r.doc_id] for r in packed)
    made = len(common.made(spark))
    rows_of_run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(common.made(spark)) == made + 1  # only the result stays
    assert sorted(rows_of_run) == sorted(packed) and re and np


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_repeat_ids_and_null_ids_are_rows_of_their_own(spark, tmp_path):
    rng = random.Random(4)
    made = [" ".join(words("en" if i % 2 else "de", rng, 90)) for i in range(40)]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(made)]
    rows += [(5, made[3], "en", "s", 0), (None, made[3], "en", "s", 0), (None, " ".join(words("de", rng, 80)), "de", None, None), (7, made[7], "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = corpus_pipeline.written(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert got == [(None, rows[42][1])] + [(i, t) for i, t in enumerate(made)]


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
