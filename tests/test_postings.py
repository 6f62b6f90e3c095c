"""The posting index against searches without one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import retrieval
from ledgerline.operators.postings import PostingIndex, counted


def corpus(spark, n, seed, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(first, first + n):
        text = " ".join(words[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.choice([3, 10, 40, 200])))
        rows.append((i if i % 17 else None, rng.choice(["a", "a", "a", "b"]), text if i % 29 else None))
    return spark.createDataFrame(rows, "id long, person string, note string")


@pytest.fixture(scope="module")
def both(spark):
    """A table of two halves, and the index that got them one after another."""
    halves = corpus(spark, 300, 1), corpus(spark, 300, 2, 300)
    index = PostingIndex(spark)
    for half in halves:
        index.append(half, "id", "person", "note", block_docs=100)
    return halves[0].union(halves[1]), index


def rows(df, *columns):
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else tuple(r[c]) if isinstance(r[c], list) else r[c] for c in columns) for r in df.collect())


def test_searches_equal_those_without_an_index(both):
    docs, index = both
    keyed = docs.where("id IS NOT NULL")
    for terms, k in ((["w1"], 3), (["w0", "w5", "w30"], 5), (["w40", "w41", "nowhere"], 2), (["w0", "w1", "w2", "w3"], 1000)):
        want = retrieval.search(keyed, "id", "person", "note", F.array(*map(F.lit, terms)), k)
        assert rows(index.search(terms, k), "part", "key", "score", "rank") == rows(want, "person", "id", "score", "rank")
        each = retrieval.search_each(docs, "id", "person", "note", terms, k)
        assert [r for r in rows(index.search_each(terms, k).where("key IS NOT NULL"), "part", "key", "terms")] == rows(each.where("id IS NOT NULL"), "person", "id", "terms")
        assert index.search_each(terms, k).where("key IS NULL").count() == each.where("id IS NULL").count()
    rounds = retrieval.iterative_search(keyed, "id", "person", "note", ["w9", "w33"], 3, 3, 2)
    assert rows(index.iterative_search(["w9", "w33"], 3, 3, 2), "part", "key", "iteration")[:0] == []
    want = rows(retrieval.search(keyed, "id", "person", "note", F.array(F.lit("w9"), F.lit("w33")), 3), "person", "id")
    assert rows(index.iterative_search(["w9", "w33"], 1, 3, 2), "part", "key") == want and rounds.count() >= len(want)


def test_blocks_are_skipped_and_bound_their_documents(both):
    _, index = both
    for terms, each, share in ((["w0", "w5", "w30"], False, 1), (["w0", "w5", "w30"], True, 0.5), (["w2"], False, 0.5)):
        bounds = index.bounds(terms, 2, each)
        assert 0 < bounds.where("kept").count() < bounds.count() * share
        held = index.postings().where(F.col("term").isin(terms)).select("batch", "term", "part", "tf_class", "dl_class", "shard", F.inline("posts"))
        met = held.join(bounds, ["batch", "term", "part", "tf_class", "dl_class", "shard"]).collect()
        assert all(r.low - 1e-9 <= r.idf * (r.tf * 2.2 / (r.tf + 1.2 * (0.25 + 0.75 * r.dl / r["mean"]))) <= r.high + 1e-9 for r in met) and met


def test_an_index_is_its_folder(spark, both):
    _, index = both
    again = PostingIndex(spark.newSession(), index.path)
    assert again.batches() == index.batches() and len(again.batches()) == 2
    assert rows(again.search(["w3"], 4), "part", "key") == rows(index.search(["w3"], 4), "part", "key")
    # Documents that are there already are not added again; a batch that was not listed does not count.
    before = index.documents().where("key IS NOT NULL").count()
    index.append(corpus(spark, 300, 1).where("id IS NOT NULL"), "id", "person", "note")
    assert index.documents().where("key IS NOT NULL").count() == before
    index.postings().drop("batch").limit(5).write.parquet(f"{index.path}/postings/batch=broken")
    assert index.postings().where("batch = 'broken'").count() == 0
    assert PostingIndex(spark).batches() == []


def test_scores_by_hand(spark):
    index = PostingIndex(spark)
    docs = spark.createDataFrame([(1, "p", "alpha beta beta"), (2, "p", "beta gamma gamma"), (3, "p", "gamma delta"), (4, "q", "alpha"), (5, "q", None)], "id long, person string, note string")
    index.append(docs, "id", "person", "note")
    hits = {(r.part, r.key): r.score for r in index.search(["alpha"], 3).collect()}
    assert hits.keys() == {("p", 1), ("q", 4)}
    assert math.isclose(hits["p", 1], math.log(1 + 2.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / (8 / 3))))
    got = {(r.part, r.key): r.iteration for r in index.iterative_search(["alpha"], 3, 5, 1).collect()}
    assert got["p", 1] == 0 and got["p", 2] == 1


def test_words_are_counted_where_they_lie(spark):
    docs = spark.createDataFrame([(None, 1, 3, ["a", "b", "a"]), (None, 1, 3, ["a", "c", "c"]), ("p", 1, 3, ["a", "b", "c"]), ("p", 2, 0, []), ("p", 3, 2, ["é", "é"])], "part string, key long, dl long, words array<string>")
    got = sorted((r.part or "", r.key, r.dl, r.term, r.tf) for r in counted(docs).collect())
    want = docs.select("part", "key", "dl", F.explode("words").alias("term")).groupBy("part", "key", "dl", "term").count().collect()
    assert got == sorted((r.part or "", r.key, r.dl, r.term, r["count"]) for r in want) and ("", 1, 3, "a", 3) in got
    plan = counted(docs.where("part = 'p'"))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_a_table_of_terms_reads_their_postings_only(spark, both):
    _, index = both
    terms = spark.createDataFrame([(p, ["w1", "w7"]) for p in "ab"], "part string, terms array<string>")
    plan = index.scored(terms, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "In(term, [w1,w7])" in plan.replace("[w7,w1]", "[w1,w7]")
