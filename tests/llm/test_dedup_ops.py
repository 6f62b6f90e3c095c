"""Exact dedup and SimHash against brute force on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ledgerline.llm import exact_dedup, simhash
from ledgerline.llm.components import connected_components

ODD = [None, "", " ", "a", "a b", "A  b", "a\tb", "a b c d", "x" * 50_000, "a b c d", None, "w " * 3000]


def docs(spark, texts):
    rows = [(i, t, "digest", "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, lang string")


def test_exact_dedup_matches_brute_force(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, ODD)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (same[0], len(same), same[0] == i)
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_index_keeps_what_it_saw_before(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.exact_dedup(docs(spark, ["a", "b", "b"]), index=index).collect()
    later = docs(spark, ["x", "y", "z", "b", "c"])
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(later, index=index).collect()}
    assert got[3] == (1, False) and got[4] == (4, True)
    assert index.read().count() == 6
    index.drop()


def brute_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts = ODD + base + [t + " tail" for t in base] + [t.upper() for t in base[:10]]
    fps = [brute_fp(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        comp = [min(comp[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(texts))]
    got = {r.doc_id: r for r in simhash.with_hex(simhash.near_duplicates(docs(spark, texts))).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_tiles_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    fps = np.unique(np.array([int(s) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for s in seeds for _ in range(9)], np.uint64))
    roots = simhash._roots(fps, 3)
    want = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    for _ in fps:
        want = np.array([want[n].min() for n in near])
    assert [[roots[i] == roots[j] for j in range(len(fps))] for i in range(len(fps))] == [[bool(want[i] == want[j]) for j in range(len(fps))] for i in range(len(fps))]


def test_components_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(-5, -9), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[-5] == -9


def test_decisions_are_made_by_row(spark, tmp_path):
    rows = [(5, "a"), (3, "b"), (5, "b"), (7, "c"), (7, "c"), (None, "d"), (None, "d"), (None, "a"), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "f", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, __copies string, n int")
    want = [(None, "d"), (3, "b"), (5, "a"), (7, "c"), (8, None)]
    order = lambda rows_: sorted(((r.doc_id, r.text) for r in rows_), key=lambda x: (x[0] is not None, x[0] or 0))
    docs.repartition(4).write.parquet(f"{tmp_path}/docs")
    for own in (docs, docs.repartition(3), spark.read.parquet(f"{tmp_path}/docs")):
        kept = exact_dedup.keep_first(own)
        assert kept.columns == docs.columns and order(kept.collect()) == want
        near = simhash.keep_one(own)
        assert near.columns == docs.columns and order(near.collect()) == want  # short texts: far apart unless equal
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0 == simhash.keep_one(docs.limit(0)).count()


def test_an_index_of_earlier_batches_drops_rows_seen_before(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    assert exact_dedup.keep_first(docs(spark, ["a", "b", "b"]), index=index).count() == 2
    assert [r.text for r in exact_dedup.keep_first(docs(spark, ["c", "b", "c"]), index=index).collect()] == ["c"]
    index.drop()
    assert not index.exists()


def test_an_index_outlives_its_session(spark, tmp_path):
    """Another session, with a catalog that knows nothing of the index, opens it by its folder."""
    path = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, buckets=4, path=path)
    exact_dedup.exact_dedup(docs(spark, [f"text {i}" for i in range(10)]), index=first).collect()
    spark.sql(f"DROP TABLE {first.name}")  # an external table: its files stay
    other = spark.newSession()
    second = exact_dedup.DigestIndex(other, buckets=64, path=path)
    assert second.exists() and second.buckets == 4 and second.read().count() == 10
    new = other.createDataFrame([(100, "text 3"), (101, "new")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(new, index=second).collect()}
    assert got == {100: (3, False), 101: (101, True)}
    assert sorted(r.keep_id for r in second.read().collect()) == [*range(10), 101]
    assert exact_dedup.keep_first(new, index=second).count() == 0
    plan = new.select(exact_dedup.digest().alias("digest")).join(second.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "SelectedBucketsCount: 4 out of 4" in plan
    second.drop()
    assert not second.exists()


def test_a_folder_that_holds_something_else_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/other")
    with pytest.raises(ValueError, match="no digest index"):
        exact_dedup.DigestIndex(spark, path=f"file://{tmp_path}/other")
    assert spark.read.parquet(f"file://{tmp_path}/other").count() == 3


def test_a_missing_note_is_an_error(spark, tmp_path):
    from ledgerline.llm import common

    docs(spark, ["a", "b", "b", "c", "d"]).repartition(3).write.parquet(f"{tmp_path}/docs")
    own = spark.read.parquet(f"{tmp_path}/docs")
    with common.scratch(spark):
        kept = exact_dedup.keep_first(own)
        assert kept.count() == 4
    with pytest.raises(Exception, match="rows"):
        kept.collect()


def test_files_without_a_row_that_stays(spark, tmp_path):
    for i, texts in enumerate((["a", "b"], ["b", "a"], ["a"])):
        spark.createDataFrame([(10 * i + k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs/part={i}")
    own = spark.read.parquet(f"{tmp_path}/docs")
    assert sorted(r.doc_id for r in exact_dedup.keep_first(own).collect()) == [0, 1] == sorted(r.doc_id for r in simhash.keep_one(own).collect())


def test_columns_that_are_called_like_places(spark, tmp_path):
    rows = [(1, "a", "x", 7, "m"), (2, "a", "y", 8, "m"), (3, "b", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, __file string, __row int, _metadata string").repartition(2).write.parquet(f"{tmp_path}/docs")
    own = spark.read.parquet(f"{tmp_path}/docs")
    for kept in (exact_dedup.keep_first(own), simhash.keep_one(own)):
        assert kept.columns == own.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_intermediate_tables_go(spark):
    from ledgerline.llm import common

    made = common.made(spark)
    tables = [t.name for t in spark.catalog.listTables()]
    with common.scratch(spark) as stay:
        before = len(made)
        exact_dedup.exact_dedup(docs(spark, ODD)).collect()
        simhash.near_duplicates(docs(spark, ODD)).collect()
        stay.append(common.shared_dir(spark, "kept"))
        assert len(made) > before + 3
    assert made[before:] == stay and [t.name for t in spark.catalog.listTables()] == tables


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from ledgerline.llm import common

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf))


def pairs_by_plain_search(fps, radius=3):
    root = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = root[i], root[j]
            if a != b:
                root[root == max(a, b)] = min(a, b)
    return root


def test_a_large_bucket_is_compared_by_pairs_of_tiles(spark):
    rng = np.random.default_rng(11)
    seeds = rng.integers(0, 1 << 38, 300).astype(np.uint64)  # all agree on the other 26 bits: one bucket
    fps = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << rng.integers(0, 38, 300).astype(np.uint64)) for _ in range(6)]))
    want = pairs_by_plain_search(fps)
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.links(table, 3, big=50)).collect()}
    signed = fps.view(np.int64)
    for own in np.unique(want):
        members = signed[want == own]
        assert {got.get(int(x), int(x)) for x in members} == {int(members.min())}


def test_a_hundred_thousand_fingerprints_in_one_bucket(spark):
    rng = np.random.default_rng(12)
    fps = np.unique(rng.integers(0, 1 << 38, 100_000).astype(np.uint64))
    near = np.unique(np.concatenate([fps, fps[:500] ^ np.uint64(1)])).view(np.int64)
    table = spark.createDataFrame(pa.table({"fp": near}))
    forest = simhash.links(table, 3, big=3000).distinct()
    linked = {int(x) for r in forest.collect() for x in (r.a, r.b)}
    assert {int(x) for x in fps[:500].view(np.int64)} <= linked and len(linked) >= 1000


def test_hubs_meet_their_neighbours_by_broadcast(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(30)]
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(table).collect()}
    assert all(got[i] == 0 for i in range(3000)) and all(got[5000 + i] == 5000 for i in range(31))
