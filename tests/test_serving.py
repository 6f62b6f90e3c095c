"""Asking models, content blocks, tiles, registry and presets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import blocks, serving
from ledgerline.plans import config


def requests(spark):
    rows = [("c1", i, f"q{i % 3}") for i in range(4)] + [("c2", 0, "bad")]
    return serving.with_request_key(spark.createDataFrame(rows, "case_id string, ord int, request string"), F.col("request"))


def test_only_unknown_requests_are_asked(spark):
    def model(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("refused")
        return [f"re:{t}" for t in texts]

    df = requests(spark)
    cache = df.where("request = 'q0'").select("message_key", F.lit("stored").alias("response_text")).distinct()
    rows, new = serving.ask_with_cache(df.repartition(1), "request", model, cache, lambda c: c.isNotNull())
    got = {(r.case_id, r.ord): (r.response_text, r.from_cache) for r in rows.collect()}
    assert got["c1", 0] == ("stored", True) and got["c1", 3] == ("stored", True) and len(got) == 5
    single = serving.ask(df.where("case_id = 'c2'"), "request", model).first()
    assert single.response_text is None and single.error.startswith("RuntimeError")
    ok, new = serving.ask_with_cache(df.where("case_id = 'c1'"), "request", serving.adapter("echo"), cache, lambda c: c.isin("yes"))
    assert {r.response_text for r in ok.where("not from_cache").collect()} <= {"yes", "no"} and {r.response_text for r in new.collect()} <= {"yes"}
    with pytest.raises(KeyError):
        serving.adapter("none")


def test_every_unknown_request_is_asked_once(spark, tmp_path):
    def model(texts):
        import uuid

        (tmp_path / uuid.uuid4().hex).write_text("\n".join(texts))
        return [f"re:{uuid.uuid4().hex}" for _ in texts]

    df = serving.with_request_key(spark.createDataFrame([(f"c{i}", i, f"q{i % 6}") for i in range(24)], "case_id string, ord int, request string"), F.col("request")).repartition(3)
    cache = spark.createDataFrame([], "message_key string, response_text string")
    rows, new = serving.ask_with_cache(df, "request", model, cache, lambda c: c.isNotNull())
    replies = {r.message_key: r.response_text for r in new.collect()}
    assert all(r.response_text == replies[r.message_key] for r in rows.collect())
    rows.count()
    asked = [t for f in tmp_path.iterdir() for t in f.read_text().split("\n")]
    assert sorted(asked) == [f"q{i}" for i in range(6)]


def test_waves_and_caps(spark):
    df = requests(spark)
    lead = {(r.case_id, r.ord) for r in serving.waves(df, "case_id", [F.col("ord")], F.col("request") == "q0").where("wave = 0").collect()}
    assert lead == {("c1", 1), ("c2", 0)}
    capped = serving.within_cap(df.withColumn("cost", F.when(F.col("ord") != 1, 1.0)), ["case_id"], [F.col("ord")], F.col("cost"), 2.0)
    assert {(r.case_id, r.ord): r.allowed for r in capped.collect()} == {("c1", 0): True, ("c1", 1): True, ("c1", 2): False, ("c1", 3): False, ("c2", 0): True}


def test_a_spend_that_meets_the_cap_is_over_it(spark):
    df = spark.createDataFrame([("c", i, 0.1) for i in range(10)] + [("d", i, None if i else 0.1) for i in range(10)], "case_id string, ord int, cost double")
    # Eight times 0.1, added one by one, is 0.7999999999999999.
    capped = serving.within_cap(df, ["case_id"], [F.col("ord")], F.col("cost"), 0.8)
    assert {(r.case_id, r.n) for r in capped.groupBy("case_id").agg(F.count_if("allowed").alias("n")).collect()} == {("c", 8), ("d", 8)}


def test_blocks_are_assembled_in_order_and_fail_closed(spark):
    df = spark.createDataFrame([(1, "notes", [f"s{i}" for i in range(9)], ["t1", "t2", "t3"])], "id long, note string, slices array<string>, tiles array<string>")
    spec = [{"id": "EHR", "modality": "ehr", "column": "note"}, {"id": "CT", "modality": "ct", "column": "slices", "select": "evenly_spaced_k", "k": 3}, {"id": "WSI", "modality": "pathology", "column": "tiles", "row_key": "id", "n": 2}]
    b = blocks.with_blocks(df, spec)
    r = blocks.assembled(b).first()
    assert r.images[:3] == ["s0", "s4", "s8"] and len(r.images) == 5 and r.prompt == "notes"
    assert blocks.assembled(b.withColumn("t", F.lit("A [EHR] B")), "t").first().prompt == "A notes B"
    with pytest.raises(Exception, match="no single place"):
        blocks.assembled(b.withColumn("t", F.lit("A [EHR] [EHR]")), "t").collect()
    with pytest.raises(KeyError):
        blocks.with_blocks(df, [{"id": "x", "modality": "sound"}])
    g = blocks.golden(blocks.assembled(b), ["id"], "prompt", "images").first()
    assert g.n_images == 5 and g.prompt_chars == 5
    pack = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "f string, content binary")
    manifest = pack.select("f", F.sha2("content", 256).alias("sha256")).union(spark.createDataFrame([("c", "0")], "f string, sha256 string"))
    assert [r.f for r in blocks.damaged(pack.withColumn("content", F.when(F.col("f") == "b", F.lit("x").cast("binary")).otherwise(F.col("content"))), manifest, "f", "content").orderBy("f").collect()] == ["b", "c"]


def test_tiles_keep_dark_regions():
    gray = np.full((64, 64), 220, np.uint8)
    gray[16:48, 16:48] = 40
    gray[20, 20] = 60
    assert 40 <= blocks.otsu(gray) < 220 and blocks.otsu(np.full((4, 4), 9, np.uint8)) == 0
    assert [(x, y) for x, y, _ in blocks.tiles(gray, 16)] == [(16, 16), (32, 16), (16, 32), (32, 32)]
    assert [(x, y) for x, y, _ in blocks.tiles(gray, 16, least_variance=0.5)] == [(16, 16)]
    assert list(blocks.tiles(gray, 16, border=30)) == []


def test_registry_presets_variants():
    shared = {"t": {"label_mapping": {"0": "no", "1": "yes", "-1": "n/a"}, "is_binary": 1, "question": "Q?"}, "u": {"label_mapping": {"0": "a"}, "is_binary": 0, "inputs": "current_and_prior"}}
    t = config.resolve_task({"task_name": "x", "shared_task": "t"}, shared)
    assert t["choices"] == ["no", "yes"] and t["unscored_labels"] == ["-1"] and t["question"] == "Q?"
    for bad in ({"task_name": "x", "shared_task": "t", "mapping": {}}, {"task_name": "x", "shared_task": "u"}, {"task_name": "x", "shared_task": "zz"}):
        with pytest.raises(ValueError):
            config.resolve_task(bad, shared)
    panel = config.resolve_registry([{"task_name": "p", "panel_tasks": ["t"], "dataset": "d"}], shared)
    assert panel[0]["panel"] == ["t"] and panel[1]["panel_of"] == "p" and panel[1]["dataset"] == "d"
    presets = {"ct": {"blocks": [1], "cohort": "ct"}}
    assert config.expand_preset("ct", presets)["blocks"] == [1] and config.expand_preset({"name": "ct", "cohort": "all"}, presets)["cohort"] == "all" and config.expand_preset("odd", presets)["unknown"]
    v = config.with_variant({"k": 1}, {"two": {"k": 2}}, "two")
    assert v["k"] == 2 and len(v["recipe_hash"]) == 64
    with pytest.raises(ValueError):
        config.with_variant({"k": 1}, {"odd": {"z": 2}}, "odd")
    assert config.read_config('{"a": 1}') == {"a": 1} and config.arm_splits("x", {"x": ["test"]}) == ["test"]
