"""Sources and sinks on temporary folders, and the streaming extension."""

import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import blocks
from ledgerline.sources import readers, sinks, slides, volumes
from ledgerline.sources.volume_source import TASKS, SliceReader, volume_slices
from ledgerline.streaming.windows import windowed_counts


def test_delimited_files_keep_padded_ids(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('index;acc;note\n1;007;"two\nlines; ""quoted"""\n2;008;x\n')
    rows = readers.delimited(spark, str(p)).collect()
    assert readers.sniff(spark, str(p)) == ";" and [(r.acc, r.note) for r in rows] == [("007", 'two\nlines; "quoted"'), ("008", "x")]
    typed = readers.delimited(spark, str(p), T.StructType([T.StructField("index", T.IntegerType()), T.StructField("acc", T.StringType()), T.StructField("note", T.StringType())]))
    assert [r["index"] for r in typed.collect()] == [1, 2]


def test_task_rows_from_cache_or_table(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("it's", 2)], "task string, x int").createOrReplaceTempView("tasks")
    assert [r.x for r in readers.task_rows(spark, "tasks", "it's").collect()] == [2]
    assert readers.cached_or_table(spark, str(tmp_path / "none.csv"), "tasks", "a").count() == 1
    (tmp_path / "c.csv").write_text("task,x\na,5\nb,6\n")
    assert [r.x for r in readers.cached_or_table(spark, str(tmp_path / "c.csv"), "tasks", "a").collect()] == ["5"]


def test_parquet_json_and_lookups(spark, tmp_path):
    spark.range(10).select("id", (F.col("id") * 2).alias("v"), F.lit("u").alias("uid")).write.parquet(str(tmp_path / "t"))
    listed = readers.parquet_columns(spark, str(tmp_path / "t"), ["v"], "id", [1, 3])
    assert sorted(r.v for r in listed.collect()) == [2, 6] and "In(id, [1,3])" in listed._jdf.queryExecution().executedPlan().toString()
    assert readers.parquet_columns(spark, str(tmp_path / "t"), ["v"], "id", spark.createDataFrame([(4,)], "id long")).first().v == 8
    t = spark.read.parquet(str(tmp_path / "t"))
    assert readers.array_lookup(t, "id", [1, "2", "x", 1 << 70], "uid").count() == 2
    assert readers.looked_up(t, spark.createDataFrame([(1, 2), (1, 2), (2, 9)], "id long, v long"), ["id", "v"]).count() == 1
    (tmp_path / "a.json").write_text(json.dumps({"answers": {"q1": {"p": 0.5}, "q2": {"p": None}}}, indent=1))
    schema = T.StructType([T.StructField("p", T.DoubleType())])
    assert {(r.id, r.p) for r in readers.answers_document(spark, str(tmp_path / "a.json"), schema).collect()} == {("q1", 0.5), ("q2", None)}
    (tmp_path / "l.jsonl").write_text('{"p": 1}\n{"p": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), schema).count() == 2


def test_xml_logs_files(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<root><encounter person="7"><entry timestamp="2024-01-01 10:00:00"><event code="A" name="a" unit="mg">1</event><event code="B">x</event></entry></encounter></root>')
    rows = readers.xml_events(spark, str(tmp_path / "p.xml")).orderBy("time", "doc_ord").collect()
    assert [(r.person, r.code, r.text_value) for r in rows] == [("7", "A", "1"), ("7", "B", "x")]
    (tmp_path / "run.log").write_text("Max input tokens = 5\nTask: one\nMax input tokens = 10\nnoise\nMax input tokens = 20\nTask: two\nMax input tokens = 7\n")
    got = {r.task: (r["mean"], r.n) for r in readers.log_blocks(spark, str(tmp_path / "run.log"), r"^Task: (\w+)", r"Max input tokens = (\d+)").collect()}
    assert got == {"one": (15.0, 2), "two": (7.0, 1)}
    d = tmp_path / "r" / "src" / "task1" / "modelA"
    d.mkdir(parents=True)
    (d / "x_results_exp1.csv").write_text("index,label\n1,0\n")
    (d / "other.csv").write_text("index,label\n9,9\n")
    r = readers.result_files(spark, str(tmp_path / "r")).first()
    assert (r.source, r.task, r.model, r.experiment, r["index"]) == ("src", "task1", "modelA", "exp1", "1")
    names = spark.createDataFrame([("other.csv",), ("gone.csv",)], "f string")
    assert readers.existing(names, spark, str(tmp_path / "r"), F.col("f")).count() == 1
    sizes = readers.volumes(spark, str(tmp_path / "r"), "*.csv", lambda content, name: [{"name": name, "bytes": len(content)}], "name string, bytes long")
    assert {r.name for r in sizes.collect()} == {"other.csv", "x_results_exp1.csv"}
    for i in (1, 2):
        spark.createDataFrame([(i,)], f"a{i} int").write.parquet(str(tmp_path / "pp" / str(i) / "labs.parquet"))
    assert sorted(readers.per_patient(spark, str(tmp_path / "pp"), "labs").columns) == ["a1", "a2"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "ok", 1), ("c2", "overflow", 2)], "case_id string, outcome string, x int")
    path = str(tmp_path / "s")
    h = sinks.write_once(rows, path, "case_id")
    assert sinks.write_once(rows.repartition(3), path, "case_id") == h
    with pytest.raises(FileExistsError):
        sinks.write_once(rows.limit(1), path, "case_id")
    sinks.replace_table(rows, str(tmp_path / "r"))
    sinks.replace_table(rows.limit(1), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1 and len(list(tmp_path.glob("r.*"))) == 0
    for _ in range(2):
        sinks.append_csv(rows, str(tmp_path / "csv"))
        sinks.log_attempts(rows, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4 and spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.side_outputs(rows, str(tmp_path / "o"))
    assert {p.name for p in (tmp_path / "o").glob("outcome=*")} == {"outcome=ok", "outcome=overflow"}
    sinks.by_id(rows, str(tmp_path / "id"), "case_id")
    assert spark.read.parquet(str(tmp_path / "id")).count() == 2
    sinks.split_panel(spark.createDataFrame([("k", 1, None)], "k string, a int, b int"), ["k"], ["a", "b"], str(tmp_path / "panel"))
    assert {p.name for p in (tmp_path / "panel").glob("task=*")} == {"task=a", "task=b"}
    info = sinks.with_sidecar(rows, str(tmp_path / "w"), "case_id", {"in": "text"}, "abc")
    assert json.loads((tmp_path / "w.json").read_text()) == info and info["rows"] == 2
    assert sinks.document_text(rows, "outcome", ["x"], "case_id").count() == 2 and sinks.light(rows.withColumn("prompt", F.lit(""))).columns == rows.columns


def test_event_windows_as_stream_and_batch(spark, tmp_path):
    e = spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' AS ts, 'a' AS k, 1.0D AS v UNION ALL SELECT timestamp_ntz'2024-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT timestamp_ntz'2024-01-01 02:00:00', 'a', 4.0D")
    e.write.parquet(str(tmp_path / "e"))
    batch = sorted(tuple(r) for r in windowed_counts(e, "ts", "k", "v").collect())
    q = windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("w").collect()) == batch and [r[2] for r in batch] == [2, 1]


def test_a_swap_that_broke_off_is_mended(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.0123.old")  # a crash between the two renames
    assert sinks.recover_table(spark, path) and spark.read.parquet(path).count() == 3
    assert not sinks.recover_table(spark, path)
    (tmp_path / "t").rename(tmp_path / "t.0123.old")
    sinks.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not list(tmp_path.glob("*.old"))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0), (0, 2, 1)])
@pytest.mark.parametrize("signs", [(1, 1, 1), (-1, 1, -1), (-1, -1, 1), (1, -1, -1)])
def test_volumes_are_shown_alike_however_they_are_stored(order, signs):
    world = np.arange(2 * 3 * 4, dtype=np.float32).reshape(2, 3, 4)  # towards right, front, head
    stored, affine = world, np.zeros((4, 4))
    for axis, sign in enumerate(signs):
        stored = np.flip(stored, axis) if sign < 0 else stored
    stored = stored.transpose(order)
    for own, axis in enumerate(order):
        affine[axis, own] = signs[axis] * (axis + 1.0)
    affine[3, 3] = 1
    spacing = tuple(float(order[i] + 1) for i in range(3))
    v = volumes.Volume(volumes.encode(stored, affine, spacing))
    assert len(v) == 4 and v.spacing == (1.0, 2.0, 3.0)
    for k in range(4):
        want = [[world[1 - c, 2 - r, 3 - k] for c in range(2)] for r in range(3)]  # front to back, the patient's right to the left
        assert v.slice(k).tolist() == want
    with pytest.raises(IndexError):
        v.slice(4)
    with pytest.raises(ValueError, match="not a NIfTI"):
        volumes.Volume(b"x" * 400)


def test_slides_become_tiles_that_the_manifest_lacks(spark, tmp_path):
    gray = np.full((64, 64), 240, np.uint8)
    gray[:32, :32] = np.random.default_rng(1).integers(20, 90, (32, 32))
    for name in ("a", "b"):
        (tmp_path / f"{name}.pgm").write_bytes(b"P5 64 64 255\n" + gray.tobytes())
    slides = spark.createDataFrame([("a.pgm",), ("b.pgm",)], "slide string")
    manifest = spark.createDataFrame([("a.pgm", 0, 0)], "slide string, x int, y int")
    assert [r.slide for r in blocks.untiled(slides, manifest, "slide").collect()] == ["b.pgm"]

    def cut(content, name):
        return [{"slide": name, "x": x, "y": y, "tissue": share} for x, y, share in blocks.tiles(volumes.read_pgm(content), 16)]

    found = readers.volumes(spark, str(tmp_path), "*.pgm", cut, "slide string, x int, y int, tissue double").where("slide = 'b.pgm'").collect()
    assert {(r.x, r.y) for r in found} == {(0, 0), (16, 0), (0, 16), (16, 16)}


class Counted(io.BytesIO):
    """Counts what is read."""

    def __init__(self, data):
        super().__init__(data)
        self.bytes = 0

    def read(self, size=-1):
        out = super().read(size)
        self.bytes += len(out)
        return out


@pytest.mark.parametrize("packed", [False, True])
def test_only_the_slices_asked_for_are_read(packed):
    rng = np.random.default_rng(4)
    stored = rng.normal(size=(20, 30, 400)).astype(np.float32)
    data = volumes.encode(stored, np.diag([1.0, 1.0, -1.0, 1.0]), packed=packed)
    stream = Counted(data)
    rows = list(volumes.slices(stream, "a__b.nii", lambda k, n: k in (3, 5, n - 390)))
    assert [r["k"] for r in rows] == [3, 5, 10]
    assert stream.bytes < (352 + 3 * 20 * 30 * 4 + 10 if not packed else len(data) / 5)  # decompression reads ahead
    whole = {r["k"]: r["values"] for r in volumes.slices(data, "a__b.nii")}
    assert all(whole[r["k"]] == r["values"] for r in rows) and len(whole) == 400


def test_slices_as_a_data_source(spark, tmp_path):
    rng = np.random.default_rng(5)
    for i, affine in enumerate((np.diag([1.0, 1.0, 1.0, 1.0]), np.diag([-1.0, 1.0, -2.0, 1.0]), np.array([[0, 0, 1, 0], [0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1.0]]))):
        for packed in (False, True):
            (tmp_path / f"s{i}__{packed}.nii{'.gz' * packed}").write_bytes(volumes.encode(rng.normal(size=(4, 5, 6)), affine, packed=packed))
    for parts in (1, 3):
        df = volume_slices(spark, str(tmp_path), parts=parts)
        assert df.groupBy("study").count().orderBy("study").collect() == [("s0", 12), ("s1", 12), ("s2", 8)]
        some = volume_slices(spark, str(tmp_path), [1, 2], ["s1", "s2"], parts)
        want = [r for r in df.collect() if r.k in (1, 2) and r.study >= "s1"]
        assert sorted(some.collect()) == sorted(want) and len(want) == 8
    one, two = (volume_slices(spark, str(tmp_path), [k]) for k in (1, 2))  # two scans of one folder in one plan
    assert one.join(two, "study").count() == 12 and one.join(two, ["study", "k"]).count() == 0
    reader = SliceReader({"path": str(tmp_path), "k": "[0, 5]", "studies": '["s1"]'})
    assert sum(len(p.files) for p in reader.partitions()) == 2
    assert [r[2] for p in reader.partitions() for r in reader.read(p)] == [0, 5, 0, 5]


@pytest.mark.parametrize("deflated", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiles_of_a_pyramid_come_back(deflated, order):
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (70, 100), dtype=np.uint8)
    slide = slides.Slide(slides.encode([grey, grey[::2, ::2]], 32, deflated, order))
    assert [(v.width, v.height) for v in slide.levels] == [(100, 70), (50, 35)]
    assert np.array_equal(slide.image(0), grey) and np.array_equal(slide.image(1), grey[::2, ::2])
    rgb = np.repeat(grey[..., None], 3, axis=2)
    assert np.array_equal(slides.Slide(slides.encode([rgb], 64, deflated, order)).image(0), grey)
    for broken in (b"", b"II*\0", b"x" * 64, slides.encode([grey], 32)[:200]):
        with pytest.raises((ValueError, struct.error)):
            slides.Slide(broken)


def test_tiles_that_hold_tissue(spark, tmp_path):
    rng = np.random.default_rng(6)
    full = np.full((256, 320), 240, np.uint8)
    full[64:192, 64:256] = rng.integers(20, 120, (128, 192))  # tissue
    full[128:192, 192:256] = 60  # tissue, but flat
    for name in ("a", "b"):
        (tmp_path / f"{name}.tif").write_bytes(slides.encode([full, full[::4, ::4]], 64))
    opened = Counted((tmp_path / "a.tif").read_bytes())
    kept = [(x, y) for x, y, *_ in slides.tissue_tiles(slides.Slide(opened), least_variance=10)]
    assert kept == [(64, 64), (128, 64), (192, 64), (64, 128), (128, 128)]
    assert opened.bytes < full.size / 2  # six tiles of twenty, and the small level
    inside = lambda border: [(x, y) for x, y, *_ in slides.tissue_tiles(slides.Slide((tmp_path / "a.tif").read_bytes()), border=border)]
    assert inside(96) == [*kept, (192, 128)] and inside(97) == []
    for parts in (1, 3):
        df = slides.slide_tiles(spark, str(tmp_path), least_variance=10, parts=parts)
        assert sorted((r.slide, r.x, r.y) for r in df.collect()) == [(f"{n}.tif", x, y) for n in "ab" for x, y in sorted(kept)]
        (r,) = slides.slide_tiles(spark, str(tmp_path), slides='["b.tif"]').where("x = 64 AND y = 128").collect()
        assert bytes(r.grey) == full[128:192, 64:128].tobytes() and r.tissue == 1.0
    done = df.select("slide").distinct().where("slide = 'a.tif'")
    assert {r.slide for r in blocks.untiled(df, done, "slide").collect()} == {"b.tif"}
    small = slides.slide_tiles(spark, str(tmp_path), level=1, least_tissue=0).select("x", "y", "scale").collect()
    assert {(r.x, r.y, r.scale) for r in small} == {(0, 0, 4.0)}


def test_small_files_share_tasks_and_large_ones_are_split(tmp_path):
    body = volumes.encode(np.arange(24, dtype=np.float32).reshape(2, 2, 6), np.diag([1.0, 1.0, 1.0, 1.0]), packed=False)
    image = np.full((32, 32), 240, np.uint8)
    image[:16] = np.arange(32) * 2
    for i in range(3 * TASKS):
        (tmp_path / f"s{i}__1.nii").write_bytes(body)
        (tmp_path / f"s{i}.tif").write_bytes(slides.encode([image, image[::4, ::4]], 16))
    for make, rows in ((SliceReader, 6), (slides.TileReader, 2)):
        for options, tasks in (({}, TASKS), ({"parts": "2"}, TASKS), ({"parts": "2", "split_bytes": "0"}, 6 * TASKS)):
            reader = make({"path": str(tmp_path), **options})
            found = reader.partitions()
            assert len(found) == tasks
            read = [r[:1] + r[2:4] for p in found for r in reader.read(p)]
            assert len(read) == len(set(read)) == rows * 3 * TASKS


def test_xml_is_parsed_as_it_is_read(spark, tmp_path):
    one = '<encounter person="p1"><entry timestamp="2024-01-02 03:04"><event code="A" name="x" unit="u"> é &amp; 1 </event><event code="B"/></entry><entry timestamp="no time"><event code="C">2</event></entry></encounter>'
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0" encoding="UTF-8"?>\n<all>{one}<encounter person="p2"><entry/></encounter></all>')
    (tmp_path / "b.xml").write_text(one + one.replace("p1", "p3"))
    got = sorted((r.doc_ord.doc.file[-5:], r.doc_ord.doc.row, r.doc_ord.i, r.doc_ord.j, r.person, r.time and r.time.minute, r.code, r.description, r.text_value, r.unit) for r in readers.xml_events(spark, str(tmp_path)).collect())
    want = [(0, 0, 4, "A", "x", "é & 1", "u"), (0, 1, 4, "B", None, None, None), (1, 0, None, "C", None, "2", None)]
    assert got == [(f, e, i, j, p, *rest) for f, e, p in (("a.xml", 0, "p1"), ("b.xml", 0, "p1"), ("b.xml", 1, "p3")) for i, j, *rest in want]
    # What is held does not grow with the entries of an encounter.
    long = io.BytesIO(b"<encounter>" + b'<entry timestamp="t"><event code="A">1</event></entry>' * 50_000 + b"</encounter>")
    sizes = [len(rows) for rows in readers.xml_rows(long)]
    assert sum(sizes) == 50_000 and max(sizes) < 20_000
