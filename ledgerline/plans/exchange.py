"""Sources and sinks: tables are written in each form, read back and summed up."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.dates import parse_time
from ledgerline.operators import blocks, filters, joins, timeline
from ledgerline.plans.register import query
from ledgerline.shipping import ship
from ledgerline.sources import readers, sinks, slides, volumes
from ledgerline.sources.volume_source import volume_slices
from ledgerline.storage import shared_dir, spread

big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


@query("customer", sql="""
    SELECT c_mktsegment, count(*) AS n, min(lpad(c_custkey::VARCHAR, 8, '0')) AS first_id, max(len(lpad(c_custkey::VARCHAR, 8, '0')))::BIGINT AS width FROM customer GROUP BY c_mktsegment""")
def q65_csv_append(customer):
    """Two appends to one delimited table, without heavy columns, read back with ids as text."""
    path = shared_dir(customer.sparkSession, "csv")
    rows = customer.select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("id"), "c_mktsegment", F.lit("long, \"quoted\"\ntext").alias("note"), F.lit("x").alias("prompt"), F.col("c_custkey"))
    for odd in (0, 1):
        sinks.append_csv(filters.present(sinks.light(rows.where(F.col("c_custkey") % 2 == odd)), ["id", "c_mktsegment", "absent"]), path)
    back = readers.delimited(customer.sparkSession, path)
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), big(F.max(F.length("id"))).alias("width"))


@query("orders", sql="""
    SELECT CASE o_orderstatus WHEN 'F' THEN 'table' ELSE 'cache' END AS source, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def q66_cache_or_table(orders):
    """A task's rows from the table where there is no cached file, and from the file where there is one."""
    spark, path = orders.sparkSession, shared_dir(orders.sparkSession, "cache")
    tasks = orders.select("o_orderkey", F.col("o_orderstatus").alias("task"))
    tasks.createOrReplaceTempView("ledgerline_tasks")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("task", T.StringType())])
    table = readers.cached_or_table(spark, path, "ledgerline_tasks", "F", schema).withColumn("source", F.lit("table"))
    sinks.append_csv(tasks.where("task <> 'F'"), path)
    cache = readers.cached_or_table(spark, path, "ledgerline_tasks", "O", schema).withColumn("source", F.lit("cache"))
    return table.unionByName(cache).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("events", sql="""
    SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, strftime(max(ts), '%Y-%m-%d %H:%M') AS last FROM events GROUP BY event_type""")
def q67_attempt_log(events):
    """An append-only log of JSON lines, read with its schema."""
    path = shared_dir(events.sparkSession, "log")
    rows = events.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"))
    for part in (0, 1, 2):
        sinks.log_attempts(rows.where(F.col("event_id") % 3 == part), path)
    back = readers.json_lines(events.sparkSession, path, rows.schema)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.max("at").alias("last"))


@query("supplier", sql="""
    SELECT s_nationkey % 3 AS label, count(*) AS n, sum(s_suppkey)::BIGINT AS ids, sum(round(s_acctbal * 100)::BIGINT)::BIGINT AS cents FROM supplier GROUP BY 1""")
def q68_answer_documents(supplier):
    """Documents {"answers": {id: {...}}}, one a nation, as rows."""
    spark, folder = supplier.sparkSession, shared_dir(supplier.sparkSession, "answers")
    answer = F.struct(big(F.round(F.col("s_acctbal") * 100)).alias("cents"), (F.col("s_nationkey") % 3).alias("label"))
    docs = supplier.groupBy("s_nationkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), answer))).alias("answers"))).alias("body"))
    sinks.write_files(docs.select(F.concat(F.lit("a"), F.col("s_nationkey"), F.lit(".json")).alias("name"), "body"), folder, "name", "body")
    back = readers.answers_document(spark, folder, T.StructType([T.StructField("cents", T.LongType()), T.StructField("label", T.IntegerType())]))
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(big("id")).alias("ids"), F.sum("cents").alias("cents"))


@query("events", sql="""
    WITH e AS (SELECT 'p' || lpad((user_id % 16)::VARCHAR, 2, '0') AS person, * FROM events)
    SELECT person, count(*) AS n, arg_min(event_type, (date_trunc('minute', ts), event_id)) AS first_code,
           sha256(string_agg(event_type || '=' || event_id, ',' ORDER BY date_trunc('minute', ts), event_id)) AS digest FROM e GROUP BY person""")
def q69_xml_files(events):
    """Event streams in XML files, one a person, in the order of the document."""
    spark, folder = events.sparkSession, shared_dir(events.sparkSession, "xml")
    minute = F.date_format("ts", "yyyy-MM-dd HH:mm")
    entry = F.concat(F.lit('<entry timestamp="'), minute, F.lit('"><event code="'), F.col("event_type"), F.lit('" type="t">'), F.col("event_id").cast("string"), F.lit("</event></entry>"))
    rows = events.withColumn("person", F.concat(F.lit("p"), F.lpad((F.col("user_id") % 16).cast("string"), 2, "0")))
    docs = timeline.ordered_text(rows, ["person"], [minute, F.col("event_id")], entry, "body")
    docs = docs.select(F.concat("person", F.lit(".xml")).alias("name"), F.concat(F.lit('<encounter person="'), F.col("person"), F.lit('">'), F.col("body"), F.lit("</encounter>")).alias("body"))
    sinks.write_files(docs, folder, "name", "body")
    back = readers.xml_events(spark, folder)
    # The files are parsed once, for all three. A person has one document, so the row that holds it orders like its path.
    place = [F.col("doc_ord.doc.row"), F.col("doc_ord.i"), F.col("doc_ord.j")]
    lines = timeline.lines_in_order(place, F.concat("code", F.lit("="), F.col("text_value")), ",")
    per = back.groupBy("person").agg(F.count(F.lit(1)).alias("n"), F.min_by("code", F.struct("time", *place)).alias("first_code"), lines.alias("lines"))
    return per.select("person", "n", "first_code", F.sha2(F.col("lines").cast("binary"), 256).alias("digest"))


@query("events", sql="""
    SELECT event_type || '.log' AS file, 'w' || weekofyear(ts) AS task, round(avg((props->>'$.k')::DOUBLE), 6) AS mean, count(*) AS n FROM events GROUP BY ALL""")
def q70_log_blocks(events):
    """Logs in which a header line opens a block of values."""
    spark, folder = events.sparkSession, shared_dir(events.sparkSession, "logs")
    week = F.weekofyear("ts")
    value = F.concat(F.lit("Max input tokens = "), F.get_json_object("props", "$.k"))
    blocks = timeline.ordered_text(events.withColumn("week", week), ["event_type", "week"], [F.col("event_id")], value, "lines")
    blocks = blocks.withColumn("lines", F.concat(F.lit("Task: w"), F.col("week").cast("string"), F.lit("\nnoise\n"), F.col("lines")))
    files = timeline.ordered_text(blocks, ["event_type"], [F.col("week")], F.col("lines"), "body").select(F.concat("event_type", F.lit(".log")).alias("name"), "body")
    sinks.write_files(files, folder, "name", "body")
    back = readers.log_blocks(spark, folder, r"^Task: (\w+)", r"^Max input tokens = (\d+)")
    return back.select(F.element_at(F.split("file", "/"), -1).alias("file"), "task", F.round("mean", 6).alias("mean"), "n")


@query("orders", sql="""
    SELECT 's' || o_orderstatus AS source, 'm' || (o_custkey % 2) AS model, 'e' || (year(o_orderdate) % 3) AS experiment, count(*) AS n, count(DISTINCT month(o_orderdate)) AS months FROM orders GROUP BY ALL""")
def q71_result_tree(orders):
    """Result files found below a root, with the keys that their paths hold."""
    spark, folder = orders.sparkSession, shared_dir(orders.sparkSession, "results")
    keys = [F.concat(F.lit("s"), F.col("o_orderstatus")).alias("source"), F.concat(F.lit("m"), (F.col("o_custkey") % 2).cast("string")).alias("model"), F.concat(F.lit("e"), (F.year("o_orderdate") % 3).cast("string")).alias("experiment")]
    per = orders.groupBy(*keys, F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    body = timeline.ordered_text(per, ["source", "model", "experiment"], [F.col("month")], F.concat_ws(",", F.col("month").cast("string"), F.col("n").cast("string")), "lines")
    name = F.concat(F.col("source"), F.lit("/task/"), F.col("model"), F.lit("/x_results_"), F.col("experiment"), F.lit(".csv"))
    sinks.write_files(body.select(name.alias("name"), F.concat(F.lit("month,n\n"), F.col("lines"), F.lit("\n")).alias("body")), folder, "name", "body")
    back = readers.result_files(spark, folder)
    return back.groupBy("source", "model", "experiment").agg(F.sum(big("n")).alias("n"), F.count(F.lit(1)).alias("months"))


@query("orders", "nation", sql="""
    SELECT 'status ' || o_orderstatus AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'region ' || n_regionkey, count(*), sum(n_nationkey)::BIGINT FROM nation GROUP BY n_regionkey""")
def q72_partitions_by_id(orders, nation):
    """One folder an id, read back whole; and one table a folder, read by pattern with a stated schema."""
    spark, path, root = orders.sparkSession, shared_dir(orders.sparkSession, "by-id"), shared_dir(orders.sparkSession, "patients")
    sinks.by_id(orders.select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    whole = spark.read.parquet(path).groupBy(F.concat(F.lit("status "), F.col("o_orderstatus").cast("string")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    for i in range(5):
        nation.where(F.col("n_regionkey") == i).select("n_nationkey", "n_regionkey").write.parquet(f"{root}/{i}/nations.parquet")
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_regionkey", T.IntegerType())])
    per = readers.per_patient(spark, root, "nations", schema).groupBy(F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("keys"))
    return whole.unionByName(per)


@query("customer", "lineitem", "orders", folder=True, sql="""
    SELECT 'listed' AS how, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus IN ('F', 'P')
    UNION ALL SELECT 'semi', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    UNION ALL SELECT 'pairs', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09)
    UNION ALL SELECT 'ids', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13) AND trim(o_orderpriority) <> ''""")
def q73_keyed_scans(sf_dir, customer, lineitem, orders):
    """Scans by a pushed list, by a table of keys, by pairs, and by ids of which some are no ids."""
    spark, path = orders.sparkSession, f"{sf_dir}/orders.parquet"
    total = lambda df, how, key: df.agg(F.lit(how).alias("how"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"))
    listed = readers.parquet_columns(spark, path, ["o_orderkey"], "o_orderstatus", ["F", "P"])
    semi = readers.parquet_columns(spark, path, ["o_orderkey"], "o_custkey", customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")))
    pairs = readers.looked_up(lineitem, lineitem.where("l_returnflag = 'R' AND l_discount >= 0.09"), ["l_partkey", "l_suppkey"])
    ids = readers.array_lookup(orders, "o_custkey", [1, "2", 3, 5, 8, 13, "x", None, 1 << 70], "o_orderpriority")
    parts = [total(listed, "listed", "o_orderkey"), total(semi, "semi", "o_orderkey"), total(pairs, "pairs", "l_orderkey"), total(ids, "ids", "o_orderkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("events", sql="""
    WITH t AS (SELECT user_id % 20 AS person, string_agg(event_type || ' ' || event_id, chr(10) ORDER BY ts, event_id) AS notes FROM events GROUP BY 1)
    SELECT person, sha256(notes) AS digest FROM t WHERE person % 2 = 0""")
def q74_documents_on_disk(events):
    """One text file an id, written for some; the ids whose file is there, and what the files hold."""
    spark, folder = events.sparkSession, shared_dir(events.sparkSession, "notes")
    rows = events.select((F.col("user_id") % 20).alias("person"), "ts", "event_id", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("line"))
    docs = sinks.document_text(rows, "person", ["ts", "event_id"], "line").withColumn("name", F.concat(F.lit("p"), F.col("person").cast("string"), F.lit(".txt")))
    sinks.write_files(docs.where("person % 2 = 0"), folder, "name", "notes")
    there = readers.existing(docs.select("person", "name"), spark, folder, F.col("name"))
    read = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return there.join(read, "name").select("person", "digest")


@query("orders", "events", sql="""
    SELECT 'replaced' AS what, o_orderstatus AS part, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderstatus
    UNION ALL SELECT 'kept once', 'same keys', 1
    UNION ALL SELECT 'sidecar', 'rows', count(*) FROM orders UNION ALL SELECT 'sidecar', 'entities', count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'panel', 'early', count(*) FROM orders UNION ALL SELECT 'panel', 'large', count(*) FROM orders
    UNION ALL SELECT 'outcome', CASE WHEN value > 2000 THEN 'overflow' WHEN value IS NULL THEN 'missing' ELSE 'ok' END, count(*) FROM (SELECT round(value * 1000) AS value FROM events) GROUP BY 2""")
def q75_guarded_sinks(orders, events):
    """A table replaced, a sample that is not redrawn, a table with its sidecar, a panel split by task, rows by outcome."""
    spark = orders.sparkSession
    table, once, side, panel, outcome = (shared_dir(spark, x) for x in ("replace", "once", "sidecar", "panel", "outcome"))
    for odd in (1, 0):
        sinks.publish(orders.where(F.col("o_orderkey") % 2 == odd).select("o_orderkey", "o_orderstatus"), table)
    replaced = sinks.published(spark, table).groupBy(F.lit("replaced").alias("what"), F.col("o_orderstatus").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    sample = orders.select("o_orderkey")
    same = sinks.write_once(sample, once, "o_orderkey") == sinks.write_once(sample.orderBy(F.desc("o_orderkey")), once, "o_orderkey")
    info = sinks.with_sidecar(orders.select("o_orderkey", "o_custkey"), side, "o_custkey", {"orders": "x"})
    told = json.loads(spark.read.text(f"{side}.json", wholetext=True).first().value)
    rows = [("kept once", "same keys", int(same)), ("sidecar", "rows", told["rows"]), ("sidecar", "entities", info["entities"])]
    wide = orders.select("o_orderkey", (F.month("o_orderdate") < 6).alias("early"), (F.col("o_totalprice") > 1e5).alias("large"))
    sinks.split_panel(wide, ["o_orderkey"], ["early", "large"], panel)
    split = spark.read.parquet(panel).groupBy(F.lit("panel").alias("what"), F.col("task").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    sinks.side_outputs(filters.with_outcome(events.select(F.round(F.col("value") * 1000).alias("v")), F.col("v"), F.lit(0), 1, 2000), outcome)
    sides = spark.read.parquet(outcome).groupBy(F.lit("outcome").alias("what"), F.col("outcome").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return replaced.unionByName(spark.createDataFrame(rows, "what string, part string, n long")).unionByName(split).unionByName(sides)


@query("embeddings", sql="""
    WITH v AS (SELECT vec_id, len(embedding) // 4 AS n, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT 's' || vec_id AS study, k::INT AS k, n::INT AS n, [1.0, 1.0, 2.0]::DOUBLE[] AS spacing,
           [e[4 * (n - 1 - k) + 3], e[4 * (n - 1 - k) + 4], e[4 * (n - 1 - k) + 1], e[4 * (n - 1 - k) + 2]] AS "values" FROM v, unnest(range(n)) t(k)""")
def q76_volume_slices(embeddings):
    """Vectors as volumes of two by two voxels a slice, whose first axis runs to the left; their slices from the head down."""
    spark, folder = embeddings.sparkSession, shared_dir(embeddings.sparkSession, "volumes")
    ship(spark)

    def packed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bodies = [volumes.encode(np.array(v, np.float32)[: len(v) // 4 * 4].reshape(2, 2, -1, order="F"), np.diag([-1.0, 1.0, 2.0, 1.0]), (1.0, 1.0, 2.0)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["name", "body"])

    named = embeddings.select(readers.volume_name(F.concat(F.lit("s"), F.col("vec_id").cast("string")), F.lit("1")).alias("name"), "embedding")
    sinks.write_files(named.mapInArrow(packed, "name string, body binary"), folder, "name", "body")
    read = readers.volumes(spark, folder, "*.nii.gz", volumes.slices, volumes.SCHEMA)
    return read.select("study", "k", "n", "spacing", "values")


@query("embeddings", sql="""
    WITH v AS (SELECT vec_id, len(embedding) // 4 AS n, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id >= 100)
    SELECT 's' || vec_id AS study, k::INT AS k, n::INT AS n, [e[4 * k + 2], e[4 * k + 1], e[4 * k + 4], e[4 * k + 3]] AS "values" FROM v, unnest([0, 3, 9]) t(k) WHERE k < n AND 's' || vec_id > 's2'""")
def q124_lazy_slices(embeddings):
    """Vectors as uncompressed volumes from the head down; three slices of the studies past s2, read without the rest."""
    spark, folder = embeddings.sparkSession, shared_dir(embeddings.sparkSession, "lazy-volumes")
    ship(spark)

    def written_as(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bodies = [volumes.encode(np.array(v, np.float32)[: len(v) // 4 * 4].reshape(2, 2, -1, order="F"), np.diag([1.0, -1.0, -2.0, 1.0]), packed=False) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["name", "body"])

    named = embeddings.where("vec_id >= 100").select(F.concat(F.lit("s"), F.col("vec_id").cast("string"), F.lit("__1.nii")).alias("name"), "embedding")
    sinks.write_files(spread(named).mapInArrow(written_as, "name string, body binary"), folder, "name", "body")
    read = volume_slices(spark, folder, [0, 3, 9], parts=2).where(F.col("study") > "s2")
    return read.select("study", "k", "n", "values")


@query("supplier", sql="""
    SELECT 's' || s_suppkey || '.tif' AS slide, 16 * i AS x, 16 * j AS y, 1.0::DOUBLE AS tissue FROM supplier, range(4) a(i), range(4) b(j) WHERE i <= s_nationkey % 3 AND i + j > 0 AND s_suppkey % 4 > 0""")
def q131_slide_pyramids(supplier):
    """Slides that the manifest does not list yet, as tiled pyramids of two levels; their tiles that hold tissue and are not
    flat, told by the small level and read one by one."""
    spark, folder = supplier.sparkSession, shared_dir(supplier.sparkSession, "pyramids")
    ship(spark)

    def drawn(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bodies = []
            for wide in batch.column(1).to_pylist():
                image = np.full((64, 64), 240, np.uint8)
                image[:, : 16 * (wide + 1)] = np.where(np.add.outer(np.arange(64), np.arange(16 * (wide + 1))) % 2, 60, 30)
                image[:16, :16] = 45  # flat
                bodies.append(slides.encode([image, image[::4, ::4]], 16, deflated=wide == 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["slide", "body"])

    rows = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".tif")).alias("slide"), (F.col("s_nationkey") % 3).alias("wide"), "s_suppkey")
    todo = blocks.untiled(rows, rows.where("s_suppkey % 4 = 0").select("slide"), "slide").select("slide", "wide")
    sinks.write_files(spread(todo).mapInArrow(drawn, "slide string, body binary"), folder, "slide", "body")
    return slides.slide_tiles(spark, folder, least_variance=1).select("slide", "x", "y", "tissue")


@query("events", "customer", sql="""
    SELECT 'date' AS what, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' UNION ALL SELECT 'shared', count(*) FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
    UNION ALL SELECT 'cells', count(DISTINCT c_mktsegment) * (SELECT count(DISTINCT event_type) FROM events) FROM customer""")
def q77_times_and_cells(events, customer):
    """Times read back from text with fractions, keys that two tables share, and a grid of conditions."""
    later = events.where(parse_time(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25Z"))) >= F.lit("2024-01-15").cast("timestamp_ntz"))
    one = lambda df, what: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    a, b = (events.where(F.col("event_type") == t).select("user_id").distinct() for t in ("error", "signup"))
    grid = joins.cells(customer.select("c_mktsegment").distinct(), events.select("event_type").distinct())
    return one(later, "date").unionByName(one(joins.matched(a, b, ["user_id"])[0], "shared")).unionByName(one(grid, "cells"))


@query("supplier", sql="""
    SELECT 's' || s_suppkey || '.pgm' AS slide, 16 * i AS x, 16 * j AS y, 1.0::DOUBLE AS tissue FROM supplier, range(4) a(i), range(4) b(j) WHERE i <= s_nationkey % 3 AND s_suppkey % 4 > 0""")
def q123_slide_tiles(supplier):
    """Slides that the manifest does not list yet, cut into tiles that hold tissue."""
    spark, folder = supplier.sparkSession, shared_dir(supplier.sparkSession, "slides")
    dark, bright = F.lit(b"\x28"), F.lit(b"\xf0")
    wide = lambda pixel, n: F.array_join(F.array_repeat(F.hex(pixel), n), "")
    line = F.concat(wide(dark, (F.col("s_nationkey") % 3 + 1) * 16), wide(bright, (3 - F.col("s_nationkey") % 3) * 16))
    body = F.concat(F.lit(b"P5 64 64 255\n"), F.unhex(F.array_join(F.array_repeat(line, 64), "")))
    slides = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".pgm")).alias("slide"), "s_suppkey", body.alias("body"))
    manifest = slides.where("s_suppkey % 4 = 0").select("slide")
    sinks.write_files(blocks.untiled(slides, manifest, "slide"), folder, "slide", "body")

    def cut(content, name):
        return [{"slide": name, "x": x, "y": y, "tissue": share} for x, y, share in blocks.tiles(volumes.read_pgm(content), 16)]

    ship(spark)
    return readers.volumes(spark, folder, "*.pgm", cut, "slide string, x long, y long, tissue double")
