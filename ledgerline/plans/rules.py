"""Rules over rows and tables: projections, labels, joins with checks, rendering, contracts, serving, configuration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructType

from ledgerline.functions import answers, arrays, dates, text
from ledgerline.operators import blocks, contracts, filters, joins, metrics, postings, retrieval, sampling, serving, survival, timeline
from ledgerline.plans import config
from ledgerline.plans.register import query
from ledgerline.shipping import ship

r6 = lambda c: F.round(c, 6)
big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")
n_rows = lambda: F.count(F.lit(1)).alias("n")


@query("documents", "nation", "region", sql="""
    SELECT 'placeholder' AS rule, count(*) FILTER (WHERE text IS NOT NULL AND NOT contains(lower(text), 'tion')) AS n FROM documents
    UNION ALL SELECT 'with source', count(*) FILTER (WHERE trim(source) <> '' AND lang = 'en') FROM documents
    UNION ALL SELECT 'without source', count(*) FILTER (WHERE NOT coalesce(trim(source) <> '' AND lang = 'en', false)) FROM documents
    UNION ALL SELECT 'arm', count(*) FILTER (WHERE lang IN ('en', 'fr')) FROM documents
    UNION ALL SELECT 'fallback', count(*) FROM nation""")
def q78_row_rules(documents, nation, region):
    """Placeholder texts, a partition in two, an arm's splits, and the first source that has all columns."""
    one = lambda df, rule: df.agg(F.lit(rule).alias("rule"), n_rows())
    split = filters.resolve_column(documents, "LANG")
    yes, no = filters.two_way(documents, text.populated(F.col(filters.resolve_column(documents, "ourc", partial=True))) & filters.split_is(F.col(split), "en"))
    arm = documents.where(filters.split_is(F.col(split), *config.arm_splits("images", {"images": ["en", "fr"]})))
    chosen = filters.first_strict([lambda: region, lambda: nation], ["n_nationkey", "n_name"])
    parts = [one(documents.where(filters.without_placeholder(F.col("text"), "TION")), "placeholder"), one(yes, "with source"), one(no, "without source"), one(arm, "arm"), one(chosen, "fallback")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("documents", sql="""
    WITH d AS (SELECT doc_id, doc_id % 5 - 1 AS label FROM documents)
    SELECT label, count(*) FILTER (WHERE label <> -1) AS kept, any_value(CASE label WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 END)::INT AS two_way,
           any_value(CASE label WHEN 0 THEN 'stable' WHEN 1 THEN 'worse' ELSE label || '.0' END) AS answer, any_value(CASE label WHEN 0 THEN '0' WHEN 1 THEN '1' END) AS back FROM d GROUP BY label""")
def q79_label_rules(documents):
    """Excluded labels of mixed types, four classes to two, labels to answers and back."""
    mapping = {"0": "stable", "1": "worse"}
    label = (F.col("doc_id") % 5 - 1)
    d = documents.select(big(label).alias("label"), label.cast("double").cast("string").alias("t"))
    kept = ~answers.excluded_label(F.col("t"), [-1])
    answer = answers.answer_of(F.col("t"), mapping)
    rows = d.select("label", kept.alias("kept"), answers.recoded(F.col("label"), {0: 0, 1: 1, 2: 0, 3: 1}).alias("two_way"), answer.alias("answer"), answers.label_of(answer, mapping).alias("back"))
    return rows.groupBy("label").agg(F.count_if("kept").alias("kept"), F.max("two_way").alias("two_way"), F.max("answer").alias("answer"), F.max("back").alias("back"))


@query("orders", sql="""
    WITH a AS (SELECT o_orderkey, o_orderpriority AS label, o_totalprice > 100000 AS hit FROM orders WHERE o_custkey % 2 = 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END AS label, o_totalprice > 150000 AS hit FROM orders WHERE o_custkey % 3 = 0)
    SELECT count(*) AS shared, count(*) FILTER (WHERE a.label <> b.label) AS clashes, round(avg(a.hit::INT), 6) AS rate_a, round(avg(b.hit::INT), 6) AS rate_b FROM a JOIN b USING (o_orderkey)""")
def q80_matched_rows(orders):
    """Two arms on the rows that both have, and where their labels differ."""
    a = orders.where("o_custkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("label"), (F.col("o_totalprice") > 100000).alias("hit"))
    b = orders.where("o_custkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderpriority")).alias("label"), (F.col("o_totalprice") > 150000).alias("hit"))
    ma, mb = joins.matched(a, b, ["o_orderkey"])
    rate = lambda df, name: df.agg(r6(F.avg(F.col("hit").cast("int"))).alias(name))
    return joins.label_clashes(a, b, ["o_orderkey"], "label").crossJoin(rate(ma, "rate_a")).crossJoin(rate(mb, "rate_b"))  # one row each


@query("customer", "orders", sql="""
    SELECT c_mktsegment, count(*) AS n, sum(n_orders)::BIGINT AS orders FROM customer JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) USING (c_custkey) GROUP BY c_mktsegment""")
def q81_one_to_one(customer, orders):
    """A join in which no key repeats on either side."""
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return joins.one_to_one(customer.select("c_custkey", "c_mktsegment"), per, ["c_custkey"]).groupBy("c_mktsegment").agg(n_rows(), F.sum("n_orders").alias("orders"))


@query("embeddings", sql="""
    WITH h AS (SELECT vec_id, embedding[len(embedding) // 2 + 1:]::DOUBLE[] AS v FROM embeddings), m AS (SELECT v AS master FROM h ORDER BY vec_id LIMIT 1)
    SELECT vec_id FROM h, m WHERE list_cosine_similarity(v, master) > 0.1""")
def q82_vector_filter(embeddings):
    """Rows whose second half is like a master vector."""
    half = arrays.second_half(F.col("embedding"))
    master = embeddings.select("vec_id", half.alias("v")).agg(F.min_by("v", "vec_id").alias("v"))
    return joins.alike(embeddings, half, master, "v", 0.1).select("vec_id")


@query("labels", "documents", sql="""
    WITH t AS (SELECT doc_id, 'quality' AS task, quality AS label FROM labels), k AS (SELECT DISTINCT doc_id FROM t),
    fresh AS (SELECT doc_id, 'toxic' AS task, toxic AS label FROM labels UNION ALL SELECT doc_id, 'quality', quality FROM labels),
    u AS (SELECT * FROM t UNION ALL SELECT * FROM fresh f WHERE doc_id IN (SELECT doc_id FROM k) AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = f.doc_id AND t.task = f.task))
    SELECT task, count(*) AS n, sum(label)::BIGINT AS total, CASE task WHEN 'toxic' THEN 'Is it toxic?' ELSE 'old ' || task END AS question FROM u GROUP BY task""")
def q83_append_absent(labels, documents):
    """Rows of known entities whose key is not there yet, and a registry's text where it has one."""
    table = labels.select("doc_id", F.lit("quality").alias("task"), F.col("quality").alias("label"))
    new = labels.select("doc_id", F.inline(F.array(F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("label")), F.struct(F.lit("quality").alias("task"), F.col("quality").alias("label")))))
    known = joins.restrict(new, table.select("doc_id").distinct(), ["doc_id"])
    both = joins.append_absent(table, known, ["doc_id", "task"])
    registry = labels.sparkSession.createDataFrame([("toxic", "Is it toxic?"), ("quality", "  ")], "task string, registered string")
    told = both.withColumn("question", F.concat(F.lit("old "), F.col("task"))).join(registry, "task", "left")
    return told.groupBy("task", joins.override("question", "registered").alias("question")).agg(n_rows(), big(F.sum("label")).alias("total"))


@query("events", sql="""
    WITH a AS (SELECT user_id, date_trunc('day', max(ts)) AS anchor FROM events GROUP BY user_id), notes AS (SELECT user_id, event_id FROM events WHERE event_type IN ('error', 'view')),
    l AS (SELECT e.user_id, e.ts, e.event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] | NOTE: ' || trim(regexp_replace(event_type || '  ' || props, '\\s+', ' ', 'g')) AS line
          FROM events e JOIN a USING (user_id) JOIN notes n ON n.user_id = e.user_id AND n.event_id = e.event_id WHERE ts BETWEEN anchor - INTERVAL 14 DAY AND anchor)
    SELECT user_id, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY ts, event_id)) AS report FROM l GROUP BY user_id""")
def q84_note_events(events):
    """Events in a window before each row's anchor, of the row's notes only, as a report."""
    rows = events.groupBy("user_id").agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("anchor"))
    notes = events.where(F.col("event_type").isin("error", "view")).select("user_id", "event_id")
    met = joins.events_of_notes(rows, notes, events, ["user_id"], "user_id", "event_id", "ts", "anchor", "14d")
    line = text.note_line(F.concat_ws("  ", "event_type", "props"), F.col("ts"))
    report = timeline.ordered_text(met, ["user_id"], [F.col("ts"), F.col("event_id")], line, "report")
    return report.join(met.groupBy("user_id").agg(n_rows()), "user_id").select("user_id", "n", F.sha2(F.col("report").cast("binary"), 256).alias("report"))


@query("lineitem", sql="""
    SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE late) AS of_marked FROM (SELECT *, bool_or(l_discount > 0.09) OVER (PARTITION BY l_orderkey) AS late FROM lineitem) GROUP BY ALL""")
def q85_group_any(lineitem):
    """Rows with whether any row of their order has the flag."""
    rows = filters.group_any(lineitem, ["l_orderkey"], F.col("l_discount") > 0.09, "late")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(n_rows(), F.count_if("late").alias("of_marked"))


@query("lineitem", sql="""
    WITH seen AS (SELECT l_returnflag AS task, l_linestatus AS arm, l_extendedprice AS cost FROM lineitem WHERE l_returnflag <> 'N'), e AS (SELECT l_returnflag AS task, l_linestatus AS arm, count(*) AS n FROM lineitem GROUP BY ALL),
    t AS (SELECT task, arm, avg(cost) AS own FROM seen GROUP BY ALL), a AS (SELECT arm, avg(cost) AS rate FROM seen GROUP BY arm)
    SELECT e.task, e.arm, n, round(coalesce(own, rate), 4) AS rate, round(coalesce(own, rate) * n, 0) AS forecast FROM e LEFT JOIN t ON t.task = e.task AND t.arm = e.arm LEFT JOIN a ON a.arm = e.arm""")
def q86_cost_forecast(lineitem):
    """Mean cost a row by task and arm, of the arm where a task was not run, times the eligible rows."""
    rows = lineitem.select(F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("arm"), F.col("l_extendedprice").alias("cost"))
    out = metrics.cost_forecast(rows.where("task <> 'N'"), rows.groupBy("task", "arm").agg(n_rows()), "task", "arm", "cost", "n")
    return out.select("task", "arm", "n", F.round("rate", 4).alias("rate"), F.round("forecast", 0).alias("forecast"))


@query("conversations", "events", sql=r"""
    WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL)
    SELECT 'words' AS what, conv_id AS a, turn AS b, array_to_string(list_transform(list_filter(list_zip(w, range(len(w))), lambda z: list_position(w, z[1]) = z[2] + 1), lambda z: z[1]), ' ') AS c FROM w
    UNION ALL SELECT DISTINCT 'pair', user_id, weekofyear(ts), event_type FROM events""")
def q87_ordered_distinct(conversations, events):
    """Words in order of first use, and distinct triples."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    first = conversations.where("text IS NOT NULL").select(F.lit("words").alias("what"), F.col("conv_id").alias("a"), F.col("turn").alias("b"), F.array_join(F.array_distinct(words), " ").alias("c"))
    return first.unionByName(events.select(F.lit("pair").alias("what"), F.col("user_id").alias("a"), big(F.weekofyear("ts")).alias("b"), F.col("event_type").alias("c")).distinct())


@query("events", sql="""
    WITH e AS (SELECT DISTINCT user_id % 25 AS person, CASE WHEN event_id % 11 > 0 THEN event_id END AS id, CASE WHEN event_id % 5 > 0 THEN ts END AS t, CASE WHEN event_id % 3 > 0 THEN event_type END AS code,
                      CASE WHEN event_id % 4 > 0 THEN props ELSE ' ' END AS name, 'kind' AS kind, CASE WHEN event_id % 2 = 0 THEN 'v' || event_id END AS v FROM events),
    l AS (SELECT person, id, coalesce(strftime(date_trunc('minute', t), '%Y-%m-%d %H:%M'), '') AS o, concat_ws(' | ', coalesce('[' || strftime(t, '%Y-%m-%d %H:%M') || ']', '[unknown]'),
             coalesce(nullif(concat_ws(' ', code, '(' || nullif(trim(name), '') || ')'), ''), kind), 'VALUE: ' || v) AS line FROM e WHERE id IS NOT NULL)
    SELECT person, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY o, id)) AS digest FROM l GROUP BY person""")
def q88_retrieved_lines(events):
    """Retrieved events without repeats and null ids; unknown times first, name or kind where there is no code."""
    e = events.select((F.col("user_id") % 25).alias("person"), F.when(F.col("event_id") % 11 > 0, F.col("event_id")).alias("id"), F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("t"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("code"), F.when(F.col("event_id") % 4 > 0, F.col("props")).otherwise(F.lit(" ")).alias("name"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("v"))
    line = text.retrieved_line(F.col("t"), F.col("code"), F.col("name"), F.lit("kind"), F.col("v"))
    twice = e.unionByName(e.where("id % 7 = 0")).withColumn("minute", F.date_format("t", "yyyy-MM-dd HH:mm"))
    told = timeline.distinct_events(twice, ["person"], "id", "minute", line)
    return told.select("person", big(F.size(F.split("patient_string", "\n"))).alias("n"), F.sha2(F.col("patient_string").cast("binary"), 256).alias("digest"))


@query("orders", sql="""
    WITH p AS (SELECT o_custkey AS person, min(o_orderdate) AS birth, max(o_orderdate) + INTERVAL 30 YEAR AS upto FROM orders GROUP BY 1)
    SELECT person, 'PATIENT: age ' || CASE WHEN person % 4 = 0 THEN 'unknown' ELSE (year(upto) - year(birth) - ((month(upto), day(upto)) < (month(birth), day(birth)))::INT)::VARCHAR END
           || ' years at the prediction time; sex ' || CASE person % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END || '.' AS header FROM p""")
def q90_demographics(orders):
    """A header with age and sex from pseudo-events; unknown where there is none."""
    p = orders.groupBy(F.col("o_custkey").alias("person")).agg(F.min("o_orderdate").alias("birth"), (F.max("o_orderdate") + F.make_ym_interval(F.lit(30))).alias("at"))
    sex = F.concat(F.lit("Gender/"), F.when(F.col("person") % 3 == 0, "8507").when(F.col("person") % 3 == 1, "8532").otherwise("0"))
    rows = F.array(F.struct(F.when(F.col("person") % 4 > 0, "MEDS_BIRTH").otherwise("other").alias("code"), F.lit(0).alias("ord")), F.struct(sex.alias("code"), F.lit(1).alias("ord")))
    events = p.select("person", "birth", "at", F.inline(rows))
    return timeline.demographics_of(events, ["person"], "code", "birth", [F.col("birth"), F.col("ord")], F.col("at"), {"8507": "male", "8532": "female"})


@query("conversations", sql=r"""
    WITH k AS (SELECT conv_id, turn, list_filter(list_transform(string_split(w || ', x <y>, ' || w || ' b, , task', ','), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, '<') AND len(x) <= 50)[1:3] AS own FROM (SELECT conv_id, turn, coalesce(regexp_extract(text, '^\s*([a-zA-Z]+)', 1), '') AS w FROM conversations))
    SELECT conv_id, turn, own, list_filter(list_distinct_ordered, lambda x: x <> '' AND lower(x) <> 'task')[1:3] AS padded FROM (SELECT *, list_transform(list_filter(list_zip(list_concat(own, ['task', 'more', 'words']), range(len(own) + 3)), lambda z: list_position(list_concat(own, ['task', 'more', 'words']), z[1]) = z[2] + 1), lambda z: z[1]) AS list_distinct_ordered FROM k)""")
def q91_keywords(conversations):
    """Keywords from a comma list without marked-up items; those already searched go, and fallbacks fill up."""
    w = F.coalesce(F.regexp_extract("text", r"^\s*([a-zA-Z]+)", 1), F.lit(""))
    own = answers.keywords(F.concat(w, F.lit(", x <y>, "), w, F.lit(" b, , task")), 3)
    pad = answers.padded_keywords(F.col("own"), F.array(*map(F.lit, ["task", "more", "words"])), F.array(F.lit("task")), 3)
    return conversations.select("conv_id", "turn", own.alias("own")).withColumn("padded", pad)


@query("conversations", sql="""
    SELECT turn, count(*) AS n, count(*) FILTER (WHERE turn % 3 = 0) AS yes, count(*) FILTER (WHERE turn % 3 = 1) AS no, count(*) FILTER (WHERE turn % 2 = 0) AS forced FROM conversations GROUP BY turn""")
def q92_yes_no(conversations):
    """The last stated final answer, and a forced answer as a word or in JSON."""
    t = F.col("turn")
    said = F.concat(F.lit("Final answer: no. "), F.coalesce(F.substring("text", 1, 30), F.lit("")), F.when(t % 3 == 0, " FINAL ANSWER: **Yes**").when(t % 3 == 1, " final answer:no").otherwise(" final answer: perhaps"))
    word = F.when(t % 3 < 2, answers.final_answer(said))
    forced = answers.schema_answer(F.when(t % 4 == 0, " YES ").when(t % 4 == 2, '{"answer": "No"}').otherwise("yes or no"))
    rows = conversations.select("turn", word.alias("w"), forced.alias("f"))
    return rows.groupBy("turn").agg(n_rows(), F.count_if(F.col("w") == "yes").alias("yes"), F.count_if(F.col("w") == "no").alias("no"), F.count("f").alias("forced"))


@query("events", sql="""
    WITH p AS (SELECT user_id, list(abs(round(value, 3)) ORDER BY event_id) AS v, list(event_id ORDER BY event_id) AS i FROM (SELECT * FROM events WHERE value IS NOT NULL) GROUP BY user_id)
    SELECT user_id, list_transform(range(1, len(v) + 1), lambda k: list_min(v[1:k])) AS repaired, coalesce(list_bool_and(list_transform(range(2, len(v) + 1), lambda k: v[k - 1] < v[k])), true) AS increasing FROM (SELECT * FROM p UNION ALL SELECT -user_id - 1, list_sort(list_distinct(v)), i FROM p)""")
def q94_monotone(events):
    """Running minimum of a curve, and whether its values strictly increase in the order of its points: of each user's
    values as they came, and of the distinct ones in order."""
    came = events.where("value IS NOT NULL").select("user_id", "event_id", F.abs(F.round("value", 3)).alias("v"))
    sorted_ = came.groupBy((-F.col("user_id") - 1).alias("user_id"), "v").agg(F.min("event_id").alias("x")).select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("v")).cast("bigint").alias("event_id"), "v")
    rows = came.unionByName(sorted_)
    curve = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda z: z["v"]).alias("c"))
    up = survival.is_monotone(rows.withColumn("pos", F.col("event_id")), ["user_id"], "v")
    return curve.select("user_id", survival.monotone(F.col("c")).alias("repaired")).join(up, "user_id")


@query("events", sql="""
    WITH q AS (SELECT user_id, 5 AS k, list_contains(['error'], event_type) AS y, abs(value) AS s FROM events),
    c AS (SELECT user_id, s, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM q GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT user_id, round(coalesce(sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0), 0.5), 9) AS auroc FROM b GROUP BY user_id""")
def q96_auroc_missing(events):
    """AUROC per user, 0.5 where a class is missing."""
    a = metrics.auroc(events, (F.col("event_type") == "error").cast("int"), F.abs("value"), ["user_id"], missing=0.5)
    return a.select("user_id", F.round("auroc", 9).alias("auroc"))


@query("embeddings", sql="""
    WITH e AS (SELECT vec_id, label % 5 AS y, vec_id % 2 AS arm, CASE WHEN vec_id % 9 > 0 THEN list_transform(embedding[1:5], lambda x: abs(round(x::DOUBLE, 2))) END AS p FROM embeddings),
    l AS (SELECT arm, y, i - 1 AS c, p[i] AS s FROM e, unnest(range(1, 6)) t(i) WHERE p IS NOT NULL),
    c AS (SELECT arm, c, s, count(*) FILTER (WHERE y = c) AS pos, count(*) FILTER (WHERE y <> c) AS neg FROM l GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY arm, c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
    a AS (SELECT arm, avg(v) AS auroc FROM (SELECT arm, c, sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0) AS v FROM b GROUP BY ALL) GROUP BY arm),
    r AS (SELECT vec_id, i - 1 AS c, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS k FROM e, unnest(range(1, 6)) t(i) WHERE p IS NOT NULL),
    t AS (SELECT e.arm, e.y, e.vec_id, coalesce(bool_or(k = 1 AND c = y), false) AS top1, coalesce(bool_or(k <= 2 AND c = y), false) AS top2 FROM e LEFT JOIN r USING (vec_id) GROUP BY ALL)
    SELECT arm, round(any_value(auroc), 9) AS auroc, round(avg(recall), 9) AS balanced_accuracy, round(any_value(two), 9) AS top_two
    FROM (SELECT arm, y, avg(top1::INT) AS recall FROM t GROUP BY ALL) JOIN (SELECT arm, avg(top2::INT) AS two FROM t GROUP BY arm) USING (arm) JOIN a USING (arm) GROUP BY arm""")
def q97_option_scores(embeddings):
    """Answers that share 1 out over five options: AUROC, balanced accuracy of the top pick, truth among the top two."""
    p = F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(F.round(x.cast("double"), 2)))
    rows = embeddings.select((F.col("vec_id") % 2).alias("arm"), (F.col("label") % 5).alias("y"), F.when(F.col("vec_id") % 9 > 0, p).alias("p"))
    return metrics.option_scores(rows, "y", "p", range(5), ["arm"]).select("arm", *[F.round(c, 9).alias(c) for c in ("auroc", "balanced_accuracy", "top_two")])


@query("lineitem", sql="""
    WITH r AS (SELECT l_linestatus, l_returnflag, l_discount * 5 AS near, l_tax * 6 AS far FROM lineitem)
    SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE near > far) AS near_above_far, count(*) FILTER (WHERE near >= 0.25 AND NOT far >= 0.25) AS yes_then_no FROM r GROUP BY l_linestatus""")
def q101_contradictions(lineitem):
    """Answers that contradict themselves over two horizons."""
    near, far = F.col("l_discount") * 5, F.col("l_tax") * 6
    return metrics.horizon_conflicts(lineitem, near, far, near >= 0.25, far >= 0.25, ["l_linestatus"])


@query("lineitem", sql="""
    SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag""")
def q102_least_squares(lineitem):
    """A least-squares line per group from sums."""
    fit = metrics.least_squares(lineitem, "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    return fit.select("l_returnflag", F.round("intercept", 4).alias("intercept"), F.round(F.get("coefficients", F.lit(0)), 4).alias("slope"))


@query("embeddings", sql="""
    WITH c AS (SELECT vec_id, i, round(embedding[i]::DOUBLE, 2) AS s FROM embeddings, unnest(range(1, 9)) t(i)), m AS (SELECT i, avg(s) AS m FROM c GROUP BY i),
    f AS (SELECT vec_id, max(abs(s - m)) <= 0.15 AS near FROM c JOIN m USING (i) GROUP BY vec_id)
    SELECT count(*) AS n, count(*) FILTER (WHERE near) AS near_average, (SELECT count(DISTINCT list_transform(embedding[1:8], lambda x: round(x::DOUBLE, 2))) FROM embeddings) AS "distinct" FROM f""")
def q103_curve_counts(embeddings):
    """Curves near the mean curve everywhere, and distinct ones."""
    return metrics.curve_counts(embeddings.select(F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double"), 2)).alias("c")), "c", 0.15)


@query("documents", folder=True, sql="""
    WITH tok AS (SELECT source, CASE WHEN doc_id % 10 > 0 THEN doc_id END AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), own AS (SELECT * FROM tok WHERE id IS NOT NULL),
    st AS (SELECT source, count(*) AS n, avg(len(w)) AS avg_dl FROM own GROUP BY source),
    p AS (SELECT source, id, len(w) AS dl, term, count(*) AS tf FROM (SELECT source, id, w, unnest(w) AS term FROM own) WHERE term IN ('hend', 'und', 'the') GROUP BY ALL),
    s AS (SELECT p.source, id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)) AS score FROM p JOIN (SELECT source, term, count(*) AS df FROM p GROUP BY ALL) f ON f.source = p.source AND f.term = p.term JOIN st ON st.source = p.source),
    h AS (SELECT source, id, term FROM (SELECT *, row_number() OVER (PARTITION BY source, term ORDER BY round(score, 9) DESC, id) AS r FROM s) WHERE r <= 2)
    SELECT source, id, list_sort(list(DISTINCT term)) AS terms FROM h GROUP BY ALL
    UNION ALL SELECT source, id, list_sort(list_filter(['hend', 'und', 'the'], lambda x: list_contains(w, x))) FROM tok WHERE id IS NULL AND list_has_any(w, ['hend', 'und', 'the'])""")
def q104_term_hits(folder, documents):
    """The best two documents of each term by itself, hits without an id all kept."""
    d = documents.select("source", F.when(F.col("doc_id") % 10 > 0, F.col("doc_id")).alias("id"), "text")
    index = postings.index_of(d, f"{folder}/documents with ids", "id", "source", "text")
    return index.search_each(["hend", "und", "the"], 2).select(F.col("part").alias("source"), F.col("key").alias("id"), "terms")


@query("conversations", sql="""
    WITH g AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS steps FROM conversations GROUP BY conv_id)
    SELECT conv_id || '-' || i AS index, i::INT AS iteration, sha256('Q: why? ' || CASE WHEN conv_id % 3 = 0 THEN 'stored ' || conv_id ELSE steps[i + 1] END || ' END') AS prompt, substr(steps[i + 1], 1, 20) AS summary FROM g, unnest(range(len(steps))) t(i)""")
def q105_iterations(conversations):
    """One row an iteration with its index; timelines stored by an earlier run; a summary; the prompt."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda z: z["text"])
    rows = retrieval.per_iteration(conversations.groupBy("conv_id").agg(steps.alias("steps")), "steps", [F.col("conv_id")])
    cache = rows.where("conv_id % 3 = 0").select("index", F.concat(F.lit("stored "), F.col("conv_id").cast("string")).alias("step"))
    told = retrieval.summarised(rows, "step", lambda texts: [t[:20] for t in texts], 10).withColumn("summary", F.coalesce("summary", F.lit("")))
    told = retrieval.with_cached(told, cache, ["index"], "step")
    prompt = text.template_prompt(F.lit("Q: [QUESTION] [PATIENT_TIMELINE] END"), {"QUESTION": F.lit("why?"), "PATIENT_TIMELINE": F.col("step")})
    return told.select("index", "iteration", F.sha2(prompt.cast("binary"), 256).alias("prompt"), "summary")


@query("embeddings", "part", sql="""
    SELECT 'vector' AS what, vec_id AS id, list_sum(list_transform(embedding, lambda v: round_even((least(greatest(v::DOUBLE, -0.2), 0.2) + 0.2) / 0.4 * 255.0, 0)))::BIGINT AS a, list_sum(list_transform(embedding, lambda v: round_even((least(greatest(v::DOUBLE, -0.1), 0.3) + 0.1) / 0.4 * 255.0, 0)))::BIGINT AS b FROM embeddings
    UNION ALL SELECT 'part', p_partkey, (SELECT max(c) FROM (VALUES (1), (4), (16), (64), (256)) v(c) WHERE c * (ceil(p_size * 100 / 3) * 4) <= 20000)::BIGINT, p_size::BIGINT FROM part""")
def q107_windows_and_sizes(embeddings, part):
    """Values through three windows, how many images fit a request, and every index of a depth."""
    rgb = arrays.three_windows(F.col("embedding"), [(-0.2, 0.2), (-0.1, 0.3), (0.0, 1.0)])
    total = lambda c: F.aggregate(F.transform("rgb", lambda z: z[c]), F.lit(0).cast("bigint"), lambda s, v: s + v)
    v = embeddings.select("vec_id", rgb.alias("rgb")).select(F.lit("vector").alias("what"), F.col("vec_id").alias("id"), total("r").alias("a"), total("g").alias("b"))
    fit = arrays.fitting_count(F.col("p_size") * 100, 20000, [1, 4, 16, 64, 256])
    p = part.select(F.lit("part").alias("what"), F.col("p_partkey").alias("id"), big(fit).alias("a"), big(F.size(arrays.every_index(F.col("p_size")))).alias("b"))
    return v.unionByName(p)


@query("part", sql="""
    SELECT p_partkey, sha256('notes of ' || p_name || chr(10) || chr(10) || 'second') AS prompt_sha256, len('notes of ' || p_name || chr(10) || chr(10) || 'second')::BIGINT AS prompt_chars,
           list_transform([0, 0, 0], lambda x, i: sha256('s' || ((i - 1) / 2.0 * (p_size - 1))::INT)) AS image_sha256, 3::BIGINT AS n_images FROM (SELECT * FROM part WHERE p_size % 2 = 1 AND p_size > 2)""")
def q108_content(part):
    """Content blocks by modality, images first, then text, and what each row was shown."""
    rows = part.where("p_size % 2 = 1 AND p_size > 2").select("p_partkey", F.concat(F.lit("notes of "), F.col("p_name")).alias("note"), F.lit("second").alias("more"), F.transform(arrays.every_index(F.col("p_size")), lambda i: F.concat(F.lit("s"), i.cast("string"))).alias("slices"))
    spec = [{"id": "A", "modality": "ehr", "column": "note"}, {"id": "CT", "modality": "ct", "column": "slices", "select": "evenly_spaced_k", "k": 3}, {"id": "B", "modality": "ehr", "column": "more"}]
    return blocks.golden(blocks.assembled(blocks.with_blocks(rows, spec)), ["p_partkey"], "prompt", "images")


@query("part", sql="""
    SELECT p_partkey, p_partkey || CASE WHEN p_size % 3 = 2 THEN '|t2' ELSE '' END AS tasks, CASE p_size % 3 WHEN 0 THEN 'no,yes' ELSE 'low,high' END AS choices, CASE WHEN p_size % 4 < 3 THEN '2 blocks' ELSE 'unknown' END AS preset, CASE WHEN p_size % 5 = 0 THEN 2 ELSE p_size END::BIGINT AS k FROM part""")
def q109_configuration(part):
    """A configuration text a part, resolved: registry entry, preset and variant."""
    ship(part.sparkSession)
    task = F.expr("CASE p_size % 3 WHEN 0 THEN '\"shared_task\": \"t1\"' WHEN 1 THEN '\"shared_task\": \"t2\"' ELSE '\"panel_tasks\": [\"t2\"]' END")
    entry = F.concat(F.lit('{"tasks": [{"task_name": "'), F.col("p_partkey").cast("string"), F.lit('", '), task, F.lit('}], "preset": "'), F.when(F.col("p_size") % 4 < 3, "both").otherwise("other"), F.lit('", "run": {"k": '), F.col("p_size").cast("string"), F.lit('}, "variant": "'), F.when(F.col("p_size") % 5 == 0, "short").otherwise("plain"), F.lit('"}'))
    return part.select("p_partkey", config_of(entry).alias("c")).select("p_partkey", "c.*")


@pandas_udf(StructType().add("tasks", StringType()).add("choices", StringType()).add("preset", StringType()).add("k", LongType()))
def config_of(text: pd.Series) -> pd.DataFrame:
    shared = {"t1": {"label_mapping": {"0": "no", "1": "yes", "-1": "n/a"}, "is_binary": True}, "t2": {"label_mapping": {"1": "high", "0": "low"}, "is_binary": True}}
    rows = []
    for said in text:
        read = config.read_config(said)
        tasks = config.resolve_registry(read["tasks"], shared)
        preset = config.expand_preset(read["preset"], {"both": {"blocks": [1, 2]}})
        rows.append(("|".join(t["task_name"] for t in tasks), ",".join(tasks[-1]["choices"]), "unknown" if preset["unknown"] else f"{len(preset['blocks'])} blocks", config.with_variant(read["run"], {"short": {"k": 2}, "plain": {}}, read["variant"])["k"]))
    return pd.DataFrame(rows, columns=["tasks", "choices", "preset", "k"])


@query("orders", sql="""
    SELECT 'both empty' AS rule, 0::BIGINT AS n UNION ALL SELECT 'out of range', count(*) FILTER (WHERE o_totalprice / 200000 > 1) FROM orders UNION ALL SELECT 'expected', count(*) FROM orders
    UNION ALL SELECT 'present', count(*) FILTER (WHERE o_orderkey % 5 > 0) FROM orders UNION ALL SELECT 'parsed', count(*) FILTER (WHERE o_orderkey % 5 > 0 AND o_orderstatus <> 'P') FROM orders
    UNION ALL SELECT 'error ' || o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderpriority QUALIFY row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) <= 2""")
def q110_layout(orders):
    """Rules counted in one pass, how complete a run is, its most frequent errors; a sound table keeps its layout."""
    p = F.col("o_totalprice") / 200000
    rules = contracts.violations(orders, {"both empty": p.isNull() & F.col("o_orderstatus").isNull(), "out of range": p > 1})
    sound = orders.select("o_orderkey", F.lit("r").alias("run"), F.least(p, F.lit(1.0)).alias("p"), F.col("o_orderstatus").alias("a"))
    contracts.require_layout(sound, ["o_orderkey", "p"], ["o_orderkey"], "run", "p", "a")
    rows = orders.where("o_orderkey % 5 > 0").withColumn("read", F.when(F.col("o_orderstatus") != "P", 1))
    done = contracts.completeness(orders.select("o_orderkey"), rows, ["o_orderkey"], "read").unpivot([], ["expected", "present", "parsed"], "rule", "n")
    errors = contracts.frequent_errors(orders.where("o_orderstatus = 'P'").withColumn("e", F.concat(F.lit("error "), F.col("o_orderpriority"))), "e", 2)
    return rules.unionByName(done).unionByName(errors.select(F.col("e").alias("rule"), "n"))


@query("events", "orders", sql="""
    SELECT 'counts' AS what, user_id AS id, count(*) AS a, count(*) FILTER (WHERE event_type <> 'error') AS b FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') > 0
    UNION ALL SELECT 'value', o_orderkey, 1, 1 FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'one side', o_orderkey, 1, 0 FROM orders WHERE o_orderkey % 50 = 1""")
def q111_reconciled(events, orders):
    """Entities whose rows differ in number after a step, and rows that differ from their source."""
    before, after = events, events.where("event_type <> 'error'")
    counts = contracts.reconciled(before, after, "user_id").select(F.lit("counts").alias("what"), F.col("user_id").alias("id"), F.col("before").alias("a"), F.col("after").alias("b"))
    copy = orders.where("o_orderkey % 50 <> 1").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 50 == 0, 0.5).otherwise(1e-12))
    off = contracts.agrees(orders, copy, ["o_orderkey"], ["o_totalprice"])
    return counts.unionByName(off.select(F.when(F.col("__inb").isNull(), "one side").otherwise("value").alias("what"), F.col("o_orderkey").alias("id"), F.coalesce("__ina", F.lit(0)).cast("bigint").alias("a"), F.coalesce("__inb", F.lit(0)).cast("bigint").alias("b")))


@query("events", sql="""
    WITH r AS (SELECT event_id, event_type AS file, ts::DATE + (event_id % 2)::INT AS date, user_id AS record FROM events WHERE event_id % 7 = 0)
    SELECT file, count(*) AS n, count(*) FILTER (WHERE file IN ('view', 'click')) AS allowed, count(*) FILTER (WHERE date <= DATE '2024-01-20') AS in_time,
           count(*) FILTER (WHERE (record, date) IN (SELECT user_id, ts::DATE FROM events)) AS found FROM r GROUP BY file""")
def q112_cited_evidence(events):
    """Cited dates: from an allowed file, before the cutoff, found in the record."""
    records = events.select(F.col("user_id").alias("record"), F.to_date("ts").alias("date"))
    reasons = events.where("event_id % 7 = 0").select(F.col("event_type").alias("file"), F.date_add(F.to_date("ts"), (F.col("event_id") % 2).cast("int")).alias("date"), F.col("user_id").alias("record"))
    told = contracts.cited_evidence(reasons, records, ["view", "click"], F.lit("2024-01-20").cast("date"))
    return told.groupBy("file").agg(n_rows(), F.count_if("allowed").alias("allowed"), F.count_if("in_time").alias("in_time"), F.count_if("found").alias("found"))


@query("lineitem", sql="""
    WITH r AS (SELECT l_returnflag AS arm, l_quantity > 2 AS header, CASE WHEN l_discount >= 0.1 THEN 1 ELSE 0 END AS after, l_tax >= 0.08 AS kept, l_linenumber AS images, CASE WHEN l_linenumber > 5 THEN 5 ELSE l_linenumber END AS expected, l_quantity AS gap FROM lineitem)
    SELECT arm, count(*) AS n, count(*) FILTER (WHERE header) AS with_header, count(*) FILTER (WHERE after > 0) AS with_later_events, count(*) FILTER (WHERE kept) AS with_report, count(*) FILTER (WHERE images <> expected) AS wrong_images,
           count(*) FILTER (WHERE after > 0 OR NOT header OR kept OR images <> expected) AS broken, quantile_cont(gap, 0.5) AS gap_median, round(quantile_cont(gap, 0.9), 6) AS gap_p90, max(gap) AS gap_max FROM r GROUP BY arm""")
def q113_input_qa(lineitem):
    """What each arm's inputs hold, and how many rows break a rule."""
    rows = lineitem.select(F.col("l_returnflag").alias("arm"), (F.col("l_quantity") > 2).alias("header"), (F.col("l_discount") >= 0.1).cast("int").alias("after"), (F.col("l_tax") >= 0.08).alias("kept"), F.col("l_linenumber").alias("images"), F.least(F.col("l_linenumber"), F.lit(5)).alias("expected"), F.col("l_quantity").alias("gap"))
    return contracts.input_qa(rows, "arm", "header", "after", "kept", "images", "expected", "gap").withColumn("gap_p90", r6("gap_p90"))


@query("customer", "orders", sql="""
    WITH o AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, max(o_orderdate) AS last FROM orders GROUP BY o_custkey),
    r AS (SELECT c_mktsegment AS arm, c_custkey % 9 > 0 AS header, c_custkey % 4 = 0 AS no_age, c_custkey % 7 = 0 AS no_sex, n IS NOT NULL AS rec, coalesce(n > 5, false) AS win, coalesce(last >= TIMESTAMP '2001-01-01', false) AS later, coalesce(n > 8, false) AS gone, coalesce(most > 300000, false) AS cut, CASE WHEN c_custkey % 11 = 0 THEN pending END AS after FROM customer LEFT JOIN o ON o_custkey = c_custkey)
    SELECT arm, count(*) AS n, count(*) FILTER (WHERE header) AS with_header, count(*) FILTER (WHERE header AND NOT no_age) AS age_known, count(*) FILTER (WHERE header AND NOT no_sex) AS sex_known, count(*) FILTER (WHERE rec) AS report_in_record,
           count(*) FILTER (WHERE win) AS report_in_window, count(*) FILTER (WHERE win AND later) AS report_signed_later, count(*) FILTER (WHERE gone) AS report_removed, count(*) FILTER (WHERE cut) AS trimmed, coalesce(sum(after), 0)::BIGINT AS events_after,
           count(*) FILTER (WHERE coalesce(coalesce(after, 0) > 0 OR NOT header OR (win AND NOT gone AND arm <> 'BUILDING'), true)) AS broken FROM r GROUP BY arm""")
def q126_record_qa(customer, orders):
    """What each segment's records hold: headers, reports in record and window, trimmed ones, and how many break a rule."""
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(n_rows(), F.max("o_totalprice").alias("most"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.max("o_orderdate").alias("last"))
    part = lambda k, name, value: F.concat(F.lit(f"{name}: "), F.when(F.col("c_custkey") % k == 0, "unknown").otherwise(value))
    rows = customer.join(per, "c_custkey", "left").select(
        F.col("c_mktsegment").alias("arm"), (F.col("c_custkey") % 9 > 0).alias("header"), F.concat(part(4, "Age", "61"), F.lit(", "), part(7, "Sex", "female")).alias("said"), F.col("n").isNotNull().alias("rec"), (F.col("n") > 5).alias("win"),
        (F.col("last") >= F.lit("2001-01-01").cast("timestamp_ntz")).alias("later"), (F.col("n") > 8).alias("gone"), (F.col("most") > 300000).alias("cut"), F.when(F.col("c_custkey") % 11 == 0, F.col("pending")).otherwise(0).alias("after"),
    )
    return contracts.record_qa(rows.withColumn("after", F.coalesce("after", F.lit(0))), "arm", "header", "said", "rec", "win", "later", "gone", "cut", "after", ["BUILDING"])


@query("embeddings", sql="""
    WITH r AS (SELECT label AS arm, vec_id, list_transform(range(8), lambda i: round(list_max(embedding[8 * i + 1:8 * i + 8]) - list_min(embedding[8 * i + 1:8 * i + 8]), 6)) AS s, 8 - (vec_id % 6 = 0)::INT AS images, CASE WHEN vec_id % 12 = 0 THEN 'broken file' END AS error, vec_id % 3 = 0 AS prior, vec_id % 40 - 2 AS gap FROM embeddings),
    q AS (SELECT *, len(list_filter(s, lambda x: x < 0.3)) AS blank FROM r)
    SELECT arm, count(*) AS cases, count(*) FILTER (WHERE images = 8) AS as_expected, count(error) AS load_errors, count(*) FILTER (WHERE blank > 0) AS with_blank, count(*) FILTER (WHERE prior) AS with_prior, count(*) FILTER (WHERE prior AND gap > 0) AS prior_earlier,
           count(*) FILTER (WHERE (images <> 8 AND error IS NULL) OR (prior AND gap <= 0)) AS broken, quantile_cont(blank, 0.5)::DOUBLE AS blank_median, quantile_cont(gap, 0.5) FILTER (WHERE prior)::DOUBLE AS gap_median FROM q GROUP BY arm""")
def q127_image_qa(embeddings):
    """What each label's images hold, with parts of a vector as slices: counts, load errors, slices nearly blank, priors."""
    part = lambda i: F.slice("embedding", i * 8 + 1, 8)
    spread = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.round((F.array_max(part(i)) - F.array_min(part(i))).cast("double"), 6))
    every = lambda k: F.col("vec_id") % k
    rows = embeddings.select(F.col("label").alias("arm"), spread.alias("s"), (8 - (every(6) == 0).cast("int")).alias("images"), F.lit(8).alias("expected"), F.when(every(12) == 0, "broken file").alias("error"), (every(3) == 0).alias("prior"), (every(40) - 2).alias("gap"))
    return contracts.image_qa(rows, "arm", "images", "expected", "error", "s", "prior", "gap", 0.3)


@query("lineitem", sql="""
    WITH r AS (SELECT l_returnflag, l_linestatus = 'O' AS side, l_extendedprice AS v FROM lineitem),
    p AS (SELECT l_returnflag, v, count(*) FILTER (WHERE side) AS x, count(*) FILTER (WHERE NOT side) AS y FROM r GROUP BY ALL),
    c AS (SELECT l_returnflag, sum(x) OVER w / nullif(sum(x) OVER (PARTITION BY l_returnflag), 0) AS fx, sum(y) OVER w / nullif(sum(y) OVER (PARTITION BY l_returnflag), 0) AS fy FROM p WINDOW w AS (PARTITION BY l_returnflag ORDER BY v))
    SELECT l_returnflag, round(max(abs(fx - fy)), 9) AS ks FROM c GROUP BY l_returnflag""")
def q129_ks_distance(lineitem):
    """Largest gap between the price distributions of two line states, per return flag."""
    rows = lineitem.withColumn("side", F.col("l_linestatus") == "O")
    return metrics.ks_distance(rows, "l_extendedprice", "side", ["l_returnflag"]).select("l_returnflag", F.round("ks", 9).alias("ks"))


@query("events", sql="""
    WITH l AS (SELECT user_id, ts::DATE AS d, '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || event_type AS line, ts, event_id FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, dense_rank() OVER (PARTITION BY user_id ORDER BY d DESC) AS day, sum(len(line) + 1) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS used, sum(len(line) + 1) OVER (PARTITION BY user_id) AS whole FROM l),
    k AS (SELECT user_id, any_value(whole) - 1 <= 400 AS fits, string_agg(line, chr(10) ORDER BY ts, event_id) AS whole, string_agg(line, chr(10) ORDER BY ts, event_id) FILTER (WHERE used <= 400 - 53 - 1) AS newest, string_agg(line, chr(10) ORDER BY ts, event_id) FILTER (WHERE day <= 3) AS days FROM o GROUP BY user_id)
    SELECT user_id, sha256(CASE WHEN fits THEN whole ELSE '[earlier records omitted to fit; the newest are kept]' || chr(10) || newest END) AS latest, sha256(days) AS days FROM k""")
def q130_newest_lines(events):
    """Every user's timeline cut to its newest lines within a budget, and to its last three dates."""
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), F.col("event_type"))
    t = timeline.ordered_text(events, ["user_id"], [F.col("ts"), F.col("event_id")], line, "t")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return t.select("user_id", sha(text.keep_latest(F.col("t"), 400)).alias("latest"), sha(text.last_k_dates(F.col("t"), 3)).alias("days"))


@query("events", sql="""
    WITH r AS (SELECT event_id, 'ask ' || (event_id % 97) AS request FROM events), a AS (SELECT *, CASE WHEN strpos('02468ace', right(sha256(request), 1)) > 0 THEN 'yes' ELSE 'no' END AS reply FROM r)
    SELECT reply, count(*) AS n, count(*) FILTER (WHERE (event_id % 97) % 4 = 0) AS from_cache, count(DISTINCT request) FILTER (WHERE (event_id % 97) % 4 <> 0) AS asked FROM a GROUP BY reply""")
def q114_answer_cache(events):
    """Replies by request hash: stored ones from the cache, each other request asked once."""
    rows = serving.with_request_key(events.select("event_id", F.concat(F.lit("ask "), (F.col("event_id") % 97).cast("string")).alias("request"), (F.col("event_id") % 97).alias("k")), F.col("request"))
    model = serving.adapter("echo", options=("yes", "no"))
    stored = serving.ask(rows.where("k % 4 = 0").select("message_key", "request").distinct(), "request", model).select("message_key", "response_text")
    told, new = serving.ask_with_cache(rows, "request", model, stored, lambda c: c.isNotNull())
    asked = new.groupBy(F.col("response_text").alias("reply")).agg(F.count(F.lit(1)).alias("asked"))
    return told.groupBy(F.col("response_text").alias("reply")).agg(n_rows(), F.count_if("from_cache").alias("from_cache")).join(asked, "reply")


@query("events", sql="""
    WITH w AS (SELECT user_id, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 3 = 0)::INT, event_id) = 1 THEN 0 ELSE 1 END AS wave, CASE WHEN event_id % 4 > 0 THEN event_id % 10 END AS cost FROM events),
    c AS (SELECT *, coalesce(sum(coalesce(cost, m, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT *, avg(cost) OVER (PARTITION BY user_id) AS m FROM w))
    SELECT user_id, count(*) FILTER (WHERE wave = 0) AS leads, min(event_id) FILTER (WHERE wave = 0) AS lead_id, count(*) FILTER (WHERE round(spent, 9) < 40.5) AS allowed FROM c GROUP BY user_id""")
def q115_waves_and_caps(events):
    """A lead question per case first, and what a spend cap lets through."""
    rows = serving.waves(events, "user_id", [F.col("event_id")], F.col("event_id") % 3 == 0)
    rows = serving.within_cap(rows.withColumn("cost", F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 10).cast("double")), ["user_id"], [F.col("event_id")], F.col("cost"), 40.5)
    return rows.groupBy("user_id").agg(F.count_if(F.col("wave") == 0).alias("leads"), F.min(F.when(F.col("wave") == 0, F.col("event_id"))).alias("lead_id"), F.count_if("allowed").alias("allowed"))


@query("part", sql="""
    SELECT p_partkey, CASE WHEN p_size <= 4 THEN list_transform(range(p_size), lambda i: 't' || i) ELSE list_transform(list_sort(list_transform(range(p_size), lambda i: [sha256('tiles:' || p_partkey || ':t' || i), 't' || i]))[1:4], lambda z: z[2]) END AS tiles FROM part""")
def q116_tile_sample(part):
    """Four of each row's tiles in hash order, all where there are no more."""
    rows = part.select("p_partkey", F.transform(arrays.every_index(F.col("p_size")), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("all"))
    return rows.select("p_partkey", sampling.tile_sample("all", "p_partkey", 4, "tiles").alias("tiles"))


@query("orders", sql="""
    SELECT o_orderkey, o_orderdate + INTERVAL 6 MONTH AS later, date_diff('day', o_orderdate, o_orderdate + INTERVAL 6 MONTH)::INT AS gap FROM orders""")
def q117_durations(orders):
    """Times moved by a calendar duration."""
    later = dates.shifted(F.col("o_orderdate"), "6mo", 1)
    return orders.select("o_orderkey", later.alias("later"), F.datediff(later, "o_orderdate").alias("gap"))


@query("lineitem", sql="""
    WITH r AS (SELECT l_linestatus, (l_returnflag = 'R')::INT AS t, CASE WHEN l_tax > 0.01 THEN (l_discount >= 0.05)::INT END AS p FROM lineitem)
    SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE p IS NULL) AS n_unreadable, round(avg((p IS NOT DISTINCT FROM t)::INT), 6) AS accuracy,
           round(avg((p IS NOT DISTINCT FROM 1)::INT) FILTER (WHERE t = 1), 6) AS sensitivity, round(avg((p IS NOT DISTINCT FROM 0)::INT) FILTER (WHERE t = 0), 6) AS specificity FROM r GROUP BY l_linestatus""")
def q118_forced_binary(lineitem):
    """Two classes with unreadable predictions: they are wrong, and counted."""
    rows = lineitem.select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("t"), F.when(F.col("l_tax") > 0.01, (F.col("l_discount") >= 0.05).cast("int")).alias("p"))
    m = metrics.forced_answer(rows, "t", "p", ["l_linestatus"], binary=(0, 1))
    return m.select("l_linestatus", "n", "n_unreadable", *[r6(c).alias(c) for c in ("accuracy", "sensitivity", "specificity")])


@query("part", sql="""
    WITH d AS (SELECT p_partkey, p_size AS n FROM part)
    SELECT p_partkey, range(n)::BIGINT[] AS every, CASE WHEN n <= 7 THEN range(n) ELSE list_transform(range(7), lambda i: floor(i / 6.0 * (n - 1))::BIGINT) END AS few,
           list_sort(list_distinct(list_transform(range(5), lambda j: round_even(round_even(0.2 * (n - 1), 0) + (round_even(0.8 * (n - 1), 0) - round_even(0.2 * (n - 1), 0)) * j / 4.0, 0)::BIGINT))) AS part_ FROM d""")
def q120_selectors(part):
    """Index generators by name."""
    pick = lambda name, **k: arrays.SELECTORS[name](F.col("p_size"), **k)
    return part.select("p_partkey", pick("all").alias("every"), pick("up_to_k", k=7).alias("few"), pick("fraction_range", count=5, low=0.2, high=0.8).alias("part_"))


@query("embeddings", sql="""
    SELECT vec_id FROM embeddings WHERE vec_id % 10 IN (3, 7)""")
def q121_pack_check(embeddings):
    """Rendered images whose bytes are gone or differ from the manifest's."""
    pixels = embeddings.select("vec_id", F.concat_ws(",", F.transform(arrays.min_max_bytes(F.col("embedding")), lambda v: v.cast("string"))).cast("binary").alias("content"))
    manifest = pixels.select("vec_id", F.sha2("content", 256).alias("sha256"))
    pack = pixels.where("vec_id % 10 <> 3").withColumn("content", F.when(F.col("vec_id") % 10 == 7, F.lit("other").cast("binary")).otherwise(F.col("content")))
    return blocks.damaged(pack, manifest, "vec_id", "content")


@query("orders", sql="""
    WITH o AS (SELECT *, sha256('pool:' || o_custkey || ':' || o_orderkey) AS h FROM orders),
    one AS (SELECT o_custkey, arg_min(o_orderkey, h) AS o_orderkey, arg_min(o_orderstatus, h) AS status FROM o GROUP BY o_custkey),
    m AS (SELECT o_orderkey, status, sha256('pool:' || o_orderkey) AS h FROM one), c AS (SELECT status, row_number() OVER (ORDER BY count(*), status) AS r FROM m GROUP BY status),
    s AS (SELECT o_orderkey, h, row_number() OVER (PARTITION BY status ORDER BY h, o_orderkey) AS k FROM m), t AS (SELECT o_orderkey FROM s WHERE k <= 4),
    f AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS n FROM m WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)) WHERE n <= 20 - (SELECT count(*) FROM t))
    SELECT o_custkey, o_orderkey, status FROM one WHERE o_orderkey IN (SELECT o_orderkey FROM t UNION ALL SELECT o_orderkey FROM f)""")
def q122_enriched_pool(orders):
    """One order a customer, each status carried four times, then filled to 20."""
    rows = orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return sampling.enriched_pool(rows, "o_custkey", "o_orderkey", ["status"], 4, 20, "pool").select("o_custkey", "o_orderkey", "status")
