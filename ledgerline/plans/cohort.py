"""Cohort queries: scans, filters, joins, as-of picks, samples, sets."""

from __future__ import annotations


from pyspark.sql import functions as F

from ledgerline.functions.dates import shifted
from ledgerline.functions.hashing import fingerprint, keyed_sha, opaque_id
from ledgerline.functions.text import populated
from ledgerline.operators import contracts, filters, joins, sampling, timeline
from ledgerline.plans.register import query

big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


@query("orders", sql="""
    SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS persons FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND trim(o_orderpriority) <> '' GROUP BY o_orderstatus""")
def q01_task_scan(orders):
    """Scored labels and populated text, counted per label."""
    kept = orders.where(filters.scored(F.col("o_orderstatus"), {"F": "done", "O": "open", "P": "part"}, ["P"]) & populated(F.col("o_orderpriority")))
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("persons"))


@query("events", "customer", sql="""
    WITH a AS (SELECT user_id, date_trunc('day', max(ts)) AS anchor FROM events GROUP BY user_id)
    SELECT e.user_id, c.c_mktsegment, count(*) AS n, sum(event_id)::BIGINT AS ids, max(date_diff('day', e.ts::DATE, a.anchor::DATE))::BIGINT AS oldest_days
    FROM events e JOIN a USING (user_id) LEFT JOIN customer c ON c.c_custkey = e.user_id
    WHERE e.ts BETWEEN a.anchor - INTERVAL 7 DAY AND a.anchor GROUP BY ALL""")
def q02_window_events(events, customer):
    """Events within seven days before each user's last day, both ends in."""
    anchors = events.groupBy("user_id").agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("anchor"))
    kept = joins.in_intervals(anchors, events, ["user_id"], shifted(F.col("anchor"), "7d", -1), F.col("anchor"), F.col("ts"))
    kept = kept.join(customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id", "left")
    return kept.groupBy("user_id", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), big(F.max(F.datediff("anchor", "ts"))).alias("oldest_days"))


@query("events", "orders", sql="""
    SELECT o.o_orderkey % 50 AS part, count(*) AS n, count(DISTINCT o.o_orderkey) AS anchors, sum(e.event_id)::BIGINT AS ids
    FROM (SELECT o_orderkey, o_orderkey % 150 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 744) HOUR AS anchor, o_orderkey % 5 AS days FROM orders) o
    JOIN events e ON e.user_id = o.user_id AND e.ts BETWEEN o.anchor - INTERVAL (days * 12) HOUR AND o.anchor + INTERVAL 1 HOUR GROUP BY 1""")
def q125_many_anchors(events, orders):
    """Events around very many anchors a person, in windows of different lengths: in bins of time, not person by person."""
    hours = lambda n: F.make_interval(hours=n)
    first = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    anchors = orders.select("o_orderkey", (F.col("o_orderkey") % 150).alias("user_id"), (first + hours((F.col("o_orderkey") % 744).cast("int"))).alias("anchor"), (F.col("o_orderkey") % 5 * 12).cast("int").alias("before"))
    met = joins.in_intervals(anchors, events, ["user_id"], F.col("anchor") - hours(F.col("before")), F.col("anchor") + hours(F.lit(1)), F.col("ts"))
    return met.groupBy((F.col("o_orderkey") % 50).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("anchors"), big(F.sum("event_id")).alias("ids"))


@query("lineitem", "orders", sql="""
    SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE CASE WHEN o_orderkey % 10 = 0 THEN l_shipdate IS NOT NULL ELSE l_shipdate BETWEEN o_orderdate - INTERVAL 2 YEAR AND o_orderdate + INTERVAL 6 MONTH END GROUP BY l_returnflag""")
def q128_relative_window(lineitem, orders):
    """Rows within a window around their own anchor; rows without an anchor are all kept."""
    anchors = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate")).alias("anchor"))
    kept = lineitem.join(anchors, "l_orderkey").where(filters.in_window(F.col("l_shipdate"), F.col("anchor"), "2y", "6mo"))
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query("events", sql="""
    SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events
    WHERE (contains(lower(event_type || ' ' || props), 'err') OR contains(lower(event_type || ' ' || props), 'pur') OR contains(lower(event_type || ' ' || props), '7'))
      AND NOT contains(event_type, 'sign') AND NOT (event_id IN (3, 5, 8) AND starts_with(event_type, 'pu')) GROUP BY event_type""")
def q03_code_filter(events):
    """A configured chain of category, code and note filters."""
    steps = [
        {"fn": "category", "terms": ["ERR", "pur", "7"], "columns": ["event_type", "props"]},
        {"fn": "code", "column": "event_type", "exclude": ["sign"]},
        {"fn": "notes", "ids": ["3", "5", "8"], "note_id": "note", "code": "event_type", "prefix": "pu"},
    ]
    kept = filters.chain(events.withColumn("note", F.col("event_id").cast("string")), steps)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("events", "lineitem", "orders", sql="""
    SELECT 'events' AS source, 'ts' AS "column", count(*) FILTER (WHERE ts::DATE > DATE '2024-01-20') AS later FROM events
    UNION ALL SELECT 'lineitem', 'l_shipdate', count(*) FILTER (WHERE l_shipdate::DATE > DATE '1998-06-30') FROM lineitem
    UNION ALL SELECT 'orders', 'o_orderdate', count(*) FILTER (WHERE o_orderdate::DATE > DATE '1998-06-30') FROM orders""")
def q04_leak_count(events, lineitem, orders):
    """Dates after a cut, for every date column of each table."""
    parts = [filters.leak_counts(df, F.lit(cut).cast("date")).select(F.lit(n).alias("source"), "column", "later") for n, df, cut in (("events", events, "2024-01-20"), ("lineitem", lineitem, "1998-06-30"), ("orders", orders, "1998-06-30"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("documents", sql="""
    WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) + 258 * (doc_id % 4) AS need FROM documents)
    SELECT CASE WHEN need > 600 THEN 'overflow' ELSE 'ok' END AS outcome, count(*) AS n, sum(need)::BIGINT AS tokens FROM d GROUP BY ALL""")
def q05_overflow_split(documents):
    """Words plus a constant per image against a budget; the outcome splits the input."""
    tokens = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    out = filters.with_outcome(documents, tokens, F.col("doc_id") % 4, 258, 600)
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("need").alias("tokens"))


@query("orders", sql="""
    WITH done AS (SELECT o_orderkey FROM orders WHERE substr(sha256('done:' || o_orderkey), 1, 1) IN ('0', '1', '2', '3'))
    SELECT o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders ANTI JOIN done USING (o_orderkey) GROUP BY o_orderpriority""")
def q06_resume_anti(orders):
    """What is left to do: keys, compared as text, that no earlier run has answered."""
    done = orders.where(F.substring(keyed_sha("done", "o_orderkey"), 1, 1).isin("0", "1", "2", "3"))
    return joins.without_done(orders, done, ["o_orderkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("orders", "customer", sql="""
    SELECT c_mktsegment AS o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY ALL""")
def q07_merge_timeline(orders, customer):
    """Inner join where the right side's columns win, restricted to known persons."""
    right = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("o_orderpriority"))
    known = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    merged = joins.right_wins(joins.restrict(orders, known, ["o_custkey"]), right, ["o_custkey"])
    return merged.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("orders", sql="""
    WITH p AS (SELECT *, lag(o_orderkey) OVER w AS prior, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS gap
               FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT o_orderstatus, count(prior) AS with_prior, count(*) - count(prior) AS without_prior, sum(gap)::BIGINT AS gap_days, sum(prior)::BIGINT AS priors FROM p GROUP BY o_orderstatus""")
def q08_prior_link(orders):
    """Each order's previous order through a link table with one row a key."""
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    link = joins.previous(joins.previous(orders, "o_custkey", order, "o_orderkey", "prior"), "o_custkey", order, "o_orderdate", "prior_date")
    link = link.select("o_orderkey", "prior", F.datediff("o_orderdate", "prior_date").alias("gap"))
    linked = joins.attach_link(orders, link, {"o_orderkey": "o_orderkey"})
    return linked.groupBy("o_orderstatus").agg(F.count("prior").alias("with_prior"), F.count_if(F.col("prior").isNull()).alias("without_prior"), big(F.sum("gap")).alias("gap_days"), F.sum("prior").alias("priors"))


@query("events", sql="""
    WITH m AS (SELECT user_id, event_type AS task, max(value) AS best FROM events GROUP BY ALL),
    g AS (SELECT u.user_id, t.task FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(task))
    SELECT g.user_id, g.task, round(m.best, 6) AS best FROM g LEFT JOIN m USING (user_id, task)""")
def q09_panel_join(events):
    """Pivot to a column a task, beside each user, and back to rows."""
    tasks = ["click", "error", "purchase", "signup", "view"]
    wide = joins.star(events.select("user_id").distinct(), events, "user_id", "event_type", "value", tasks)
    long = wide.unpivot(["user_id"], [F.col(f"label__{t}").alias(t) for t in tasks], "task", "best")
    return long.select("user_id", "task", F.round("best", 6).alias("best"))


@query("events", sql="""
    SELECT e.event_id, e.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'error') e
    LEFT JOIN LATERAL (SELECT event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts <= e.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON true""")
def q10_latest_before_mark(events):
    """The last view at or before each error."""
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("vid"))
    return joins.latest_at_or_before(errors, views, "user_id", "ts", "ts", "vid", "vid", "view_id").select("event_id", "user_id", "view_id")


@query("orders", sql="""
    WITH f AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k0, min(o_orderdate) AS d0 FROM orders GROUP BY o_custkey),
    d AS (SELECT o.o_custkey, o.o_orderkey, date_diff('day', f.d0, o.o_orderdate) AS day FROM orders o JOIN f USING (o_custkey) WHERE o.o_orderkey <> f.k0)
    SELECT f.o_custkey, arg_min(o_orderkey, (abs(day), day, o_orderkey)) FILTER (WHERE day BETWEEN -60 AND 30) AS start,
           arg_min(o_orderkey, (day, o_orderkey)) FILTER (WHERE day BETWEEN 28 AND 120) AS follow,
           arg_max(o_orderkey, (day, o_orderkey)) FILTER (WHERE day BETWEEN 274 AND 365) AS year
    FROM f LEFT JOIN d USING (o_custkey) GROUP BY f.o_custkey""")
def q11_decision_points(orders):
    """Nearest to day 0, first after four weeks, last before one year: three picks in one pass."""
    first = orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("k0"), F.min("o_orderdate").alias("d0"))
    d = orders.join(first, "o_custkey").withColumn("day", F.datediff("o_orderdate", "d0"))
    d = d.withColumn("day", F.when(F.col("o_orderkey") != F.col("k0"), F.col("day")))
    within = lambda a, b: F.when(F.col("day").between(a, b), F.col("o_orderkey"))
    key = lambda a, b, *o: F.when(F.col("day").between(a, b), F.struct(*o))
    return d.groupBy("o_custkey").agg(
        F.min_by(within(-60, 30), key(-60, 30, F.abs("day").alias("a"), F.col("day"), F.col("o_orderkey"))).alias("start"),
        F.min_by(within(28, 120), key(28, 120, F.col("day"), F.col("o_orderkey"))).alias("follow"),
        F.max_by(within(274, 365), key(274, 365, F.col("day"), F.col("o_orderkey"))).alias("year"),
    )


@query("lineitem", "part", "supplier", sql="""
    WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'O' THEN 1 ELSE 2 END, l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linenumber, l_discount, l_tax) AS rn
               FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25))
    SELECT s_nationkey, count(*) AS n, sum(l_partkey)::BIGINT AS parts, count(*) FILTER (WHERE year(l_shipdate) = 1997) AS n97 FROM r LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE rn = 1 GROUP BY s_nationkey""")
def q12_index_row(lineitem, part, supplier):
    """One row a group by predicate flags, then date, then keys; the pick is an aggregate, not a window."""
    small = lineitem.join(part.where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    flag = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_linestatus") == "O", 1).otherwise(2)
    order = [flag.alias("f"), (-F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("d"), *[F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linenumber", "l_discount", "l_tax")]]
    one = small.groupBy("l_orderkey").agg(F.min_by(F.struct("l_partkey", "l_suppkey", "l_shipdate"), F.struct(*order)).alias("r")).select("l_orderkey", "r.*")
    joined = one.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "left")
    return joined.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"), F.count_if(F.year("l_shipdate") == 1997).alias("n97"))


@query("events", sql="""
    SELECT user_id, ts::DATE AS day, min(event_id) AS first_id, max(event_id) AS last_id FROM (
      SELECT user_id, ts, arg_min(event_id, (ts, event_id)) OVER (PARTITION BY user_id, ts::DATE) AS event_id FROM events
      UNION ALL SELECT user_id, ts, arg_max(event_id, (ts, event_id)) OVER (PARTITION BY user_id, ts::DATE) FROM events) GROUP BY ALL""")
def q20_keep_first_last(events):
    """First and last event of a user's day, in order of time and id."""
    e = events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id")
    order = [F.col("ts"), F.col("event_id")]
    first = timeline.keep_one(e, ["user_id", "day"], order).select("user_id", "day", F.col("event_id").alias("a"))
    last = timeline.keep_one(e, ["user_id", "day"], order, last=True).select("user_id", "day", F.col("event_id").alias("b"))
    return first.join(last, ["user_id", "day"]).select("user_id", "day", F.least("a", "b").alias("first_id"), F.greatest("a", "b").alias("last_id"))


@query("documents", sql="SELECT doc_id, sha256('check:1:' || doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 50")
def q27_hash_subset(documents):
    """The first 50 documents by keyed hash (the subset is the feature)."""
    return sampling.first_by_hash(documents, "check:1", "doc_id", 50).select("doc_id", keyed_sha("check:1", "doc_id").alias("h"))


@query("labels", "documents", sql="""
    WITH r AS (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY sha256('nested:' || doc_id), doc_id) AS rank FROM labels SEMI JOIN documents USING (doc_id))
    SELECT quality, doc_id, rank::BIGINT AS rank, rank <= 10 AS in_small FROM r WHERE rank <= 100""")
def q28_per_class_nested(labels, documents):
    """100 of each class; the sample of 10 is inside it."""
    rows = sampling.shared_across(labels, documents, "doc_id")
    return sampling.per_class(rows, "quality", "doc_id", 100, "nested").select("quality", "doc_id", big("rank").alias("rank"), (F.col("rank") <= 10).alias("in_small"))


@query("labels", sql="""
    WITH h AS (SELECT *, sha256('minpos:' || doc_id) AS h FROM (SELECT DISTINCT * FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)),
    must AS (SELECT doc_id FROM (SELECT doc_id FROM h WHERE quality = 1 ORDER BY h, doc_id LIMIT 5) UNION SELECT doc_id FROM (SELECT doc_id FROM h WHERE toxic = 1 ORDER BY h, doc_id LIMIT 5))
    SELECT doc_id, quality, toxic FROM h ORDER BY (doc_id IN (SELECT doc_id FROM must)) DESC, h, doc_id LIMIT 40""")
def q29_min_positive_sample(labels):
    """Rows with both tasks, at least five positives of each, filled to 40."""
    both = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").distinct()
    return sampling.minimum_positives(both, "doc_id", ["quality", "toxic"], 5, 40, "minpos").select("doc_id", "quality", "toxic")


def _cover_sql(table: str, key: str, columns: tuple[str, ...], cells: int, each: int, k: int, prefix: str) -> str:
    """DuckDB SQL of the greedy cover of at most `cells` (column, value) cells, a step a cell."""
    long = " UNION ALL ".join(f"SELECT {key}, h, '{c}' AS col, {c}::VARCHAR AS val FROM h WHERE {c} IS NOT NULL" for c in columns)
    steps = [f"""h AS (SELECT DISTINCT {key}, sha256('{prefix}:' || {key}) AS h, {", ".join(columns)} FROM {table}), l AS ({long}),
        c AS (SELECT col, val, row_number() OVER (ORDER BY count(*), col, val) AS r FROM l GROUP BY col, val), m AS (SELECT {key}, h, r FROM l JOIN c USING (col, val)), s0 AS (SELECT {key} FROM m WHERE false)"""]
    for i in range(1, cells + 1):
        need = f"greatest(0, least({each} - (SELECT count(*) FROM m WHERE r = {i} AND {key} IN (SELECT {key} FROM s{i - 1})), {k} - (SELECT count(*) FROM s{i - 1})))"
        steps.append(f"s{i} AS (SELECT {key} FROM s{i - 1} UNION ALL SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY h, {key}) AS n FROM m WHERE r = {i} AND {key} NOT IN (SELECT {key} FROM s{i - 1})) WHERE n <= {need})")
    fill = f"SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY h, {key}) AS n FROM (SELECT DISTINCT {key}, h FROM m) WHERE {key} NOT IN (SELECT {key} FROM s{cells})) WHERE n <= {k} - (SELECT count(*) FROM s{cells})"
    return f"WITH {', '.join(steps)} SELECT DISTINCT {key}, {', '.join(columns)} FROM {table} WHERE {key} IN (SELECT {key} FROM s{cells} UNION ALL {fill})"


@query("labels", sql=_cover_sql("labels", "doc_id", ("quality", "toxic"), 4, 5, 30, "cover"))
def q30_greedy_cover(labels):
    """Every answer of both tasks carried five times, rarest first, then filled to 30."""
    chosen = sampling.greedy_cover(labels.distinct(), "doc_id", ["quality", "toxic"], 5, 30, "cover")
    return labels.join(chosen, "doc_id", "left_semi").distinct()


@query("orders", sql="""
    WITH a AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice, 0) AS p FROM orders WHERE o_orderkey % 10 <> 1),
    b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 0) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 10 <> 2)
    SELECT CASE WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.o_orderkey IS NULL THEN 'only_b' ELSE 'both' END AS side, count(*) AS n,
           count(*) FILTER (WHERE a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus) AS status_differs,
           count(*) FILTER (WHERE a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.p IS DISTINCT FROM b.p) AS price_differs
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey GROUP BY ALL""")
def q32_set_diff(orders):
    """Two runs side by side: rows on one side only, and fields that differ."""
    base = orders.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 0).alias("p"))
    a = base.where("o_orderkey % 10 <> 1")
    b = base.where("o_orderkey % 10 <> 2").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("p") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("p"))
    d = contracts.run_diff(a, b, ["o_orderkey"], ["o_orderstatus", "p"])
    return d.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_if("diff_o_orderstatus").alias("status_differs"), F.count_if("diff_p").alias("price_differs"))


@query("supplier", "customer", sql="""
    WITH u AS (SELECT s_nationkey AS nation, 'supplier' AS kind, s_acctbal AS bal, NULL AS segment FROM supplier UNION ALL SELECT c_nationkey, 'customer', c_acctbal, c_mktsegment FROM customer)
    SELECT nation, count(*) AS n, count(DISTINCT kind) AS kinds, count(DISTINCT (kind, segment)) AS kind_segments, round(sum(bal), 2) AS bal FROM u GROUP BY nation""")
def q33_union_dedupe(supplier, customer):
    """Union by name with missing columns, then distinct pairs."""
    u = supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("bal")).unionByName(customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)
    return u.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds"), F.count_distinct(F.struct("kind", "segment")).alias("kind_segments"), F.round(F.sum("bal"), 2).alias("bal"))


@query("customer", sql="""
    SELECT c_custkey, substr(sha1('salt:' || c_custkey || ':' || c_name), 1, 16) AS opaque, substr(sha256('x:' || c_name), 1, 20) AS token,
           sha256(len(c_custkey::VARCHAR) || ':' || c_custkey || '|' || len(c_name) || ':' || c_name) AS request FROM customer""")
def q42_hash_ids(customer):
    """Opaque ids and a request fingerprint."""
    return customer.select("c_custkey", opaque_id("salt", "c_custkey", "c_name").alias("opaque"), opaque_id("x", "c_name", length=20, bits=256).alias("token"), fingerprint(F.col("c_custkey"), F.col("c_name")).alias("request"))


@query("lineitem", "orders", sql="""
    SELECT 'key_repeats' AS rule, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n
    UNION ALL SELECT 'discount_range', count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.08) FROM lineitem
    UNION ALL SELECT 'ship_missing', count(*) FILTER (WHERE l_shipdate IS NULL) FROM lineitem
    UNION ALL SELECT 'two_flags', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1))
    UNION ALL SELECT 'shared_orders', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) SEMI JOIN orders ON l_orderkey = o_orderkey)""")
def q61_contract(lineitem, orders):
    """Violations of key, range, presence, consistency and disjointness rules."""
    one_pass = contracts.violations(lineitem, {"discount_range": ~F.col("l_discount").between(0, 0.08), "ship_missing": F.col("l_shipdate").isNull()})
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    rest = [count("key_repeats", contracts.duplicate_keys(lineitem, ["l_orderkey", "l_linenumber"])), count("two_flags", contracts.inconsistent(lineitem, ["l_orderkey"], ["l_returnflag"])), count("shared_orders", contracts.overlap(lineitem, orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"))]
    return one_pass.union(rest[0]).union(rest[1]).union(rest[2])


@query("nation", "region", "customer", sql="""
    WITH g AS (SELECT r_regionkey, r_name, s.segment FROM region CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('NOWHERE')) s(segment)),
    c AS (SELECT n_regionkey, c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT r_name, segment, coalesce(n, 0) AS n, coalesce(nations, 0) AS nations FROM g LEFT JOIN c ON n_regionkey = r_regionkey AND c_mktsegment = segment""")
def q62_cross_cells(nation, region, customer):
    """A grid of conditions with its empty cells."""
    segments = region.sparkSession.createDataFrame([(s,) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "NOWHERE")], "segment string")
    grid = joins.cells(region.select("r_regionkey", "r_name"), segments)
    counts = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("nations"))
    return grid.join(counts, ["r_regionkey", "segment"], "left").select("r_name", "segment", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("nations", F.lit(0)).alias("nations"))


