"""Aggregation and window summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.operators import filters, metrics, timeline
from ledgerline.plans.register import query

big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


@query("events", sql="""
    WITH d AS (SELECT user_id, event_type, count(*) AS lines, count(DISTINCT ts::DATE) AS days FROM events GROUP BY ALL)
    SELECT user_id, max(days) AS most_days, max(lines) AS most_lines FROM d GROUP BY user_id""")
def q13_max_unique_days(events):
    """Rendered lines per user and type; the most distinct dates and lines of a user."""
    e = timeline.ordered_text(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], text.event_line(F.col("ts"), F.col("event_type")), "timeline")
    return e.groupBy("user_id").agg(F.max(text.event_dates(F.col("timeline"))).alias("most_days"), F.max(text.count_events(F.col("timeline"))).alias("most_lines"))


@query("lineitem", sql="""
    SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(100.0 * count(*) FILTER (WHERE l_discount > 0.05) / count(*), 6) AS used
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def q14_grouping_sets(lineitem):
    """Share of use at three grains and distinct entities, in one pass."""
    sets = lineitem.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.lit(100.0) * F.count_if(F.col("l_discount") > 0.05) / F.count(F.lit(1)), 6).alias("used"))


@query("events", sql="""
    SELECT user_id, arg_min(CASE WHEN event_type <> 'view' THEN event_type END, (ts, event_id)) AS first_type, arg_min(round(value, 4), (ts, event_id)) FILTER (WHERE value > 20) AS first_value FROM events GROUP BY user_id""")
def q15_first_nonnull(events):
    """The first non-null value of each column per user, each in order of time."""
    first = lambda c, keep: F.min_by(c, F.when(keep, F.struct("ts", "event_id")))
    t = F.when(F.col("event_type") != "view", F.col("event_type"))
    return events.groupBy("user_id").agg(first(t, t.isNotNull()).alias("first_type"), first(F.round("value", 4), F.col("value") > 20).alias("first_value"))


@query("lineitem", sql="""
    WITH q AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'),
    b AS (SELECT len(list_filter(e, lambda x: x <= l_extendedprice)) AS band, l_returnflag FROM lineitem, q)
    SELECT band, count(*) AS n, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS share FROM b GROUP BY band""")
def q16_quantile_bands(lineitem):
    """Bands from one split's exact quantiles, applied to all rows."""
    b = metrics.quantile_bands(lineitem, "l_extendedprice", F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return b.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.lit(100.0) * F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1)), 6).alias("share"))


@query("lineitem", sql="""
    WITH t AS (SELECT count(DISTINCT l_discount) AS n_values, max(c) AS top FROM (SELECT l_discount, count(*) AS c FROM lineitem GROUP BY l_discount))
    SELECT least(floor(round(l_discount * 10, 6)), 9)::BIGINT AS bin, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS positives, any_value(n_values) AS n_values, any_value(top) AS most_common FROM lineitem, t GROUP BY bin""")
def q17_hist10(lineitem):
    """Ten fixed bins, with the number of distinct values and the count of the most common one."""
    bins = lineitem.groupBy(metrics.ten_bins(F.round(F.col("l_discount") * 10, 6) / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("positives"))
    ties = metrics.majority(lineitem, "l_discount").select("n_values", F.col("n_majority").alias("most_common"))
    return bins.crossJoin(F.broadcast(ties))  # one row


@query("orders", sql="""
    WITH c AS (SELECT o_orderpriority, o_orderstatus, (floor(o_totalprice) + 0) AS p FROM orders),
    k AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN p > 250000 THEN ((p - 100) + 100 / 3.0) * 2.5 + 40 * 15 ELSE ((p - 100) + 100 / 3.0) * 1.25 + 40 * 10 END / 1e6 AS cost FROM c),
    r AS (SELECT o_orderpriority, o_orderstatus, avg(cost) AS rate FROM k WHERE o_orderstatus <> 'P' GROUP BY ALL), a AS (SELECT o_orderstatus, avg(cost) AS rate FROM k GROUP BY ALL),
    n AS (SELECT o_orderpriority, o_orderstatus, count(*) AS eligible FROM orders GROUP BY ALL)
    SELECT n.o_orderpriority, n.o_orderstatus, eligible, round(coalesce(r.rate, a.rate) * eligible, 6) AS projected FROM n LEFT JOIN r USING (o_orderpriority, o_orderstatus) JOIN a ON a.o_orderstatus = n.o_orderstatus""")
def q18_cost_tiers(orders):
    """Tiered cost of each request, and its extrapolation with a fallback rate."""
    cost = metrics.tiered_cost(F.floor("o_totalprice"), F.lit(30), F.lit(10), F.lit(100), 250_000, (1.25, 10.0), (2.5, 15.0))
    k = orders.select("o_orderpriority", "o_orderstatus", cost.alias("cost"))
    both = k.groupBy("o_orderpriority", "o_orderstatus").agg(F.avg(F.when(F.col("o_orderstatus") != "P", F.col("cost"))).alias("rate"), F.count(F.lit(1)).alias("eligible"))
    arm = k.groupBy("o_orderstatus").agg(F.avg("cost").alias("arm_rate"))
    return both.join(arm, "o_orderstatus").select("o_orderpriority", "o_orderstatus", "eligible", F.round(F.coalesce("rate", "arm_rate") * F.col("eligible"), 6).alias("projected"))


@query("conversations", sql="""
    SELECT conv_id, CASE WHEN bool_or(contains(lower(text), 'the of')) THEN NULL ELSE sha256(string_agg('NOTE: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY turn, role, text)) END AS report,
           CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS only_role FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def q19_report_agg(conversations):
    """A report per conversation in order of turn; null where any note carries the marker."""
    c = conversations.where("text IS NOT NULL")
    reports = timeline.ordered_text(c, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], text.note_line(F.col("text")), "report")
    hidden = filters.hidden_group(c, ["conv_id"], "text", "the of")
    roles = c.groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    joined = reports.join(hidden, "conv_id").join(roles, "conv_id")
    return joined.select("conv_id", F.when(~F.col("hidden"), F.sha2(F.col("report").cast("binary"), 256)).alias("report"), F.when(F.size("roles") == 1, F.get("roles", F.lit(0))).alias("only_role"))


@query("orders", sql="""
    WITH d AS (SELECT o_orderpriority, abs(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS d FROM orders)
    SELECT o_orderpriority, count(d) AS n, round(median(d), 4) AS median_change FROM d GROUP BY o_orderpriority""")
def q23_lag_median_change(orders):
    """Median absolute change from the same customer's previous order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = orders.select("o_orderpriority", F.abs(F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("d"))
    return d.groupBy("o_orderpriority").agg(F.count("d").alias("n"), F.round(F.percentile("d", 0.5), 4).alias("median_change"))


@query("events", sql="""
    WITH b AS (SELECT user_id, value, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block, event_type FROM events)
    SELECT user_id, block, count(*) AS n, round(avg(value), 6) AS mean FROM b WHERE block IS NOT NULL AND event_type <> 'signup' GROUP BY ALL""")
def q24_ffill_blocks(events):
    """A sign-up opens a block; the events after it belong to it."""
    b = timeline.forward_fill(events, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "signup", F.col("event_id")), "block")
    return b.where("block IS NOT NULL AND event_type <> 'signup'").groupBy("user_id", "block").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


LINE_SQL = "'[' || strftime(ts, '%Y-%m-%d %H:%M') || '] | ' || event_type || ' (' || event_id || ') | NOTE: ' || repeat('x', 1 + 40 * (event_id % 7)::INT)"


def _lines(events):
    note = F.repeat(F.lit("x"), (1 + 40 * (F.col("event_id") % 7)).cast("int"))
    return events.withColumn("line", text.event_line(F.col("ts"), F.col("event_type"), F.col("event_id").cast("string"), note=note))


@query("events", sql=f"""
    WITH l AS (SELECT user_id, event_id, ts, {LINE_SQL} AS line FROM events),
    u AS (SELECT *, sum(len(line) + 1) OVER w AS used, row_number() OVER w AS rn FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
    SELECT user_id, event_id, used::BIGINT AS used, CASE WHEN used > 200 THEN substr(line, 1, 200) ELSE line END AS line FROM u WHERE used <= 200 OR rn = 1""")
def q25_keep_latest(events):
    """The newest lines within 200 characters a user; a newest line that is too long alone is cut."""
    kept = timeline.newest_within(_lines(events), ["user_id"], [F.desc("ts"), F.desc("event_id")], "line", 200)
    return kept.select("user_id", "event_id", "used", "line")


@query("events", sql="""
    WITH r AS (SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC) AS date_rank FROM events)
    SELECT user_id, event_id, date_rank FROM r WHERE date_rank <= 3""")
def q26_last_k_dates(events):
    """Events of each user's three newest dates."""
    return timeline.last_dates(events, ["user_id"], F.to_date("ts"), 3).select("user_id", "event_id", "date_rank")
