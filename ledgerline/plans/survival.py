"""Survival queries: time from a customer's first to second order; no second order is a censoring at the end of data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import survival
from ledgerline.plans.register import query

r6 = lambda c: F.round(c, 6)
CUT = "2001-12-31"

PEOPLE = f"""p AS (SELECT o_custkey, min(o_orderdate) AS d0, min(o_orderdate) FILTER (WHERE rn = 2) AS d1, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS price
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) GROUP BY o_custkey),
    s AS (SELECT c_mktsegment AS segment, o_custkey, date_diff('day', d0, coalesce(d1, TIMESTAMP '{CUT}')) AS t, d1 IS NOT NULL AND o_custkey % 3 <> 0 AS e, price FROM p JOIN customer ON c_custkey = o_custkey)"""
PER_TIME = "per AS (SELECT segment, t, count(*) FILTER (WHERE e) AS d, count(*) FILTER (WHERE NOT e) AS c, sum(count(*)) OVER (PARTITION BY segment ORDER BY t DESC) AS at_risk FROM s GROUP BY segment, t)"
KM = "km AS (SELECT segment, t, d, at_risk, (SELECT CASE WHEN bool_or(q.d = q.at_risk) THEN 0 ELSE exp(sum(CASE WHEN q.d < q.at_risk THEN ln(1 - q.d / q.at_risk) END)) END FROM per q WHERE q.segment = per.segment AND q.t <= per.t) AS surv FROM per)"
CENS = "gg AS (SELECT segment, t, (SELECT CASE WHEN bool_or(q.c > 0 AND q.c = q.at_risk - q.d) THEN 0 ELSE exp(sum(CASE WHEN q.c > 0 AND q.c < q.at_risk - q.d THEN ln(1 - q.c / (q.at_risk - q.d)) ELSE 0 END)) END FROM per q WHERE q.segment = per.segment AND q.t <= per.t) AS g FROM per)"


def people(orders, customer):
    """(segment, o_custkey, t, e, price): days to the second order, whether it was seen."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = orders.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d0"), F.min(F.when(F.col("rn") == 2, F.col("o_orderdate"))).alias("d1"), F.max(F.when(F.col("rn") == 1, F.col("o_totalprice"))).alias("price"))
    t = F.datediff(F.coalesce("d1", F.lit(CUT).cast("timestamp_ntz")), "d0").cast("bigint")
    rows = first.join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    return rows.select("segment", "o_custkey", t.alias("t"), (F.col("d1").isNotNull() & (F.col("o_custkey") % 3 != 0)).alias("e"), "price")


@query("orders", "customer", sql=f"""
    WITH {PEOPLE}, {PER_TIME}, {KM} SELECT segment, t, d, at_risk::BIGINT AS at_risk, round(surv, 6) AS survival FROM km""")
def q21_km_curve(orders, customer):
    """Kaplan-Meier per segment."""
    km = survival.kaplan_meier(people(orders, customer), ["segment"], "t", "e")
    return km.select("segment", "t", "d", "at_risk", r6("survival").alias("survival"))


GRID = "grid AS (SELECT segment, m, m * 30 AS day FROM (SELECT DISTINCT segment FROM s), range(1, 25) t(m))"


@query("orders", "customer", sql=f"""
    WITH {PEOPLE}, {PER_TIME}, {KM}, {GRID},
    st AS (SELECT segment, day, coalesce((SELECT arg_max(surv, t) FROM km WHERE km.segment = grid.segment AND km.t <= grid.day), 1.0) AS y FROM grid),
    a AS (SELECT segment, (lead(day) OVER w - day) * (y + lead(y) OVER w) / 2 AS a, day FROM st WINDOW w AS (PARTITION BY segment ORDER BY day)),
    u AS (SELECT least(quantile_cont(t::DOUBLE, 0.9), max(t)) * 0.999 AS upper FROM s WHERE e)
    SELECT segment, round(sum(a), 5) AS area, (max(day) - min(day))::BIGINT AS span, round(any_value(upper), 6) AS upper FROM a, u GROUP BY segment""")
def q22_step_integral(orders, customer):
    """The curve read on a month grid, its trapezoid area, and the scoring window's upper end."""
    p = people(orders, customer)
    km = survival.kaplan_meier(p, ["segment"], "t", "e")
    grid = p.select("segment").distinct().select("segment", F.explode(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda m: (m * 30).cast("bigint"))).alias("day"))
    steps = survival.step_at(grid, km, ["segment"], "day", "t", "survival", "y")
    area = survival.trapezoid(steps, ["segment"], "day", "y")
    return area.crossJoin(F.broadcast(survival.window_upper(p, "t", "e"))).select("segment", F.round("area", 5).alias("area"), F.col("span").cast("bigint").alias("span"), r6("upper").alias("upper"))


@query("orders", "customer", sql=f"""
    WITH {PEOPLE}, r AS (SELECT *, round(price / 1000, 0) AS risk FROM s),
    k AS (SELECT a.segment, a.risk AS ra, b.risk AS rb FROM r a JOIN r b ON a.segment = b.segment AND a.e AND (b.t > a.t OR (b.t = a.t AND NOT b.e)))
    SELECT segment, round(sum(CASE WHEN rb = ra THEN 0.5 WHEN rb < ra THEN 1.0 ELSE 0.0 END) / count(*), 9) AS c_index, count(*)::DOUBLE AS pairs FROM k GROUP BY segment""")
def q52_c_index(orders, customer):
    """Harrell's C per segment, without pairing rows."""
    rows = people(orders, customer).withColumn("risk", F.round(F.col("price") / 1000, 0))
    return survival.c_index(rows, ["segment"], "t", "e", "risk").select("segment", F.round("c_index", 9).alias("c_index"), "pairs")


@query("orders", "customer", sql=f"""
    WITH {PEOPLE}, {PER_TIME}, {CENS}, grid AS (SELECT segment, m * 90 AS day FROM (SELECT DISTINCT segment FROM s), range(1, 9) t(m)),
    own AS (SELECT s.*, (SELECT arg_max(g, t) FROM gg WHERE gg.segment = s.segment AND gg.t <= s.t) AS g_own FROM s),
    at_day AS (SELECT segment, day, coalesce((SELECT arg_max(g, t) FROM gg WHERE gg.segment = grid.segment AND gg.t <= grid.day), 1.0) AS g_t FROM grid),
    x AS (SELECT o.segment, day, t, e, exp(-day / (200.0 + o.o_custkey % 300)) AS sv, g_own, g_t FROM own o JOIN at_day a ON o.segment = a.segment),
    b AS (SELECT segment, day, avg(coalesce(CASE WHEN t <= day AND e THEN sv * sv / nullif(g_own, 0) WHEN t > day THEN (1 - sv) * (1 - sv) / nullif(g_t, 0) ELSE 0 END, 0)) AS brier FROM x GROUP BY ALL),
    c AS (SELECT segment, day, 1 - sv AS risk, sum(CASE WHEN t <= day THEN coalesce(1 / nullif(g_own, 0), 0) ELSE 0 END) AS pos, sum(CASE WHEN t > day THEN 1 ELSE 0 END) AS neg FROM x WHERE t > day OR e GROUP BY ALL),
    w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY segment, day ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
    u AS (SELECT segment, day, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM w GROUP BY ALL)
    SELECT b.segment, b.day::BIGINT AS day, round(brier, 6) AS brier, round(auc, 6) AS auc FROM b JOIN u ON b.segment = u.segment AND b.day = u.day""")
def q53_ipcw_brier(orders, customer):
    """Censoring-weighted Brier score and time-dependent AUC of a stated curve, every 90 days."""
    p = people(orders, customer)
    g = survival.censoring(p, ["segment"], "t", "e")
    own = survival.step_at(p, g, ["segment"], "t", "t", "g", "g_own")
    grid = p.select("segment").distinct().select("segment", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda m: (m * 90).cast("bigint"))).alias("day"))
    at_day = survival.step_at(grid, g, ["segment"], "day", "t", "g", "g_t")
    x = own.join(at_day, "segment").withColumn("sv", F.exp(-F.col("day") / (200.0 + F.col("o_custkey") % 300)))  # eight grid days a row
    b = survival.weighted_brier(x, ["segment", "day"], "t", "e", "sv", "day", "g_own", "g_t")
    u = survival.dynamic_auc(x.withColumn("risk", 1 - F.col("sv")), ["segment", "day"], "t", "e", "risk", "day", "g_own")
    return b.join(u, ["segment", "day"]).select("segment", "day", r6("brier").alias("brier"), r6("auroc").alias("auc"))


@query("orders", "customer", sql=f"""
    WITH {PEOPLE}, {PER_TIME}, {CENS}, grid AS (SELECT segment, m * 90 AS day FROM (SELECT DISTINCT segment FROM s), range(1, 9) t(m)),
    own AS (SELECT s.*, (SELECT arg_max(g, t) FROM gg WHERE gg.segment = s.segment AND gg.t <= s.t) AS g_own FROM s),
    at_day AS (SELECT segment, day, coalesce((SELECT arg_max(g, t) FROM gg WHERE gg.segment = grid.segment AND gg.t <= grid.day), 1.0) AS g_t FROM grid),
    x AS (SELECT o.segment, day, t, e, exp(-day / (200.0 + o.o_custkey % 300)) AS sv, g_own, g_t FROM own o JOIN at_day a ON o.segment = a.segment),
    b AS (SELECT segment, day, avg(coalesce(CASE WHEN t <= day AND e THEN sv * sv / nullif(g_own, 0) WHEN t > day THEN (1 - sv) * (1 - sv) / nullif(g_t, 0) ELSE 0 END, 0)) AS brier FROM x GROUP BY ALL),
    a AS (SELECT segment, day, (lead(day) OVER w - day) * (brier + lead(brier) OVER w) / 2 AS part FROM b WINDOW w AS (PARTITION BY segment ORDER BY day))
    SELECT segment, round(sum(part) / (max(day) - min(day)), 6) AS integrated_brier FROM a GROUP BY segment""")
def q100_integrated_brier(orders, customer):
    """The censoring-weighted Brier score averaged over the scoring days."""
    p = people(orders, customer)
    g = survival.censoring(p, ["segment"], "t", "e")
    own = survival.step_at(p, g, ["segment"], "t", "t", "g", "g_own")
    grid = p.select("segment").distinct().select("segment", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda m: (m * 90).cast("bigint"))).alias("day"))
    at_day = survival.step_at(grid, g, ["segment"], "day", "t", "g", "g_t")
    x = own.join(at_day, "segment").withColumn("sv", F.exp(-F.col("day") / (200.0 + F.col("o_custkey") % 300)))  # eight grid days a row
    b = survival.weighted_brier(x, ["segment", "day"], "t", "e", "sv", "day", "g_own", "g_t")
    return survival.integrated_brier(b, ["segment"], "day", "brier").select("segment", r6("integrated_brier").alias("integrated_brier"))
