"""Metric queries: confusion, AUROC, bootstrap, thresholds, calibration, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import bootstrap, metrics
from ledgerline.plans.register import query

big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")
r6 = lambda c: F.round(c, 6)


def _y():
    return (F.col("l_returnflag") == "R").cast("int")


def _auroc_sql(source: str, keys: str, y: str, s: str) -> str:
    """DuckDB SQL of the tie-aware AUROC per keys."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""(WITH c AS (SELECT {k}{s} AS s, count(*) FILTER (WHERE {y} = 1) AS pos, count(*) FILTER (WHERE {y} = 0) AS neg FROM {source} GROUP BY ALL),
        b AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
        SELECT {k}sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0) AS auroc FROM b {group})"""


@query("embeddings", sql="""
    WITH e AS (SELECT vec_id, label % 5 AS code, list_transform(embedding[1:5], lambda x: abs(round(x::DOUBLE, 2))) AS p FROM embeddings),
    r AS (SELECT vec_id, code, i - 1 AS c, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS k FROM e, unnest(range(1, 6)) t(i))
    SELECT count(DISTINCT vec_id) AS n, count(*) FILTER (WHERE k = 1 AND c = code) AS top1, count(*) FILTER (WHERE k <= 2 AND c = code) AS top2, sum(CASE WHEN k = 1 THEN c END)::BIGINT AS sum_first, sum(CASE WHEN k = 2 THEN c END)::BIGINT AS sum_second FROM r""")
def q31_top2(embeddings):
    """Top-1 and top-2 options of five shares, equal shares in listed order."""
    p = F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(F.round(x.cast("double"), 2)))
    codes = F.array(*[F.lit(i).cast("bigint") for i in range(5)])
    e = embeddings.select((F.col("label") % 5).alias("code"), metrics.top_two(p, codes).alias("top"))
    at = lambda i: F.get("top", F.lit(i))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(at(0) == F.col("code")).alias("top1"), F.count_if(F.array_contains("top", F.col("code").cast("bigint"))).alias("top2"), F.sum(at(0)).alias("sum_first"), F.sum(at(1)).alias("sum_second"))


@query("lineitem", sql="""
    WITH c AS (SELECT l_linestatus, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE t AND NOT p) AS fn
               FROM (SELECT l_linestatus, l_returnflag = 'R' AS t, l_discount >= 0.05 AS p FROM lineitem) GROUP BY l_linestatus)
    SELECT *, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
           round((2.0 * tp / nullif(2 * tp + fp + fn, 0) * (tp + fn) + 2.0 * tn / nullif(2 * tn + fp + fn, 0) * (tn + fp)) / (tp + tn + fp + fn), 6) AS weighted_f1 FROM c""")
def q43_confusion(lineitem):
    """Binary confusion counts and rates per line status."""
    m = metrics.confusion(lineitem, _y(), (F.col("l_discount") >= 0.05).cast("int"), ["l_linestatus"])
    return m.select("l_linestatus", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("sensitivity", "specificity", "accuracy", "weighted_f1")])


@query("lineitem", sql="""
    WITH r AS (SELECT l_linestatus, l_returnflag AS t, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 30 THEN 'N' WHEN l_quantity < 45 THEN 'R' END AS p FROM lineitem WHERE l_returnflag <> '-1'),
    c AS (SELECT l_linestatus, k, count(*) FILTER (WHERE t = k) AS support, count(*) FILTER (WHERE t = k AND p = k) AS hit, count(*) FILTER (WHERE p = k) AS named FROM r, (VALUES ('A'), ('N'), ('R')) v(k) GROUP BY ALL)
    SELECT l_linestatus, sum(support)::BIGINT AS n, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(hit / support), 6) AS balanced_accuracy, round(avg(2.0 * hit / (support + named)), 6) AS macro_f1 FROM c WHERE support > 0 GROUP BY l_linestatus""")
def q44_forced_multi(lineitem):
    """Three classes with unreadable predictions, which are wrong."""
    q = F.col("l_quantity")
    rows = lineitem.select("l_linestatus", F.col("l_returnflag").alias("t"), F.when(q < 15, "A").when(q < 30, "N").when(q < 45, "R").alias("p"))
    m = metrics.forced_answer(rows, "t", "p", ["l_linestatus"])
    return m.select("l_linestatus", "n", *[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


_EVENT_Y = "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"


@query("events", sql=f"""
    SELECT 'all' AS week, n_pos, n_neg, round(auroc, 9) AS auroc FROM {_auroc_sql("events", "", _EVENT_Y, "value")}
    UNION ALL SELECT week::VARCHAR, n_pos, n_neg, round(auroc, 9) FROM {_auroc_sql("(SELECT *, weekofyear(ts) AS week FROM events)", "week", _EVENT_Y, "value")}""")
def q45_auroc(events):
    """AUROC of value for errors, by week and overall."""
    y = (F.col("event_type") == "error").cast("int")
    whole = metrics.auroc(events, y, F.col("value")).select(F.lit("all").alias("week"), "n_pos", "n_neg", F.round("auroc", 9).alias("auroc"))
    weeks = metrics.auroc(events.withColumn("week", F.weekofyear("ts").cast("string")), y, F.col("value"), ["week"])
    return whole.unionByName(weeks.select("week", "n_pos", "n_neg", F.round("auroc", 9).alias("auroc")))


@query("events", sql=f"""
    WITH o AS (SELECT event_type AS option_, value, user_id % 4 AS question, t.k AS k FROM events, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(k)),
    a AS {_auroc_sql("o", "question, k", "CASE WHEN option_ = k THEN 1 ELSE 0 END", "value")},
    q AS (SELECT question::VARCHAR AS question, avg(auroc) AS auroc FROM a GROUP BY question)
    SELECT question, round(auroc, 9) AS auroc FROM q UNION ALL SELECT 'MACRO', round(avg(auroc), 9) FROM q HAVING count(*) >= 2""")
def q46_auroc_macro(events):
    """One-versus-rest AUROC per option, averaged per question, and a macro row over questions."""
    options = F.explode(F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")]))
    rows = events.select((F.col("user_id") % 4).cast("string").alias("question"), options.alias("k"), "event_type", "value")
    per = metrics.auroc(rows, (F.col("event_type") == F.col("k")).cast("int"), F.col("value"), ["question", "k"])
    q = per.groupBy("question").agg(F.avg("auroc").alias("auroc")).withColumn("run", F.lit(1))
    return metrics.with_macro(q, "question", ["run"], ["auroc"]).select("question", F.round("auroc", 9).alias("auroc"))


REPS = bootstrap.REPLICATES


@query("events", sql=f"""
    WITH e AS (SELECT user_id, weekofyear(ts)::VARCHAR AS question, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, value AS s FROM events),
    wts AS {bootstrap.weights_sql("(SELECT DISTINCT user_id FROM events)", "user_id", REPS)},
    base AS (SELECT 0 AS rep, question, y, s, 1::BIGINT AS w, false AS boot FROM e),
    drawn AS (SELECT rep, question, y, s, w, true AS boot FROM e JOIN wts USING (user_id) WHERE w > 0),
    c AS (SELECT boot, rep, question, s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM (SELECT * FROM base UNION ALL SELECT * FROM drawn) GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY boot, rep, question ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
    a AS (SELECT boot, rep, question, sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0) AS auroc FROM b GROUP BY ALL),
    q AS (SELECT * FROM a UNION ALL SELECT boot, rep, 'MACRO', avg(auroc) FROM a GROUP BY boot, rep HAVING count(DISTINCT question) >= 2)
    SELECT p.question, round(p.auroc, 6) AS auroc, round(quantile_cont(x.auroc, 0.025), 6) AS low, round(quantile_cont(x.auroc, 0.975), 6) AS high, count(x.auroc) AS reps
    FROM q p JOIN q x ON p.question = x.question AND NOT p.boot AND x.boot GROUP BY p.question, p.auroc""")
def q47_cluster_bootstrap(events):
    """AUROC per question (week) with a macro row, and intervals from whole users drawn with replacement."""
    rows = events.select("user_id", F.weekofyear("ts").cast("string").alias("question"), (F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("s"))
    point = metrics.auroc(rows, F.col("y"), F.col("s"), ["question"]).withColumn("rep", F.lit(0).cast("bigint"))
    point = metrics.with_macro(point, "question", ["rep"], ["auroc"]).drop("rep")
    reps = bootstrap.cluster_auroc(rows, "user_id", "question", F.col("y"), F.col("s"), REPS)
    reps = metrics.with_macro(reps, "question", ["rep"], ["auroc"])
    both = point.join(bootstrap.interval(reps, "auroc", ["question"]), "question")
    return both.select("question", *[r6(c).alias(c) for c in ("auroc", "low", "high")], "reps")


@query("lineitem", sql=f"""
    WITH l AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS a, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS b FROM lineitem),
    per AS (SELECT l_orderkey, t, count(*) AS n, count(*) FILTER (WHERE a = t) AS ha, count(*) FILTER (WHERE b = t) AS hb FROM l GROUP BY ALL),
    wts AS {bootstrap.weights_sql("(SELECT DISTINCT l_orderkey FROM lineitem)", "l_orderkey", REPS)},
    c AS (SELECT rep, t, sum(w * n) AS n, sum(w * ha) AS ha, sum(w * hb) AS hb FROM per JOIN wts USING (l_orderkey) GROUP BY ALL),
    d AS (SELECT rep, avg(hb::DOUBLE / n) - avg(ha::DOUBLE / n) AS difference FROM c WHERE n > 0 GROUP BY rep)
    SELECT round(quantile_cont(difference, 0.025), 6) AS low, round(quantile_cont(difference, 0.975), 6) AS high, count(difference) AS reps FROM d""")
def q48_strat_bootstrap_diff(lineitem):
    """Paired difference of two arms' balanced accuracies on shared draws, classes weighted within themselves."""
    rows = lineitem.select("l_orderkey", _y().alias("t"), (F.col("l_discount") >= 0.05).cast("int").alias("a"), (F.col("l_quantity") >= 25).cast("int").alias("b"))
    i = bootstrap.interval(bootstrap.stratified_accuracy_difference(rows, "l_orderkey", "t", "a", "b", REPS), "difference")
    return i.select(r6("low").alias("low"), r6("high").alias("high"), "reps")


@query("lineitem", sql="""
    WITH v AS (SELECT round(l_quantity / 50, 4) AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'),
    c AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM v GROUP BY s),
    k AS (SELECT (s + lead(s) OVER w) / 2 AS t, sum(p) OVER w AS pb, sum(n) OVER w AS nb, sum(p) OVER () AS pt, sum(n) OVER () AS nt FROM c WINDOW w AS (ORDER BY s)),
    best AS (SELECT t, ba FROM (SELECT t, round(((pt - pb) / pt + nb / nt) / 2, 12) AS ba FROM k WHERE t IS NOT NULL) ORDER BY ba DESC, round(abs(t - 0.5), 12), t LIMIT 1)
    SELECT round(t, 6) AS threshold, round(ba, 6) AS valid_ba, round((avg(CASE WHEN y = 1 THEN (s >= t)::INT END) + avg(CASE WHEN y = 0 THEN (s < t)::INT END)) / 2, 6) AS test_ba
    FROM best, (SELECT round(l_quantity / 50, 4) AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01') GROUP BY t, ba""")
def q49_threshold(lineitem):
    """The best cut on one split, frozen and applied to the other."""
    rows = lineitem.select(F.round(F.col("l_quantity") / 50, 4).alias("s"), _y().alias("y"), (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).alias("valid"))
    best = metrics.best_threshold(rows.where("valid"), "y", "s")
    test = rows.where("NOT valid").crossJoin(F.broadcast(best))  # one row
    hit = lambda y, c: F.avg(F.when(F.col("y") == y, c.cast("int")))
    at = F.col("s") >= F.col("threshold")
    return test.groupBy("threshold", "balanced_accuracy").agg(r6((hit(1, at) + hit(0, ~at)) / 2).alias("test_ba")).select(r6("threshold").alias("threshold"), r6("balanced_accuracy").alias("valid_ba"), "test_ba")


@query("lineitem", sql="""
    WITH r AS (SELECT l_linestatus, l_discount * 5 AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), m AS (SELECT avg(y) AS rate FROM r)
    SELECT l_linestatus, round(avg((p - y) * (p - y)), 6) AS brier, round(sum(y) / sum(p), 6) AS observed_expected, count(*) FILTER (WHERE (p >= rate) = (y = 1)) AS right_side,
           round(avg(ln(least(greatest(p, 0.000001), 0.999999) / (1 - least(greatest(p, 0.000001), 0.999999)))), 6) AS mean_logit, count(*) FILTER (WHERE p > l_tax_free) AS over
    FROM (SELECT r.*, 0.25 AS l_tax_free FROM r), m GROUP BY l_linestatus""")
def q50_brier_oe(lineitem):
    """Brier score, observed over expected, right side of the base rate, mean clipped logit, consistency count."""
    rows = lineitem.select("l_linestatus", (F.col("l_discount") * 5).alias("p"), _y().alias("y"))
    rate = rows.agg(F.avg("y").alias("rate"))
    rows = rows.crossJoin(F.broadcast(rate))  # one row
    p, y = F.col("p"), F.col("y")
    return rows.groupBy("l_linestatus").agg(r6(metrics.brier(p, y)).alias("brier"), r6(metrics.observed_expected(p, y)).alias("observed_expected"), F.count_if(metrics.right_side_of_rate(p, F.col("rate"), y)).alias("right_side"), r6(F.avg(metrics.logit(p))).alias("mean_logit"), F.count_if(p > 0.25).alias("over"))


def _newton_sql(cells: str, keys: str, rounds: int = 12) -> str:
    """DuckDB SQL of the rounds of a one-variable logistic regression over cells (keys, x, y, n)."""
    steps = [f"b0 AS (SELECT {keys}, CASE WHEN min(x) < max(x) AND sum(y) > 0 AND sum(y) < sum(n) THEN 0.0::DOUBLE END AS a, CASE WHEN min(x) < max(x) AND sum(y) > 0 AND sum(y) < sum(n) THEN 0.0::DOUBLE END AS b, 1.0::DOUBLE AS moved FROM {cells} GROUP BY {keys})"]
    for i in range(rounds):
        steps.append(f"""s{i} AS (SELECT {keys}, a, b, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(g) AS g0, sum(g * x) AS g1
            FROM (SELECT *, n * m * (1 - m) AS w, y - n * m AS g FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS m FROM {cells} JOIN b{i} USING ({keys}))) GROUP BY {keys}, a, b),
            b{i + 1} AS (SELECT {keys}, CASE WHEN ok THEN a + da END AS a, CASE WHEN ok THEN b + db END AS b, CASE WHEN ok THEN greatest(abs(da), abs(db)) END AS moved
            FROM (SELECT *, s0 * s2 - s1 * s1 > 1e-12 AND abs(b) <= 1e6 AS ok, (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1) AS da, (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) AS db FROM s{i}))""")
    return ",\n".join(steps)


@query("events", sql=f"""
    WITH r AS (SELECT weekofyear(ts) AS week, (event_type = 'error')::INT AS y, ((props->>'$.k')::DOUBLE % 100) / 100 AS p FROM events),
    c AS (SELECT week, x, sum(y)::DOUBLE AS y, count(*)::DOUBLE AS n FROM (SELECT week, y, round(ln(least(greatest(p, 0.000001), 0.999999) / (1 - least(greatest(p, 0.000001), 0.999999))), 9) AS x FROM r) GROUP BY week, x),
    {_newton_sql("c", "week")}
    SELECT week, round(CASE WHEN moved < 1e-8 THEN b END, 6) AS slope, t.n::BIGINT AS n FROM b12 JOIN (SELECT week, sum(n) AS n FROM c GROUP BY week) t USING (week)""")
def q51_calibration(events):
    """Slope of a logistic regression on the logit of a stated probability, per event week."""
    rows = events.select(F.weekofyear("ts").cast("bigint").alias("week"), (F.col("event_type") == "error").cast("int").alias("y"), (F.pmod(F.get_json_object("props", "$.k").cast("double"), F.lit(100)) / 100).alias("p"))
    return metrics.calibration_slope(rows, "y", "p", ["week"]).select("week", r6("slope").alias("slope"), "n")


@query("lineitem", sql="""
    WITH q AS (SELECT l_returnflag, l_quantity, l_discount FROM lineitem),
    a AS (SELECT l_returnflag, l_quantity AS v, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS ra,
                 rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS rb FROM q)
    SELECT l_returnflag, round(corr(ra, rb), 6) AS spearman FROM a GROUP BY l_returnflag""")
def q54_rank_corr(lineitem):
    """Spearman correlation through average ranks of ties."""
    return metrics.spearman(lineitem, "l_quantity", "l_discount", ["l_returnflag"]).select("l_returnflag", r6("spearman").alias("spearman"))


@query("lineitem", sql="""
    WITH r AS (SELECT l_shipdate < TIMESTAMP '1997-01-01' AS valid, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t, v.name, CASE v.name WHEN 'discount' THEN (l_discount >= 0.05)::INT WHEN 'quantity' THEN (l_quantity >= 25)::INT ELSE 0 END AS p FROM lineitem, (VALUES ('discount'), ('quantity'), ('majority')) v(name)),
    m AS (SELECT valid, name, (avg(CASE WHEN t = 1 THEN (p = 1)::INT END) + avg(CASE WHEN t = 0 THEN (p = 0)::INT END)) / 2 AS ba FROM r GROUP BY ALL)
    SELECT name, round(ba, 6) AS ba, name = (SELECT name FROM m WHERE valid ORDER BY round(ba, 9) DESC, name LIMIT 1) AS chosen FROM m WHERE NOT valid""")
def q55_best_variant(lineitem):
    """The variant that is best on validation, with every variant's test score, and a majority baseline."""
    rows = lineitem.select((F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).alias("valid"), _y().alias("t"), (F.col("l_discount") >= 0.05).cast("int").alias("discount"), (F.col("l_quantity") >= 25).cast("int").alias("quantity"))
    base = metrics.majority(rows, "t").select(F.col("majority"))
    long = rows.crossJoin(F.broadcast(base)).unpivot(["valid", "t"], ["discount", "quantity", "majority"], "name", "p")
    m = metrics.forced_answer(long, "t", "p", ["valid", "name"]).select("valid", "name", F.round("balanced_accuracy", 9).alias("ba"))
    out = metrics.best_variant(m.where("valid"), m.where("NOT valid"), "name", "ba")
    return out.select("name", r6("ba").alias("ba"), "chosen")




@query("lineitem", sql=f"""
    WITH r AS (SELECT l_orderkey, l_returnflag AS q, (l_linestatus = 'F')::INT AS y, CASE WHEN l_discount > 0.02 THEN (l_quantity > 25)::INT END AS p FROM lineitem),
    per AS (SELECT l_orderkey, q, y, count(*) AS n, count(*) FILTER (WHERE p = y) AS hit FROM r GROUP BY ALL),
    wts AS {bootstrap.weights_sql("(SELECT DISTINCT l_orderkey FROM lineitem)", "l_orderkey", REPS)},
    c AS (SELECT rep, q, y, sum(w * n) AS n, sum(w * hit) AS hit FROM per JOIN wts USING (l_orderkey) GROUP BY ALL),
    b AS (SELECT rep, avg(ba) AS ba FROM (SELECT rep, q, avg(hit::DOUBLE / n) AS ba FROM c WHERE n > 0 GROUP BY rep, q) GROUP BY rep),
    k AS (SELECT q, y, sum(w)::DOUBLE AS n, sum(CASE WHEN p = y THEN w ELSE 0 END) AS hit FROM (SELECT *, 1 + l_orderkey % 3 AS w FROM r) GROUP BY q, y)
    SELECT (SELECT round(avg(ba), 6) FROM (SELECT q, avg(hit / n) AS ba FROM k GROUP BY q)) AS weighted, round(quantile_cont(ba, 0.025), 6) AS low, round(quantile_cont(ba, 0.975), 6) AS high, count(*) AS reps FROM b""")
def q95_macro_accuracy(lineitem):
    """Row-weighted balanced accuracy averaged over questions, and its interval from whole clusters."""
    rows = lineitem.select("l_orderkey", F.col("l_returnflag").alias("q"), (F.col("l_linestatus") == "F").cast("int").alias("y"), F.when(F.col("l_discount") > 0.02, (F.col("l_quantity") > 25).cast("int")).alias("p"), (1 + F.col("l_orderkey") % 3).alias("w"))
    point = metrics.forced_answer(rows, "y", "p", ["q"], weight="w").agg(r6(F.avg("balanced_accuracy")).alias("weighted"))
    i = bootstrap.interval(bootstrap.cluster_macro_accuracy(rows, "l_orderkey", "q", "y", "p"), "balanced_accuracy")
    return point.crossJoin(i).select("weighted", r6("low").alias("low"), r6("high").alias("high"), "reps")  # one row each


_CLASSES = ("A", "N", "R")


@query("lineitem", sql=f"""
    WITH r AS (SELECT l_orderkey, l_returnflag AS t, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 30 THEN 'N' WHEN l_quantity < 45 THEN 'R' END AS p FROM lineitem),
    per AS (SELECT l_orderkey, t, p, count(*) AS n FROM r GROUP BY ALL), size AS (SELECT t, count(*) AS total FROM r GROUP BY t),
    wts AS {bootstrap.weights_sql("(SELECT DISTINCT l_orderkey FROM lineitem)", "l_orderkey", REPS)},
    c AS (SELECT rep, t, p, sum(w * n)::DOUBLE AS n FROM per JOIN wts USING (l_orderkey) GROUP BY ALL), d AS (SELECT rep, t, sum(n) AS drawn FROM c GROUP BY ALL),
    s AS (SELECT c.rep, c.t, c.p, c.n * total / drawn AS n, total FROM c JOIN d ON d.rep = c.rep AND d.t = c.t JOIN size ON size.t = c.t WHERE drawn > 0),
    k AS (SELECT rep, x.t AS k, any_value(total) AS total, sum(n) FILTER (WHERE s.t = x.t AND p = x.t) AS hit, sum(n) FILTER (WHERE p = x.t) AS named FROM s, (VALUES ('A'), ('N'), ('R')) x(t) GROUP BY rep, x.t),
    m AS (SELECT rep, sum(hit) / (SELECT sum(total) FROM size) AS accuracy, avg(hit / z.total) AS balanced_accuracy, avg(2 * hit / (z.total + named)) AS macro_f1 FROM k JOIN size z ON z.t = k.k GROUP BY rep),
    l AS (SELECT rep, metric, value FROM m UNPIVOT (value FOR metric IN (accuracy, balanced_accuracy, macro_f1)))
    SELECT metric, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(*) AS reps FROM l GROUP BY metric""")
def q98_metric_intervals(lineitem):
    """Intervals of every forced-answer metric, units drawn within their class."""
    q = F.col("l_quantity")
    rows = lineitem.select("l_orderkey", F.col("l_returnflag").alias("t"), F.when(q < 15, "A").when(q < 30, "N").when(q < 45, "R").alias("p"))
    long = bootstrap.stratified_metrics(rows, "l_orderkey", "t", "p", _CLASSES).unpivot(["rep"], ["accuracy", "balanced_accuracy", "macro_f1"], "metric", "value")
    return bootstrap.interval(long, "value", ["metric"]).select("metric", r6("low").alias("low"), r6("high").alias("high"), "reps")


@query("events", sql=f"""
    WITH e AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS k FROM events GROUP BY user_id),
    wts AS {bootstrap.weights_sql("(SELECT user_id FROM e)", "user_id", REPS)},
    r AS (SELECT rep, sum(w * k) AS k, sum(w * n) AS n FROM e JOIN wts USING (user_id) GROUP BY rep),
    v AS (SELECT list_sort(list(k::DOUBLE / n)) AS v FROM r WHERE k > 0 AND k < n)
    SELECT round(v[floor(round((len(v) - 1) * 0.025, 9))::INT + 1], 6) AS low, round(v[ceil(round((len(v) - 1) * 0.975, 9))::INT + 1], 6) AS high, len(v)::BIGINT AS reps FROM v""")
def q99_index_interval(events):
    """An interval by index into the sorted replicates; those in which a class is missing do not count."""
    marked = events.select("user_id", F.lit(1).alias("n"), (F.col("event_type") == "error").cast("int").alias("k"))
    reps = bootstrap.replicated_sums(marked, F.col("user_id"), ["n", "k"]).select("rep", F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.col("k") / F.col("n")).alias("share"))
    i = bootstrap.index_interval(reps, "share")
    return i.select(r6("low").alias("low"), r6("high").alias("high"), "reps")


def _ridge_sql(rounds: int = 8) -> str:
    """DuckDB SQL of the rounds of a logistic regression with intercept and one penalised slope over c (x, y, n)."""
    steps = ["b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for i in range(rounds):
        steps.append(f"""g{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) + 1 AS s2, sum(y - n * m) AS g0, sum(x * (y - n * m)) - any_value(b) AS g1
            FROM (SELECT *, n * m * (1 - m) AS w FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS m FROM c, b{i}))),
            b{i + 1} AS (SELECT a + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1) AS a, b + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) AS b FROM g{i})""")
    return ",\n".join(steps)


@query("lineitem", sql=f"""
    WITH r AS (SELECT l_quantity AS q, (l_returnflag = 'R')::INT AS y, l_shipdate < TIMESTAMP '1997-01-01' AS train FROM lineitem), k AS (SELECT avg(q) AS m, stddev_pop(q) AS s FROM r WHERE train),
    c AS (SELECT (q - m) / s AS x, sum(y)::DOUBLE AS y, count(*)::DOUBLE AS n FROM r, k WHERE train GROUP BY x), {_ridge_sql()}
    SELECT q AS l_quantity, count(*) AS n, round(1 / (1 + exp(-(any_value(a) + any_value(b) * (q - any_value(m)) / any_value(s)))), 6) AS blend FROM r, k, b8 WHERE NOT train GROUP BY q""")
def q119_blend(lineitem):
    """A logistic blend of standardised scores, fitted on one split and applied to the other."""
    rows = lineitem.select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).alias("train"))
    told = metrics.logistic_blend(rows, "y", ["l_quantity"], F.col("train")).where("NOT train")
    return told.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), r6(F.max("blend")).alias("blend"))
