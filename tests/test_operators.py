"""Hand-worked values, odd rows and invariants of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import answers, arrays, dates, hashing, text
from ledgerline.operators import bootstrap, contracts, filters, joins, metrics, retrieval, running, sampling, survival, timeline
from ledgerline.operators.running import exact_quantiles, next_order, running_sums


def one(df):
    return df.first()


def test_forced_answers_by_hand(spark):
    rows = spark.createDataFrame(list(zip([1, 1, 1, 0, 0], [1, 0, None, 0, 1])), "t int, p int")
    m = one(metrics.forced_answer(rows, "t", "p"))
    assert (m.n, m.accuracy) == (5, 0.4) and math.isclose(m.balanced_accuracy, (1 / 3 + 1 / 2) / 2)
    c = one(metrics.forced_answer(rows, "t", "p", binary=(0, 1)))
    assert math.isclose(c.sensitivity, 1 / 3) and c.specificity == 0.5 and c.n_unreadable == 1
    rows = spark.createDataFrame(list(zip([0, 0, 1, 2], [0, 1, 1, None])), "t int, p int")
    m = one(metrics.forced_answer(rows, "t", "p"))
    assert m.balanced_accuracy == 0.5 and math.isclose(m.macro_f1, 4 / 9)


def test_auroc_by_hand_and_by_pairs(spark):
    a = lambda rows, **k: one(metrics.auroc(spark.createDataFrame(rows, "y int, s double"), F.col("y"), F.col("s"), **k)).auroc
    assert a([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]) == 0.75
    assert a([(0, 0.5), (1, 0.5), (1, None), (0, float("nan"))]) == 0.5
    assert a([(1, 0.2)]) is None and a([(1, 0.2)], missing=0.5) == 0.5
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(a(rows), want)
    keyed = spark.createDataFrame([(1, *r) for r in rows], "k int, y int, s double")
    assert math.isclose(one(metrics.auroc(keyed, F.col("y"), F.col("s"), ["k"], weight=F.lit(3))).auroc, want)


def test_threshold_options_cost_and_bins(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.3), (1, 0.6), (1, 0.9)], "y int, s double")
    assert math.isclose(one(metrics.best_threshold(rows, "y", "s")).threshold, 0.45)
    shares = spark.createDataFrame([([0.2, 0.4, 0.4], [7, 8, 9])], "p array<double>, c array<bigint>")
    assert one(shares.select(metrics.top_two(F.col("p"), F.col("c")).alias("t"))).t == [8, 9]
    usage = spark.createDataFrame([(100_000, 10, 5, 0), (300_000, 10, None, 3000)], "p long, o long, t long, c long")
    cost = usage.select(metrics.tiered_cost(F.col("p"), F.col("o"), F.col("t"), F.col("c"), 200_000, (1.25, 10.0), (2.5, 15.0)).alias("x"))
    got = [r.x for r in cost.collect()]
    assert math.isclose(got[0], (100_000 * 1.25 + 150) / 1e6) and math.isclose(got[1], (298_000 * 2.5 + 150) / 1e6)
    bins = spark.createDataFrame([(0.0,), (0.55,), (1.0,)], "p double").select(metrics.ten_bins(F.col("p")).alias("b"))
    assert [r.b for r in bins.collect()] == [0, 5, 9]


def test_macro_row_is_a_mean_of_questions(spark):
    q = spark.createDataFrame([("r", "a", 0.4), ("r", "b", 0.8), ("s", "a", 0.5)], "run string, q string, v double")
    got = {(r.run, r.q): r.v for r in metrics.with_macro(q, "q", ["run"], ["v"]).collect()}
    assert math.isclose(got["r", "MACRO"], 0.6) and ("s", "MACRO") not in got


def test_constant_guess_has_a_zero_width_interval(spark):
    rows = spark.createDataFrame([(i % 7, i % 2, 0.3) for i in range(60)], "person long, y int, s double").withColumn("q", F.lit("x"))
    reps = bootstrap.cluster_auroc(rows, "person", "q", F.col("y"), F.col("s"), 30)
    i = one(bootstrap.interval(reps, "auroc"))
    assert i.low == i.high == 0.5
    with pytest.raises(Exception, match="no cluster"):
        bootstrap.cluster_auroc(rows.withColumn("person", F.lit(None).cast("long")), "person", "q", F.col("y"), F.col("s"), 2).collect()


def test_calibration_and_distances(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < p), p) for p in [rng.uniform(0.02, 0.98) for _ in range(3000)]]
    s = one(metrics.calibration_slope(spark.createDataFrame(rows, "y int, p double").withColumn("k", F.lit(1)), "y", "p", ["k"]))
    assert 0.8 < s.slope < 1.2
    flat = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5)], "k int, y int, p double")
    assert one(metrics.calibration_slope(flat, "y", "p", ["k"])).slope is None
    ks = spark.createDataFrame([(1, 1.0, True), (1, 2.0, True), (1, 3.0, False), (1, 4.0, False)], "k int, v double, s boolean")
    assert one(metrics.ks_distance(ks, "v", "s", ["k"])).ks == 1.0
    curves = spark.createDataFrame([([1.0, 0.9],), ([1.0, 0.92],), ([1.0, 0.2],)], "c array<double>")
    r = one(metrics.curve_counts(curves, "c", 0.3))
    assert (r.n, r.near_average, r["distinct"]) == (3, 2, 3)


def test_survival_with_many_ties(spark):
    rng = random.Random(6)
    rows = [(1, float(rng.randint(1, 9)), rng.random() < 0.6, float(rng.randint(0, 4))) for _ in range(120)]
    df = spark.createDataFrame(rows, "g int, t double, e boolean, risk double")
    km = {r.t: r.survival for r in survival.kaplan_meier(df, ["g"], "t", "e").collect()}
    s = 1.0
    for t in sorted({r[1] for r in rows}):
        s *= 1 - sum(r[1] == t and r[2] for r in rows) / sum(r[1] >= t for r in rows)
        assert math.isclose(km[t], s, abs_tol=1e-12)
    g, cens = 1.0, {r.t: r.g for r in survival.censoring(df, ["g"], "t", "e").collect()}
    for t in sorted({r[1] for r in rows}):
        dead, lost = (sum(r[1] == t and r[2] == k for r in rows) for k in (True, False))
        if lost:
            g *= 1 - lost / (sum(r[1] >= t for r in rows) - dead)
        assert math.isclose(cens[t], g, abs_tol=1e-12)
    won = pairs = 0.0
    for a in rows:
        for b in rows:
            if a[2] and (b[1] > a[1] or b[1] == a[1] and not b[2]):
                pairs += 1
                won += 0.5 if a[3] == b[3] else a[3] > b[3]
    c = one(survival.c_index(df, ["g"], "t", "e", "risk"))
    assert c.pairs == pairs and math.isclose(c.c_index, won / pairs)
    no_loss = df.withColumn("e", F.lit(True))
    assert {r.g for r in survival.censoring(no_loss, ["g"], "t", "e").collect()} == {1.0}


def test_steps_trapezoid_and_monotone(spark):
    curve = spark.createDataFrame([(1, 2.0, 0.8), (1, 5.0, 0.5)], "g int, x double, y double")
    pts = spark.createDataFrame([(1, float(i)) for i in range(7)], "g int, at double")
    got = {r["at"]: r.v for r in survival.step_at(pts, curve, ["g"], "at", "x", "y", "v").collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.8, 3: 0.8, 4: 0.8, 5: 0.5, 6: 0.5}
    area = one(survival.trapezoid(curve, ["g"], "x", "y"))
    assert math.isclose(area.area, 3 * 0.65) and area.span == 3
    m = spark.createDataFrame([([1.0, 0.7, 0.9, 0.6],)], "c array<double>").select(survival.monotone(F.col("c")).alias("m"))
    assert one(m).m == [1.0, 0.7, 0.7, 0.6]
    pos = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (2, 0, 2), (2, 1, 2)], "k int, pos int, m int")
    assert {r.k: r.increasing for r in survival.is_monotone(pos, ["k"], "m").collect()} == {1: True, 2: False}


def test_running_sums_over_ranges(spark):
    rows = [(float(i), i % 5) for i in range(300)]
    got = {r.s: r.before_v for r in running_sums(spark.createDataFrame(rows, "s double, v long").repartition(7), "s", ["v"], rows_each=40).collect()}
    assert all(got[float(i)] == sum(r[1] for r in rows[:i]) for i in range(300))
    assert running_sums(spark.createDataFrame([], "s double, v long"), "s", ["v"]).count() == 0


def test_ranges_with_keys_and_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), float(rng.randint(0, 400)) / 4) for _ in range(3000)] + [(None, 1.0), (None, 3.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    per = df.where("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    for each in (100, 10_000):
        got = next_order(running_sums(per, "v", ["n"], ["k"], each), "v", ["k"], rows_each=each).collect()
        for r in got:
            own = sorted(v for k, v in rows if k == r.k and v is not None)
            assert r.before_n == sum(v < r.v for v in own) and r.next == min((v for v in own if v > r.v), default=None)
        assert len(got) == len({(k, v) for k, v in rows if v is not None})
    found = {r.k: r.q for r in exact_quantiles(df.where("k IS NOT NULL"), "v", [0, 0.1, 0.5, 0.9, 1], ["k"], "q").collect()}
    for k in "ab":
        assert np.allclose(found[k], np.quantile([v for x, v in rows if x == k and v is not None], [0, 0.1, 0.5, 0.9, 1]))
    assert one(exact_quantiles(df.limit(0), "v", [0.5], name="q")).q == [None]


def test_range_numbers_count_edges(spark):
    edges = sorted(random.Random(3).sample(range(1000), 150))
    for own in (edges, edges[:32], edges[:33], edges[:1], []):
        got = spark.createDataFrame([(v,) for v in [-1, *range(0, 1001, 7), *own]] + [(None,)], "v int").select("v", running.range_number("v", own).alias("n")).collect()
        assert all(r.n == sum(e <= r.v for e in own) for r in got if r.v is not None)


def test_heavy_values_are_ranges_by_themselves(spark):
    values = [5.0] * 500 + [float(i) for i in range(100)] + [9.0] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cuts = running.cuts_of(df, "v", rows_each=40)[0]
    assert {5.0, 9.0} <= set(cuts.heavy)
    rows = df.select("v", cuts.number(F.col("v")).alias("r"), cuts.is_point(F.col("v")).alias("p")).collect()
    held = {}
    for r in rows:
        held.setdefault(r.r, set()).add(r.v)
    assert all(len(held[r.r]) == 1 for r in rows if r.p) and all(max(a) < min(b) for a, b in zip((held[k] for k in sorted(held)), (held[k] for k in sorted(held)[1:])))


def test_values_are_carried_over_ranges(spark):
    """One key over many tasks: the same rows as one window gives."""
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "a", "a", "a", "b"]), float(rng.randint(0, 300)), i, rng.choice([None, None, None, f"v{i}"]), 1 - rng.random() / 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t double, o int, v string, f double").repartition(5)
    order = [F.col("t"), F.col("o")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = {r.o: (r.last, r.prod) for r in df.select("o", F.last("v", True).over(w).alias("last"), F.product("f").over(w).alias("prod")).collect()}
    for each in (50, 10**6):
        last = running.carried_last(df, ["k"], order, F.col("v"), "last", each)
        assert last.columns == [*df.columns, "last"] and {r.o: r["last"] for r in last.collect()} == {o: x for o, (x, _) in want.items()}
        prod = {r.o: r["prod"] for r in running.carried_product(df, ["k"], order, F.col("f"), "prod", each).collect()}
        assert all(math.isclose(prod[o], p) for o, (_, p) in want.items()) and len(prod) == 2000
    numbered = running.carried_last(df, ["k"], order, F.col("v"), "last", 50)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "__range" in plan  # windows are by key and range
    sizes = df.withColumn("r", running.range_number("t", running.range_edges(df, "t", 50))).groupBy("k", "r").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 150 and sizes[1] > 30


def test_as_of_and_curves_over_ranges(spark):
    rng = random.Random(9)
    left = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 500), i) for i in range(900)], "k string, t int, i int")
    right = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 500), f"v{i}", i) for i in range(400)], "k string, t int, v string, o int")
    a, b = ({r.i: r.got for r in joins.latest_at_or_before(left, right, "k", "t", "t", "v", "o", "got", n).collect()} for n in (60, 10**6))
    assert a == b and len(a) == 900
    people = spark.createDataFrame([("g", rng.randint(1, 400), rng.random() < 0.6) for _ in range(1500)], "g string, t int, e boolean")
    for curve, name in ((survival.kaplan_meier, "survival"), (survival.censoring, "g")):
        x, y = ({r.t: (r.at_risk, r[-1]) for r in curve(people, ["g"] if name == "survival" else [], "t", "e", n).collect()} for n in (20, 10**6))
        assert x.keys() == y.keys() and all(x[t][0] == y[t][0] and math.isclose(x[t][1], y[t][1]) for t in x)


@pytest.mark.parametrize("shape", ["continuous", "few times", "few risks", "ties"])
def test_concordance_by_cells(spark, shape):
    """Pairs inside time ranges, inside risk ranges and between cells add up to all pairs, each counted once."""
    rng = np.random.default_rng(len(shape))
    n = 700
    t = rng.integers(0, 6, n).astype(float) if shape in ("few times", "ties") else rng.random(n)
    r = rng.integers(0, 5, n) / 4 if shape in ("few risks", "ties") else np.round(rng.random(n), 6)
    e = rng.random(n) < 0.5
    df = spark.createDataFrame([(x, bool(y), z, "a" if i % 3 else "b") for i, (x, y, z) in enumerate(zip(t.tolist(), e.tolist(), r.tolist()))], "t double, e boolean, risk double, g string")
    for each in (40, 10**6):
        got = {x.g: (x.c_index, x.pairs) for x in survival.c_index(df, ["g"], "t", "e", "risk", rows_each=each).collect()}
        for g in "ab":
            own = np.array([("a" if i % 3 else "b") == g for i in range(n)])
            tt, rr, ee = t[own], r[own], e[own]
            pair = ee[:, None] & ((tt[None] > tt[:, None]) | ((tt[None] == tt[:, None]) & ~ee[None]))
            won = (pair * ((rr[None] < rr[:, None]) + 0.5 * (rr[None] == rr[:, None]))).sum()
            assert got[g][1] == pair.sum() and math.isclose(got[g][0], won / pair.sum())


def test_cluster_auroc_of_few_scores(spark):
    """Eleven scores that very many clusters share: scores with a range's worth of clusters are summed where they lie."""
    rng = np.random.default_rng(2)
    rows = [(int(i % 2000), "q" if i % 5 else "z", int(rng.random() < 0.3 + 0.05 * (i % 11)), (i % 11) / 10 if i % 7 else float(rng.random())) for i in range(9000)]
    df = spark.createDataFrame(rows, "c long, q string, y int, s double")
    a, b = ({(r.rep, r.q): r.auroc for r in bootstrap.cluster_auroc(df, "c", "q", F.col("y"), F.col("s"), 25, each).collect()} for each in (10**6, 150))
    assert a.keys() == b.keys() and len(a) == 50 and all(math.isclose(a[k], b[k]) for k in a)
    cells = df.groupBy("q", "s", "c").count()
    cuts = running.cuts_of(cells, "s", rows_each=150)[0]
    assert len(cuts.heavy) >= 11
    inside = cells.where(~cuts.is_point(F.col("s"))).groupBy("q", cuts.number(F.col("s")).alias("r")).count().agg(F.max("count")).first()[0]
    assert inside <= 450


def test_weights_are_poisson_and_alike_in_every_engine(spark):
    import duckdb

    w = bootstrap.weights(np.arange(20_000, dtype=np.uint64) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF), np.arange(50))
    shares = np.bincount(w.ravel(), minlength=9) / w.size
    assert np.allclose(shares[:6], [0.36788, 0.36788, 0.18394, 0.06131, 0.01533, 0.00307], atol=0.003)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.5
    df = spark.createDataFrame([(i, 1) for i in range(40)], "c long, v int")
    got = {r.rep: r.v for r in bootstrap.replicated_sums(df, F.col("c"), ["v"], 130).collect()}
    want = duckdb.sql(f"SELECT rep, sum(w) AS v FROM {bootstrap.weights_sql('(SELECT range AS c FROM range(40))', 'c', 130)} GROUP BY rep").fetchall()
    assert got == {r: float(v) for r, v in want}


def test_auroc_replicates_do_not_depend_on_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 60), rng.choice("xy"), int(rng.random() < 0.4), float(rng.randint(0, 30))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "c long, q string, y int, s double")
    a, b = ({(r.rep, r.q): r.auroc for r in bootstrap.cluster_auroc(df, "c", "q", F.col("y"), F.col("s"), 30, each).collect()} for each in (10**6, 200))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)


def test_stratified_metrics_of_a_sure_answer(spark):
    rows = [(i, "ab"[i % 2], "ab"[i % 2]) for i in range(100)] + [(i, "a", None) for i in range(100, 150)]
    m = bootstrap.stratified_metrics(spark.createDataFrame(rows, "u long, t string, p string"), "u", "t", "p", ["a", "b"], 200)
    i = one(bootstrap.interval(m, "accuracy"))
    assert i.low < 2 / 3 < i.high and one(bootstrap.interval(m, "balanced_accuracy")).high < 0.9
    sure = bootstrap.stratified_metrics(spark.createDataFrame(rows[:100], "u long, t string, p string"), "u", "t", "p", ["a", "b"], 50)
    assert {(r.accuracy, r.balanced_accuracy, r.macro_f1) for r in sure.collect()} == {(1.0, 1.0, 1.0)}
    by_index = one(bootstrap.index_interval(spark.createDataFrame([(float(v),) for v in range(11)] + [(None,)], "v double"), "v"))
    assert (by_index.low, by_index.high, by_index.reps) == (0.0, 10.0, 11)


def test_forced_answers_with_unreadable_ones(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (1, None), (0, 0), (0, 1)], "t int, p int")
    r = one(metrics.forced_answer(rows, "t", "p", binary=(0, 1)))
    assert (r.n, r.n_unreadable, r.accuracy) == (5, 1, 0.4) and math.isclose(r.sensitivity, 1 / 3) and r.specificity == 0.5


def test_regressions_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = 2 + x @ [0.5, -1.5] + rng.normal(size=400)
    label = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0])))).astype(int)
    rows = [(int(i % 2), float(a) if i % 9 else None, float(b), float(t), int(z), i % 4 > 0) for i, ((a, b), t, z) in enumerate(zip(x, y, label))]
    df = spark.createDataFrame(rows, "k int, a double, b double, t double, z int, train boolean")
    for r in metrics.least_squares(df, "t", ["a", "b"], ["k"]).collect():
        own = [(1, q[1], q[2], q[3]) for q in rows if q[0] == r.k and q[1] is not None]
        want = np.linalg.lstsq(np.array([q[:3] for q in own]), np.array([q[3] for q in own]), rcond=None)[0]
        assert np.allclose([r.intercept, *r.coefficients], want)
    flat = one(metrics.least_squares(df.withColumn("b", F.lit(1.0)), "t", ["b"]))
    assert flat.intercept is None
    got = metrics.logistic_blend(df, "z", ["a", "b"], F.col("train")).collect()
    assert len(got) == 400
    z = np.array([[1, *v] for v in _standard(rows)])
    fit, t = np.array([q[5] for q in rows]), np.array([q[4] for q in rows])
    beta = np.zeros(z.shape[1])
    for _ in range(40):
        m = 1 / (1 + np.exp(-z[fit] @ beta))
        pen = np.diag([0.0] + [1.0] * (z.shape[1] - 1))
        beta = beta + np.linalg.solve((z[fit] * (m * (1 - m))[:, None]).T @ z[fit] + pen, z[fit].T @ (t[fit] - m) - pen @ beta)
    want = {q[2]: p for q, p in zip(rows, 1 / (1 + np.exp(-z @ beta)))}
    assert all(abs(r.blend - want[r.b]) < 1e-6 for r in got)


def _standard(rows):
    out = []
    for i in (1, 2):
        own = [q[i] for q in rows if q[5] and q[i] is not None]
        out += [[np.mean(own) if q[i] is None else q[i] for q in rows], [float(q[i] is None) for q in rows]]
    m = np.array(out)
    fit = np.array([q[5] for q in rows])
    spread = m[:, fit].std(axis=1, keepdims=True)
    return np.where(spread > 0, (m - m[:, fit].mean(axis=1, keepdims=True)) / np.where(spread > 0, spread, 1), 0).T


def test_c_index_over_time_ranges(spark):
    rng = random.Random(16)
    rows = [(1, float(rng.randint(1, 30)), rng.random() < 0.6, float(rng.randint(0, 9))) for _ in range(600)]
    df = spark.createDataFrame(rows, "g int, t double, e boolean, risk double")
    a, b = (one(survival.c_index(df, ["g"], "t", "e", "risk", rows_each=n)) for n in (10**6, 60))
    assert a.pairs == b.pairs and math.isclose(a.c_index, b.c_index)


def test_contradicting_horizons_costs_and_options(spark):
    rows = spark.createDataFrame([(0.3, 0.2), (0.1, 0.2), (None, 0.4), (0.9, 0.1)], "a double, b double")
    r = one(metrics.horizon_conflicts(rows, F.col("a"), F.col("b"), F.col("a") > 0.5, F.col("b") > 0.5))
    assert (r.n, r.near_above_far, r.yes_then_no) == (4, 2, 1)
    seen = spark.createDataFrame([("t", "x", 1.0), ("t", "x", 3.0), ("u", "y", 5.0)], "task string, arm string, cost double")
    todo = spark.createDataFrame([("t", "x", 10), ("v", "x", 10), ("u", "y", 2), ("u", "z", 2)], "task string, arm string, n int")
    got = {(r.task, r.arm): r.forecast for r in metrics.cost_forecast(seen, todo, "task", "arm", "cost", "n").collect()}
    assert got == {("t", "x"): 20.0, ("v", "x"): 20.0, ("u", "y"): 10.0, ("u", "z"): None}
    golden = spark.createDataFrame([(0, [0.6, 0.4]), (0, [0.3, 0.7]), (1, [0.7, 0.3]), (1, None)], "y int, p array<double>")
    r = one(metrics.option_scores(golden, "y", "p", [0, 1]))
    assert r.balanced_accuracy == 0.25 and r.top_two == 0.75 and r.auroc == 0.0


def test_windows_filters_and_leaks(spark):
    e = spark.sql("SELECT timestamp_ntz'2024-01-08 00:00:00' AS a, explode(array(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2023-12-31 23:59:59', timestamp_ntz'2024-01-08 00:00:00', timestamp_ntz'2024-01-08 00:00:01', NULL)) AS t")
    assert e.where(filters.in_window(F.col("t"), F.col("a"), "7d")).count() == 2
    assert e.where(filters.in_window(F.col("t"), F.lit(None).cast("timestamp_ntz"), "7d")).count() == 4
    month = spark.sql("SELECT timestamp_ntz'2024-08-31 00:00:00' AS a").select(dates.shifted(F.col("a"), "6mo", -1).alias("x"))
    assert str(one(month).x) == "2024-02-29 00:00:00"
    assert dates.parse_duration("2w") == {"hours": 336} and dates.parse_duration("12h") == {"hours": 12} and dates.parse_duration("10") == {"hours": 240}
    with pytest.raises(ValueError):
        dates.parse_duration("soon")
    with pytest.raises(KeyError):
        filters.chain(e, [{"fn": "nothing"}])
    leaks = {r.column: r.later for r in filters.leak_counts(e, F.lit("2024-01-07").cast("date")).collect()}
    assert leaks == {"a": 5, "t": 2}
    a, b = filters.two_way(e, F.col("t").isNotNull())
    assert (a.count(), b.count()) == (4, 1)
    assert filters.resolve_column(e, "T") == "t" and filters.present(e, ["t", "zz"]).columns == ["t"] and filters.strict(e, ["zz"]) is None
    ages = spark.sql("SELECT date'2000-02-29' AS b, explode(array(date'2023-02-28', date'2024-02-28', date'2024-02-29')) AS a").select(dates.age_at(F.col("b"), F.col("a")).alias("y"))
    assert [r.y for r in ages.collect()] == [22, 23, 24]


def test_labels_and_answers(spark):
    df = spark.createDataFrame([(x,) for x in ["1.0", "-1", "x", None, "2"]], "v string")
    assert [r.n for r in df.select(answers.normal_label(F.col("v")).alias("n")).collect()] == ["1", "-1", "x", None, "2"]
    assert [r.n for r in df.select(answers.excluded_label(F.col("v"), [-1, "x"]).alias("n")).collect()] == [False, True, True, False, False]
    p = lambda t: one(spark.createDataFrame([(t,)], "t string").select(answers.probability(F.col("t")).alias("p"))).p
    assert [p(t) for t in ['{"probability": 42}', "42%", "Probability: 42", "1 or 2", "none", "140", "I am sorry, 40", '{"probability": true}']] == [0.42, 0.42, 0.42, None, None, None, None, None]
    o = lambda t: one(spark.createDataFrame([(t,)], "t string").select(answers.option_shares(F.col("t"), ["a", "b"]).alias("p"))).p
    assert o('{"a": 30, "b": 10}') == {"a": 0.75, "b": 0.25} and o('{"a": 0, "b": 0}') is None and o('{"a": 1}') is None and o('{"a": 1.5, "b": 2}') is None
    y = spark.createDataFrame([("Final answer: no ... Final Answer: **Yes**", " NO "), ("none", '{"answer": "Yes"}')], "f string, s string")
    assert [tuple(r) for r in y.select(answers.final_answer(F.col("f")), answers.schema_answer(F.col("s"))).collect()] == [("yes", "no"), (None, "yes")]
    k = spark.createDataFrame([('["a b", "c", "<x>"]',), ("use 'fever' and 'cough'",), ("x, y , ,z",)], "t string").select(answers.keywords(F.col("t"), 2).alias("k"))
    assert [r.k for r in k.collect()] == [["a b", "c"], ["fever", "cough"], ["x", "y"]]
    pad = spark.createDataFrame([(["a", "B"], ["b", "task", "word"], ["a"])], "o array<string>, f array<string>, s array<string>")
    assert one(pad.select(answers.padded_keywords(F.col("o"), F.col("f"), F.col("s"), 3).alias("k"))).k == ["B", "b", "task"]
    assert answers.boxed(r"a \boxed{x{y}z} b \boxed{open") == ["x{y}z"]
    assert answers.primary_answer("<answer></answer> Maybe") == "Maybe" and answers.primary_answer("<label>Two</label>") == "Two"
    lp = spark.createDataFrame([({"yes": -1.0, "No": -2.0},)], "m map<string,double>").select(answers.yes_probability(F.col("m")).alias("p"))
    assert math.isclose(one(lp).p, math.exp(-1) / (math.exp(-1) + math.exp(-2)))


def test_lines_and_budgets(spark):
    e = spark.sql("SELECT timestamp_ntz'2024-03-01 10:05:00' AS t, 'A/1' AS c, 'desc' AS d, 2.25D AS v, 'mg' AS u, ' two\nlines ' AS n UNION ALL SELECT NULL, 'B', NULL, NULL, NULL, NULL")
    lines = e.select(text.event_line(F.col("t"), F.col("c"), F.col("d"), text.rounded_text(F.col("v")), F.col("u"), F.col("n"), 5).alias("x")).collect()
    assert [r.x for r in lines] == ["[2024-03-01 10:05] | A/1 (desc) | VALUE: 2.2 mg | NOTE: two l...", "B"]
    full = "\n".join(f"[2024-01-{d:02d} 10:00] | code {d}" for d in range(1, 11))
    column = lambda t, c: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    kept = column(full, lambda t: text.keep_latest(t, 130))
    assert kept.startswith(text.OMITTED) and kept.endswith("code 10") and len(kept) <= 130
    cut = column("x" * 500, lambda t: text.keep_latest(t, 100))
    assert cut.startswith(text.OMITTED + "\nxxx") and len(cut) == 100 and column("short", lambda t: text.keep_latest(t, 100)) == "short"
    assert column(full, lambda t: text.last_k_dates(t, 2)) == "\n".join(full.split("\n")[-2:])
    t = spark.createDataFrame([(full,), (text.NO_EVENTS,), (None,)], "t string")
    assert [(r[0], r[1]) for r in t.select(text.count_events(F.col("t")), text.event_dates(F.col("t"))).collect()] == [(10, 10), (0, 0), (0, 0)]
    r = spark.createDataFrame([("a [M] b [M]",), ("none",)], "t string").select(text.replace_first(F.col("t"), "[M]", F.lit("x")).alias("r"))
    assert [x.r for x in r.collect()] == ["a x b [M]", "none"]
    tags = spark.createDataFrame([("<Answer>one</answer> <answer>two",), ("<answer> rest",), ("no",)], "t string").select(text.open_tag(F.col("t"), "answer").alias("a"))
    assert [x.a for x in tags.collect()] == ["one", "rest", ""]


def test_joins_refuse_duplicates_and_pick_rows(spark):
    rows = spark.createDataFrame([("007", 1), ("008", 2)], "acc string, x int")
    link = spark.createDataFrame([("007", 30)], "acc string, gap int")
    assert {r.acc: r.gap for r in joins.attach_link(rows, link, {"acc": "acc"}).collect()} == {"007": 30, "008": None}
    with pytest.raises(Exception, match="repeats"):
        joins.attach_link(rows, link.union(link), {"acc": "acc"}).collect()
    assert joins.attach_link(rows.withColumn("acc", F.col("acc").cast("int")), link, {"acc": "acc"}).where("gap = 30").count() == 0  # as text, 7 is not 007
    assert {r.acc: r.gap for r in joins.one_to_one(rows, link, ["acc"]).collect()} == {"007": 30}
    with pytest.raises(Exception, match="repeats"):
        joins.one_to_one(rows.union(rows), link, ["acc"]).collect()
    assert joins.without_done(rows, link, ["acc"]).count() == 1
    days = spark.createDataFrame([(1, -10, "b"), (1, 10, "a"), (1, 200, "c"), (2, 90, "d")], "p int, day int, acc string")
    near = joins.pick(days, ["p"], F.col("day").between(-60, 30), [F.abs("day"), F.col("day"), F.col("acc")], F.col("acc"), "start")
    assert [(r.p, r.start) for r in near.collect()] == [(1, "b")]
    wide = joins.label_columns(spark.createDataFrame([(1, "t", 1), (1, "u", -1)], "k int, t string, l int"), "k", "t", "l", ["t", "u", "v"], [0, 1])
    assert tuple(one(wide)) == (1, 1, None, None)
    both = joins.append_absent(rows, spark.createDataFrame([("008", 9), ("009", 3)], "acc string, x int"), ["acc"])
    assert sorted(r.x for r in both.collect()) == [1, 2, 3]
    assert {(r.a, r.b) for r in joins.pairs(spark.createDataFrame([("x",), ("y",), ("z",)], "n string"), "n").collect()} == {("x", "y"), ("x", "z"), ("y", "z")}
    assert tuple(one(joins.label_clashes(rows, rows.withColumn("x", F.lit(1)), ["acc"], "x"))) == (2, 1)


def test_contracts_and_diffs(spark):
    good = spark.createDataFrame([("c1", "r", 0.4, None), ("c2", "r", None, "yes")], "case_id string, run string, p double, answer string")
    contracts.require_layout(good, ["case_id"], ["case_id"], "run", "p", "answer")
    for bad in (good.union(good), good.withColumn("p", F.lit(1.4)), good.withColumn("answer", F.lit(None).cast("string")), good.withColumn("run", F.col("case_id"))):
        with pytest.raises(contracts.ContractError):
            contracts.require_layout(bad, ["case_id"], ["case_id"], "run", "p", "answer")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(good, ["nope"])
    a, b = good.select("case_id", F.lit("x  \ny").alias("t")), good.select("case_id", F.lit("x\ny").alias("t"))
    assert {r.diff_t for r in contracts.run_diff(a, b, ["case_id"], ["t"], ["t"]).collect()} == {False}
    assert {r.diff_t for r in contracts.run_diff(a, b, ["case_id"], ["t"]).collect()} == {True}
    assert tuple(one(contracts.completeness(good, good.where("case_id = 'c2'"), ["case_id"], "answer"))) == (2, 1, 1)
    errors = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "e string")
    assert [(r.e, r.n) for r in contracts.frequent_errors(errors, "e", 1).collect()] == [("x", 2)]
    reasons = spark.createDataFrame([("r1", "labs", "2024-01-01"), ("r1", "other", "2024-05-01")], "record string, file string, date string")
    got = contracts.cited_evidence(reasons, spark.createDataFrame([("r1", "2024-01-01")], "record string, date string"), ["labs"], F.lit("2024-02-01")).collect()
    assert sorted((r.file, r.allowed, r.in_time, r.found) for r in got) == [("labs", True, True, True), ("other", False, False, False)]
    nums = spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double")
    assert contracts.agrees(nums, nums, ["k"], ["v"]).count() == 0 and contracts.agrees(nums, nums.fillna(0.1), ["k"], ["v"]).count() == 1
    assert [r.k for r in contracts.reconciled(nums, nums.where("k = 1"), "k").collect()] == [2]
    assert [r.k for r in contracts.inconsistent(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, s string"), ["k"], ["s"]).collect()] == [1]


def test_samples_are_nested_and_order_free(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(200)], "id long, label int")
    small = {r.id for r in sampling.per_class(rows, "label", "id", 5, "s").collect()}
    large = {r.id for r in sampling.per_class(rows.repartition(9), "label", "id", 20, "s").collect()}
    assert len(small) == 15 and small < large and len(large) == 60
    marked = rows.withColumn("rare", F.when(F.col("id") < 4, "yes").otherwise("no"))
    cover = [r.id for r in sampling.greedy_cover(marked, "id", ["label", "rare"], 3, 12, "c").collect()]
    assert len(cover) == len(set(cover)) == 12 and sum(i < 4 for i in cover) >= 3
    assert sampling.greedy_cover(marked.limit(0), "id", ["label", "rare"], 3, 12, "c").count() == 0 and sampling.greedy_cover(marked, "id", ["rare"], 3, 10**6, "c").count() == rows.count()
    pool = sampling.enriched_pool(rows.withColumn("person", F.floor(F.col("id") / 2)), "person", "id", ["label"], 2, 10, "p")
    assert pool.count() == 10 and pool.select("person").distinct().count() == 10
    tiles = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a"])], "k int, t array<string>").select(sampling.tile_sample("t", "k", 2, "z").alias("s")).collect()
    assert len(tiles[0].s) == 2 and tiles[1].s == ["a"]
    assert hashing.case_set_hash(rows, "id") == hashing.case_set_hash(rows.repartition(5).union(rows), "id") != hashing.case_set_hash(rows.where("id > 0"), "id")


def test_retrieval_rounds(spark):
    docs = spark.createDataFrame([(1, "p", "alpha beta beta"), (2, "p", "beta gamma gamma"), (3, "p", "gamma delta"), (4, "q", "alpha"), (5, "q", None)], "id long, person string, note string")
    hits = retrieval.search(docs, "id", "person", "note", F.array(F.lit("alpha")), 3).collect()
    assert {(r.person, r.id, r["rank"]) for r in hits} == {("p", 1, 1), ("q", 4, 1)}
    n, df_, dl, avg = 3, 1, 3, 8 / 3
    want = math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg))
    assert math.isclose(next(r.score for r in hits if r.id == 1), want)
    got = {(r.person, r.id): r.iteration for r in retrieval.iterative_search(docs, "id", "person", "note", ["alpha"], 3, 5, 1).collect()}
    assert got["p", 1] == 0 and got["p", 2] == 1
    said = retrieval.summarised(docs, "note", lambda ts: [t[:5] if t != "alpha" else "" for t in ts], 50)
    assert {r.id: r.summary for r in said.collect()} == {1: "alpha", 2: "beta ", 3: "gamma", 4: "alpha", 5: None}
    steps = retrieval.per_iteration(spark.createDataFrame([(1, ["a", "b"])], "p int, s array<string>"), "s", [F.col("p")])
    assert [(r["index"], r.step) for r in steps.collect()] == [("1-0", "a"), ("1-1", "b")]
    cached = retrieval.with_cached(docs.select("id", "note"), spark.createDataFrame([(2, "old", "sum"), (3, "old", None)], "id long, note string, summary string"), ["id"], "note", "summary")
    assert {r.id: r.note for r in cached.collect()} == {1: "alpha beta beta", 2: "sum", 3: "old", 4: "alpha", 5: None}


def test_index_generators(spark):
    def plain(d, k):
        return [int(i / (k - 1) * (d - 1)) if k > 1 else 0 for i in range(k)]

    df = spark.range(1, 40).select(F.col("id").cast("int").alias("d"))
    cols = [arrays.evenly_spaced(F.col("d"), 7), arrays.up_to(F.col("d"), 7), arrays.uniform_tail(F.col("d"), 9), arrays.fraction_range(F.col("d"), 5, 0.25, 0.75), arrays.every_nth(F.col("d"), 4), arrays.centre(F.col("d")), arrays.centre_run(F.col("d"), 6), arrays.index_range(F.col("d"), 2, 8)]
    for r in df.select("d", *cols).collect():
        d = r[0]
        a, b = round(0.25 * (d - 1)), round(0.75 * (d - 1))
        want = [plain(d, 7), list(range(d)) if d <= 7 else plain(d, 7), list(range(d)) if d <= 9 else [round(i / 9 * (d - 1)) for i in range(1, 10)], sorted({round(a + (b - a) * j / 4) for j in range(5)}), list(range(0, d, 4)), [d // 2], list(range(d)) if d <= 6 else list(range((d - 6) // 2, (d - 6) // 2 + 6)), list(range(2, min(8, d)))]
        assert list(r[1:]) == want
    none = spark.createDataFrame([(0,)], "d int").select(*[c for c in cols])
    assert all(x == [] for x in one(none))


def test_keep_first_last_and_fill(spark):
    e = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, None)], "k int, o int, v string")
    assert one(timeline.keep_one(e, ["k"], [F.col("o")])).v == "a" and one(timeline.keep_one(e, ["k"], [F.col("o")], last=True)).v == "c"
    assert [r.f for r in timeline.forward_fill(e, ["k"], [F.col("o")], F.col("v"), "f").orderBy("o").collect()] == ["a", "a", "c"]
    d = timeline.distinct_events(spark.createDataFrame([(1, "e1", None, "x"), (1, "e1", None, "x"), (1, None, "t", "y"), (1, "e2", "2024", "z")], "k int, id string, t string, l string"), ["k"], "id", "t", F.col("l"))
    assert one(d).patient_string == "x\nz"


def test_nearest_targets_over_blocks(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=(37, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    targets = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "n int, w array<double>")
    cos = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None]
    for block in (1000, 5):
        got = {r.i: r.nearest for r in joins.nearest(df, "i", "v", targets, "n", "w", block).collect()}
        assert got == {i: int(k) for i, k in enumerate(cos.argmax(1))}


def test_pivots_skip_targets_and_lose_none(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 8)) * 3
    y = np.concatenate([centres[rng.integers(0, 20, 800)] + 0.1 * rng.normal(size=(800, 8)), np.zeros((2, 8))])
    y[50:60] = y[40]  # equal targets: the smaller name
    x = np.concatenate([centres[rng.integers(0, 20, 150)] + 0.2 * rng.normal(size=(150, 8)), y[40:42], np.zeros((1, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "i long, v array<double>").repartition(3)
    targets = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "n int, w array<double>")
    with np.errstate(invalid="ignore"):
        cos = np.round((x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None], 9)
    got = {r.i: (r.nearest, r.cos) for r in joins.nearest(df, "i", "v", targets, "n", "w", 30).collect()}
    assert len(got) == 154 and got[152] == (0, None) == got[999]
    assert all(got[i][0] == int(np.nanargmax(cos[i])) for i in range(152))
    dealt, gathered = joins.pivot_pairs(df, "i", "v", targets, "n", "w", 30)
    met = dealt.join(gathered, ["__pivot", "__piece"]).agg(F.sum(F.size("__targets"))).first()[0]
    assert met < 152 * 800 / 4  # of 121,600 pairs


def test_truncation_candidates_and_headers(spark):
    column = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c.alias("x")).first().x
    four, five = "a\nb\nc\nd", "a\nb\nc\nd\ne"
    assert column(text.truncate(F.col("t"), 3), t=four) == four
    assert column(text.truncate(F.col("t"), 5), t=five) == "\na\nb\n" + text.TRUNCATED and column(text.truncate(F.col("t"), 50), t=five) == "\n" + five
    assert column(text.truncate(F.col("t"), 1), t=five) == ""
    assert answers.answer_candidates("<answer></answer> No") == ["No", "<answer></answer> No"]
    assert "x" * 51 not in answers.answer_candidates(f"<{'x' * 51}> a") and "x" * 50 in answers.answer_candidates(f"<{'x' * 50}> a")
    assert answers.answer_candidates("one | two | <Yes>") == ["Yes", "one | two", "<Yes>", "one"]
    assert "no clear progression of disease" in answers.answer_candidates("no clear progression of disease")
    assert answers.answer_candidates("Yes | a | b") == ["Yes | a", "b", "Yes"]
    for said, left in (('"The answer is: [x] yes [TRUNCATED 3] "', ": [x] yes"), ("a [b] c [was truncated]", "a"), ("'", "'"), ("Answer:  The  answer", "The answer"), ("[truncated] kept", "[truncated] kept")):
        assert answers.tidy(said) == left
    assert answers.boxed("\\boxed{" * 5000) == [] and answers.boxed("\\boxed{a\\boxed{b}}\\boxed{c}") == ["a\\boxed{b}", "c"]
    assert column(text.demographics(F.lit(None), F.lit("male")), t="") == "PATIENT: age unknown years at the prediction time; sex male."
    with pytest.raises(ValueError):
        dates.parse_duration("6m")
    assert column(dates.parse_time(F.col("t")), t="2024-01-02T03:04:05.678").second == 5
    full = "head\n" + "\n".join(f"[2024-01-{d:02d} 10:00] | code {d}" for d in range(1, 6))
    assert column(text.last_k_dates(F.col("t"), 9), t=full) == full and column(text.last_k_dates(F.col("t"), 3, 60), t=full) == "\n".join(full.split("\n")[-2:])
    assert column(text.keep_latest(F.col("t"), 70), t="a\n" * 60 + "\n") == text.OMITTED + "\n" + "a\n" * ((70 - len(text.OMITTED) - 1 - 2) // 2) + "\n"


def test_rows_per_group_flag_notes_and_master(spark):
    rows = spark.createDataFrame([(None, True), (None, False), (1, False), (1, None), (2, True)], "k int, f boolean")
    assert sorted((str(r.k), r.any) for r in filters.group_any(rows, ["k"], F.col("f"), "any").collect()) == [("1", False), ("1", False), ("2", True), ("None", True), ("None", True)]
    v = spark.createDataFrame([(1, [1.0, 0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0, 1.0])], "i int, v array<double>")
    master = spark.createDataFrame([([2.0, 0.0],)], "m array<double>")
    assert [r.i for r in joins.alike(v, arrays.second_half(F.col("v")), master, "m", 0.999).collect()] == [1]
    with pytest.raises(ValueError):
        joins.alike(v, F.col("v"), master.union(master), "m", 0.5)


def test_windows_in_whole_numbers(spark):
    r = spark.createDataFrame([([-5.0, 0.0, 0.5, 1.0, 9.0],)], "v array<double>").select(arrays.window_bytes(F.col("v"), 0.0, 1.0, True).alias("a"), arrays.window_bytes(F.col("v"), 0.0, 1.0, False).alias("b"), arrays.three_windows(F.col("v"), [(0.0, 1.0), (-5.0, 5.0), (0.0, 9.0)]).alias("c")).first()
    assert r.a == [0, 0, 128, 255, 255] and r.b == [0, 0, 127, 255, 255]
    assert [tuple(x) for x in r.c][0] == (0, 0, 0) and [tuple(x) for x in r.c][4] == (255, 255, 255) and [tuple(x) for x in r.c][1] == (0, 128, 0)


@pytest.mark.parametrize("width", [None, 1, 3600, 10**9])
def test_events_of_many_anchors(spark, width):
    """No pair outside an anchor's bins, and every pair within its interval once."""
    rng = random.Random(11)
    at = lambda: f"2024-03-{rng.randint(1, 9):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}"
    anchors = [(i, rng.choice(["p", "p", "p", "q", None]), *sorted((at(), at()))) for i in range(60)] + [(60, "p", None, at()), (61, "p", "2024-03-05 00:00:00", "2024-03-04 00:00:00")]
    events = [(1000 + i, rng.choice(["p", "p", "q", None]), at() if i % 20 else None, i) for i in range(150)] + [(2000, "p", anchors[0][2], 0), (2001, "p", anchors[1][3], 0)]
    a = spark.createDataFrame(anchors, "i int, k string, a string, b string").select("i", "k", *[F.col(c).cast("timestamp_ntz").alias(c) for c in "ab"])
    e = spark.createDataFrame(events, "e int, k string, t string, i int").select("e", "k", F.col("t").cast("timestamp_ntz").alias("t"), "i")
    met = joins.in_intervals(a, e, ["k"], F.col("a"), F.col("b"), F.col("t"), width)
    assert met.columns == ["i", "k", "a", "b", "e", "t"]
    got = sorted((r.i, r.e) for r in met.collect())
    assert got == sorted((i, x) for i, k, lo, hi in anchors for x, p, t, _ in events if k and k == p and t and lo and lo <= t <= hi)


def test_input_checks_by_hand(spark):
    rows = [("a", True, "Age: 61, Sex: unknown", True, True, False, False, False, 0), ("a", True, "Age: unknown, Sex: male", True, True, True, True, True, 0), ("a", False, None, None, None, None, None, None, 2), ("no_notes", True, "", True, True, None, False, None, 0)]
    df = spark.createDataFrame(rows, "arm string, h boolean, s string, rec boolean, win boolean, late boolean, gone boolean, cut boolean, after int")
    got = {r.arm: r for r in contracts.record_qa(df, "arm", "h", "s", "rec", "win", "late", "gone", "cut", "after", ["no_notes"]).collect()}
    assert tuple(got["a"])[1:] == (3, 2, 1, 1, 2, 2, 1, 1, 1, 2, 2) and tuple(got["no_notes"])[1:] == (1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0)
    rows = [("x", 30, 30, None, [5.0, 1.0], True, 10), ("x", 29, 30, "gone", None, False, None), ("x", 29, 30, None, [3.0], True, 0), ("x", 30, 30, None, [1.0, 1.5, 1.9], None, 4)]
    df = spark.createDataFrame(rows, "arm string, n int, m int, err string, s array<double>, prior boolean, gap int")
    (r,) = contracts.image_qa(df, "arm", "n", "m", "err", "s", "prior", "gap").collect()
    assert tuple(r)[1:] == (4, 2, 1, 2, 2, 1, 1, 0.5, 5.0)


def test_weights_are_bytes_counted_by_thresholds():
    hashes, rep = np.random.default_rng(2).integers(0, 1 << 32, 5000, dtype=np.uint64), np.arange(40)
    w = bootstrap.weights(hashes, rep)
    assert w.dtype == np.uint8  # eight bytes a weight before

    def mixed(x):
        for _ in range(2):
            x = (x ^ x >> 16) * bootstrap.MIX & 0xFFFFFFFF
        return x ^ x >> 16

    for i, r in ((0, 0), (17, 3), (4999, 39)):
        u = mixed(int(hashes[i]) ^ mixed((r + 1) * bootstrap.SPREAD & 0xFFFFFFFF))
        assert w[i, r] == sum(u >= d for d in bootstrap.DRAWN)
