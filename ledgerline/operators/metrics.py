"""Scores as aggregations: confusion, forced answers, ranking, calibration, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.running import exact_quantiles, running_sums
from ledgerline.storage import written


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(df: DataFrame, truth: Column, pred: Column, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn and the rates they give; null where a rate has no rows."""
    c = lambda t, p: F.count_if((truth == t) & (pred == p))
    counts = df.groupBy(*keys).agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(0, 0).alias("tn"), c(1, 0).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    f1 = lambda hit, other: ratio(2 * hit, 2 * hit + other)
    pos, neg, errors = tp + fn, tn + fp, fp + fn
    weighted = ratio(F.coalesce(f1(tp, errors), F.lit(0.0)) * pos + F.coalesce(f1(tn, errors), F.lit(0.0)) * neg, pos + neg)
    return counts.select(*keys, "tp", "fp", "tn", "fn", ratio(tp, pos).alias("sensitivity"), ratio(tn, neg).alias("specificity"), ratio(tp + tn, pos + neg).alias("accuracy"), weighted.alias("weighted_f1"))


def forced_answer(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = (), weight: str | None = None, binary: Sequence | None = None) -> DataFrame:
    """n, accuracy, balanced accuracy and macro F1 over the classes in truth; an unreadable (null) prediction is wrong and
    counted. binary (negative, positive): also sensitivity and specificity, where the class is there."""
    w = F.lit(1) if weight is None else F.col(weight)
    cells = df.groupBy(*keys, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.sum(w).alias("c"))
    none = F.lit(0).cast("bigint")
    marks = cells.select(*keys, F.col("t").alias("cls"), F.col("c").alias("support"), F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0).alias("hit"), none.alias("named"), F.when(F.col("p").isNull(), F.col("c")).otherwise(0).alias("unread")).unionByName(
        cells.where("p IS NOT NULL").select(*keys, F.col("p").alias("cls"), none.alias("support"), none.alias("hit"), F.col("c").alias("named"), none.alias("unread"))
    )
    by_class = marks.groupBy(*keys, "cls").agg(*[F.sum(x).alias(x) for x in ("support", "hit", "named", "unread")]).where("support > 0")
    recall = ratio(F.col("hit"), F.col("support"))
    own = [F.max(F.when(F.col("cls") == c, recall)).alias(name) for c, name in zip(reversed(binary), ("sensitivity", "specificity"))] if binary else []
    return by_class.groupBy(*keys).agg(
        F.sum("support").cast("bigint").alias("n"), F.sum("unread").cast("bigint").alias("n_unreadable"), ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"), F.avg(ratio(2 * F.col("hit"), F.col("support") + F.col("named"))).alias("macro_f1"), *own,
    )


def auroc(df: DataFrame, label: Column, score: Column, keys: Sequence[str] = (), weight: Column | None = None, missing: float | None = None) -> DataFrame:
    """Mann-Whitney AUROC, ties half; unreadable scores are left out and counted; one class gives null, or `missing`.

    Rows are first summed per (keys, score); running sums go in score ranges, so no task holds all scores of a key."""
    w = F.lit(1) if weight is None else weight
    y, s = label.cast("int"), F.when(~F.isnan(score), score)
    rows = df.select(*keys, y.alias("__y"), s.alias("__s"), w.alias("__w"))
    per = rows.groupBy(*keys, "__s").agg(F.sum(F.when(F.col("__y") == 1, F.col("__w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("__y") == 0, F.col("__w")).otherwise(0)).alias("neg"))
    cum = running_sums(per.where("__s IS NOT NULL"), "__s", ["neg"], keys)
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    value = ratio(won, F.sum("pos") * F.sum("neg").cast("double"))
    return cum.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), (value if missing is None else F.coalesce(value, F.lit(missing))).alias("auroc"))


def with_macro(per_question: DataFrame, question: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds a MACRO row per key, the mean over questions, where there are two or more; not a pooled figure."""
    macro = per_question.groupBy(*keys).agg(F.count_distinct(question).alias("__n"), *[F.avg(v).alias(v) for v in values]).where("__n >= 2")
    return per_question.select(*keys, question, *values).unionByName(macro.select(*keys, F.lit("MACRO").alias(question), *values))


def mid_rank(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """Average rank of ties: ranks are found on value counts and joined back."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranks = running_sums(counts, value, ["__c"], keys).select(*keys, value, (F.col("before___c") + (F.col("__c") + 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value], "left")


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    ranked = mid_rank(mid_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, keys, "__ra"), b, keys, "__rb")
    return ranked.groupBy(*keys).agg(F.corr("__ra", "__rb").alias("spearman"))


def ks_distance(df: DataFrame, value: str, side: str, keys: Sequence[str]) -> DataFrame:
    """Largest gap between the two sides' empirical distributions (side: a boolean column)."""
    per = df.groupBy(*keys, value).agg(F.count_if(F.col(side)).alias("x"), F.count_if(~F.col(side)).alias("y"))
    cum = running_sums(per, value, ["x", "y"], keys, totals=True)
    upto = lambda c: ratio(F.col(f"before_{c}") + F.col(c), F.col(f"total_{c}"))
    return cum.select(*keys, F.abs(upto("x") - upto("y")).alias("g")).groupBy(*keys).agg(F.max("g").alias("ks"))


def best_threshold(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, balanced_accuracy): the best midpoint between neighbouring scores; ties go nearest to 0.5, then lowest."""
    per = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    cum = running_sums(per, score, ["p", "n"], keys, following="next", totals=True).where("next IS NOT NULL").withColumnsRenamed({"total_p": "pt", "total_n": "nt"})
    c = cum.select(*keys, ((F.col(score) + F.col("next")) / 2).alias("threshold"), (F.col("before_p") + F.col("p")).alias("pb"), (F.col("before_n") + F.col("n")).alias("nb"), "pt", "nt")
    ba = (ratio(F.col("pt") - F.col("pb"), F.col("pt")) + ratio(F.col("nb"), F.col("nt"))) / 2
    ranked = c.withColumn("ba", F.round(ba, 12)).where("ba IS NOT NULL")
    key = F.struct("ba", -F.round(F.abs(F.col("threshold") - 0.5), 12), -F.col("threshold"))
    return ranked.groupBy(*keys).agg(F.max_by("threshold", key).alias("threshold"), F.max("ba").alias("balanced_accuracy"))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def observed_expected(p: Column, y: Column) -> Column:
    return ratio(F.sum(y), F.sum(p))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def right_side_of_rate(p: Column, rate: Column, y: Column) -> Column:
    """(p >= base rate) agrees with the truth; a missing answer is wrong."""
    return F.coalesce((p >= rate).cast("int") == y, F.lit(False))


def ten_bins(p: Column) -> Column:
    return F.least(F.floor(p * 10), F.lit(9)).cast("bigint")


def quantile_bands(df: DataFrame, value: str, fit: Column, cuts: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Adds band 0..len(cuts): edges are exact quantiles of the rows where `fit` holds; equal to an edge is above it."""
    edges = exact_quantiles(df.where(fit), value, cuts, name="__edges")  # one row
    return df.crossJoin(F.broadcast(edges)).withColumn("band", F.size(F.filter("__edges", lambda e: e <= F.col(value))).cast("bigint")).drop("__edges")


def calibration_slope(df: DataFrame, label: str, p: str, keys: Sequence[str], eps: float = 1e-6, rounds: int = 12) -> DataFrame:
    """(keys, slope, n): slope of a logistic regression of the label on logit(p) by Newton's method; null where it is not
    identified (one class, one value, a flat or runaway fit) or has not settled.

    Rows are summed per distinct logit (to 9 digits: a slope moves by less than 1e-7); a round is one aggregate of five
    sums per key. Fixed values: the limits for a flat (1e-12) and a runaway (1e6) fit."""
    per = df.groupBy(*keys, F.round(logit(F.col(p), eps), 9).alias("x")).agg(F.sum(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
    per = written(per, "calibration")
    zero = F.when((F.min("x") < F.max("x")) & (F.sum("y") > 0) & (F.sum("y") < F.sum("n")), F.lit(0.0))
    whole = per.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("total"), zero.alias("a"), zero.alias("b"), F.lit(1.0).alias("moved"))
    moving, settled, steps = whole, [], []
    for i in range(rounds):
        now = per.join(moving.select(*keys, "a", "b"), list(keys)) if keys else per.crossJoin(F.broadcast(moving.select("a", "b")))  # one row
        m = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        w, g, x = F.col("n") * m * (1 - m), F.col("y") - F.col("n") * m, F.col("x")
        sums = now.groupBy(*keys, "a", "b").agg(F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"), F.sum(g).alias("g0"), F.sum(g * x).alias("g1"))
        det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        sound = (det > 1e-12) & (F.abs("b") <= 1e6)
        da, db = (F.col("s2") * F.col("g0") - F.col("s1") * F.col("g1")) / det, (F.col("s0") * F.col("g1") - F.col("s1") * F.col("g0")) / det
        moving = sums.select(*keys, F.when(sound, F.col("a") + da).alias("a"), F.when(sound, F.col("b") + db).alias("b"), F.when(sound, F.greatest(F.abs(da), F.abs(db))).alias("moved"))
        if i % 4 == 3 or i == rounds - 1:  # every few rounds the keys that have settled leave, and with the last one it ends
            step = written(moving, "calibration-step")
            settled.append(step.where("moved < 1e-8").select(*keys, F.col("b").alias("slope")))
            moving = step.where("moved >= 1e-8")
            if moving.isEmpty():
                break
    last = settled[0]
    for more in settled[1:]:
        last = last.unionByName(more)
    if keys:
        return whole.select(*keys, "total").join(last, list(keys), "left").select(*keys, "slope", F.col("total").alias("n"))
    return whole.select("total").crossJoin(F.broadcast(last.agg(F.max("slope").alias("slope")))).select("slope", F.col("total").alias("n"))  # one row


def majority(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The most frequent value; ties go to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("c"), F.col(value))).alias("majority"), F.max("c").alias("n_majority"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_values"))


def best_variant(valid: DataFrame, test: DataFrame, variant: str, value: str) -> DataFrame:
    """Test figures of every variant, with the one that is best on validation marked (ties: first name)."""
    best = valid.agg(F.min_by(variant, F.struct(-F.col(value), F.col(variant))).alias("__best"))
    return test.crossJoin(F.broadcast(best)).withColumn("chosen", F.col(variant) == F.col("__best")).drop("__best")


def top_two(shares: Column, codes: Column) -> Column:
    """Codes of the two largest shares; equal shares in listed order."""
    ranked = F.array_sort(F.transform(F.arrays_zip(shares.alias("p"), codes.alias("c")), lambda z, i: F.struct((-z["p"]).alias("q"), i.alias("i"), z["c"].alias("c"))))
    return F.slice(F.transform(ranked, lambda z: z["c"]), 1, 2)


def tiered_cost(prompt: Column, output: Column, thinking: Column, cached: Column, cap: int, rates: tuple[float, float], long_rates: tuple[float, float]) -> Column:
    """Whole request at the long rate above the cap; thinking is output; cached tokens cost a third; missing counts 0."""
    z = lambda c: F.coalesce(F.when(~F.isnan(c.cast("double")), c), F.lit(0))
    p, o, t, c = z(prompt), z(output), z(thinking), z(cached)
    at = lambda r: ((p - c) + c / 3.0) * r[0] + (o + t) * r[1]
    return F.when(p > cap, at(long_rates)).otherwise(at(rates)) / 1e6


def curve_counts(curves: DataFrame, curve: str, tolerance: float = 0.05) -> DataFrame:
    """(n, distinct, near_average): curves that differ from the mean curve by at most the tolerance everywhere."""
    size = F.size(curve)
    point = lambda i: F.avg(F.get(curve, F.lit(i)))
    longest = curves.agg(F.max(size)).first()[0] or 0
    mean = curves.agg(F.array(*[point(i) for i in range(longest)]).alias("__mean")) if longest else None  # one row
    if mean is None:
        return curves.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("near_average"), F.count_distinct(curve).alias("distinct"))
    far = F.array_max(F.zip_with(F.col(curve), F.slice("__mean", F.lit(1), size), lambda a, b: F.abs(a - b)))
    return curves.crossJoin(F.broadcast(mean)).agg(F.count(F.lit(1)).alias("n"), F.count_if(far <= tolerance).alias("near_average"), F.count_distinct(curve).alias("distinct"))


def option_scores(df: DataFrame, label: str, shares: str, codes: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auroc, balanced_accuracy, top_two) of answers that share 1 out over codes (an array in their order, null
    where unreadable): mean one-versus-rest AUROC over codes with both classes, on readable rows; the top pick's balanced
    accuracy and the share with the truth among the top two, where an unreadable answer is wrong."""
    listed = F.array(*[F.lit(c).cast("bigint") for c in codes])
    rows = df.select(*keys, F.col(label).cast("bigint").alias("__y"), F.col(shares).alias("__p"), top_two(F.col(shares), listed).alias("__top"))
    long = rows.where("__p IS NOT NULL").select(*keys, "__y", F.posexplode("__p").alias("__i", "__s")).withColumn("__c", F.get(listed, F.col("__i")))
    per = auroc(long, (F.col("__y") == F.col("__c")).cast("int"), F.col("__s"), [*keys, "__c"])
    picks = forced_answer(rows.withColumn("__pick", F.get("__top", F.lit(0))), "__y", "__pick", keys)
    two = rows.groupBy(*keys).agg(F.avg(F.coalesce(F.array_contains("__top", F.col("__y")), F.lit(False)).cast("int")).alias("top_two"))
    parts = [per.groupBy(*keys).agg(F.avg("auroc").alias("auroc")), picks.select(*keys, "balanced_accuracy"), two]
    return parts[0].join(parts[1], list(keys)).join(parts[2], list(keys)) if keys else parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def horizon_conflicts(df: DataFrame, near: Column, far: Column, near_yes: Column, far_yes: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Answers that contradict themselves, since what happens within the near horizon happens within the far one:
    (keys, n, near_above_far, yes_then_no); a missing answer contradicts nothing."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(near > far).alias("near_above_far"), F.count_if(near_yes & ~far_yes).alias("yes_then_no"))


def cost_forecast(seen: DataFrame, eligible: DataFrame, task: str, arm: str, cost: str, rows: str) -> DataFrame:
    """(task, arm, rows, rate, forecast): mean cost a row of the task and arm, of the arm where the task was not run, times
    the rows that are eligible."""
    by_task = seen.groupBy(task, arm).agg(F.avg(cost).alias("__own"))
    by_arm = seen.groupBy(arm).agg(F.avg(cost).alias("__arm"))
    told = eligible.join(by_task, [task, arm], "left").join(by_arm, [arm], "left").withColumn("rate", F.coalesce("__own", "__arm"))
    return told.select(task, arm, rows, "rate", (F.col("rate") * F.col(rows)).alias("forecast"))


def least_squares(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = (), ridge: float = 0.0) -> DataFrame:
    """(keys, intercept, coefficients): the normal equations are sums, one row a key, solved in plain arithmetic per row.
    Null where they are singular; rows with a null are left out."""
    names = ["1", *features]
    x = {n: F.lit(1.0) if n == "1" else F.col(n).cast("double") for n in names}
    sums = [F.sum(x[a] * x[b]).alias(f"__m{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    right = [F.sum(x[a] * F.col(target).cast("double")).alias(f"__r{i}") for i, a in enumerate(names)]
    row = df.dropna(subset=[target, *features]).groupBy(*keys).agg(*sums, *right)
    size = len(names)
    cell = lambda i, j: F.col(f"__m{min(i, j)}_{max(i, j)}") + F.lit(ridge if i == j and i else 0.0)
    return _solved(row, [[cell(i, j) for j in range(size)] + [F.col(f"__r{i}")] for i in range(size)], keys).select(*keys, F.get("beta", F.lit(0)).alias("intercept"), F.slice("beta", 2, size).alias("coefficients"))


def _solved(row: DataFrame, system: list[list[Column]], keys: Sequence[str]) -> DataFrame:
    """(keys, beta) of one linear system a row, by elimination without pivoting (a normal matrix needs none)."""
    size = len(system)
    now = row.select(*keys, *[c.alias(f"__{i}_{j}") for i, line in enumerate(system) for j, c in enumerate(line)])
    at = lambda i, j: F.col(f"__{i}_{j}")
    for k in range(size):
        pivot = F.when(F.abs(at(k, k)) > 1e-12, at(k, k))
        now = now.withColumns({f"__{k}_{j}": at(k, j) / pivot for j in range(size, k - 1, -1)})
        now = now.withColumns({f"__{i}_{j}": at(i, j) - at(i, k) * at(k, j) for i in range(size) if i != k for j in range(k, size + 1)})
    values = [at(i, size) for i in range(size)]
    sound = values[0].isNotNull()
    for v in values[1:]:
        sound = sound & v.isNotNull()
    return now.select(*keys, F.when(sound, F.array(*values)).alias("beta"))


def standardised(df: DataFrame, features: Sequence[str], fit: Column) -> tuple[DataFrame, list[str]]:
    """Features with missing ones filled by the mean of the rows where `fit` holds, a missing mark beside each, all scaled
    to mean 0 and deviation 1 over those rows (a constant stays 0). Returns the table and the new columns' names."""
    own = lambda c: F.when(fit, F.col(c).cast("double"))
    means = df.agg(*[F.avg(own(f)).alias(f"__mean_{f}") for f in features])  # one row
    filled = df.crossJoin(F.broadcast(means))
    names = [n for f in features for n in (f"z_{f}", f"z_{f}_missing")]
    filled = filled.withColumns({n: v for f in features for n, v in ((f"z_{f}", F.coalesce(F.col(f).cast("double"), F.col(f"__mean_{f}"), F.lit(0.0))), (f"z_{f}_missing", F.col(f).isNull().cast("double")))})
    spread = filled.agg(*[a.alias(x) for n in names for a, x in ((F.avg(F.when(fit, F.col(n))), f"__m_{n}"), (F.stddev_pop(F.when(fit, F.col(n))), f"__s_{n}"))])  # one row
    out = filled.crossJoin(F.broadcast(spread))
    scaled = {n: F.coalesce((F.col(n) - F.col(f"__m_{n}")) / F.nullif(F.col(f"__s_{n}"), F.lit(0.0)), F.lit(0.0)) for n in names}
    return out.withColumns(scaled).select(*df.columns, *names), names


def logistic_blend(df: DataFrame, target: str, features: Sequence[str], fit: Column, ridge: float = 1.0, rounds: int = 8) -> DataFrame:
    """df with `blend`, the probability of a ridge-penalised logistic regression (the intercept is not penalised) of the
    standardised features, fitted by Newton's method on the rows where `fit` holds: a round is one aggregate to one row
    of sums."""
    rows, names = standardised(df.withColumn("__fit", F.coalesce(fit, F.lit(False))), features, F.col("__fit"))
    rows = written(rows, "blend")
    train = rows.where("__fit")
    size = len(names) + 1
    beta: list[float] = [0.0] * size
    x = [F.lit(1.0), *[F.col(n) for n in names]]

    def linear(b: list[float]) -> Column:
        return sum((xi * F.lit(bi) for xi, bi in zip(x, b)), F.lit(0.0))

    for _ in range(rounds):
        import numpy as np

        m = 1 / (1 + F.exp(-linear(beta)))
        marked = train.withColumns({"__m": m}).withColumns({"__w": F.col("__m") * (1 - F.col("__m")), "__g": F.col(target).cast("double") - F.col("__m")})
        aggs = [F.sum(F.col("__w") * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(size) for j in range(i, size)] + [F.sum(F.col("__g") * x[i]).alias(f"g{i}") for i in range(size)]
        found = marked.agg(*aggs).first()  # one row of sums
        if found["g0"] is None:
            break
        h = np.array([[found[f"h{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]) + np.diag([0.0] + [ridge] * (size - 1))
        g = np.array([found[f"g{i}"] for i in range(size)]) - ridge * np.array([0.0, *beta[1:]])
        beta = (np.array(beta) + np.linalg.lstsq(h, g, rcond=None)[0]).tolist()
    return rows.select(*df.columns, (1 / (1 + F.exp(-linear(beta)))).alias("blend"))
