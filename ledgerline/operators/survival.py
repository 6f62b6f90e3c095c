"""Survival analytics: product-limit curves, step lookups, C-index, censoring-weighted scores.

Curves are computed on distinct times (rows are summed per time first), per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.running import RANGE_ROWS, carried_product, cuts_of, exact_quantiles, running_sums
from ledgerline.shipping import ship
from ledgerline.storage import written


def _per_time(df: DataFrame, keys: Sequence[str], time: str, event: str, rows_each: int) -> DataFrame:
    per = df.groupBy(*keys, time).agg(F.count_if(F.col(event)).alias("d"), F.count_if(~F.col(event)).alias("c"))
    cum = running_sums(per.withColumn("__m", F.col("d") + F.col("c")), time, ["__m"], keys, rows_each, totals=True)
    return cum.withColumn("at_risk", F.col("total___m") - F.col("before___m")).select(*keys, time, "d", "c", "at_risk")


def kaplan_meier(df: DataFrame, keys: Sequence[str], time: str, event: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """(keys, time, d, c, at_risk, survival just after each distinct time)."""
    return carried_product(_per_time(df, keys, time, event, rows_each), keys, [F.col(time)], 1 - F.col("d") / F.col("at_risk"), "survival", rows_each)


def censoring(df: DataFrame, keys: Sequence[str], time: str, event: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """Reverse curve G: at a tie deaths leave the risk set before the censorings are counted; without any censoring G is 1."""
    factor = F.when(F.col("c") > 0, 1 - F.col("c") / (F.col("at_risk") - F.col("d"))).otherwise(1.0)
    return carried_product(_per_time(df, keys, time, event, rows_each), keys, [F.col(time)], factor, "g", rows_each)


def step_at(points: DataFrame, curve: DataFrame, keys: Sequence[str], at: str, x: str, y: str, name: str, before: float = 1.0) -> DataFrame:
    """Value of the last x <= at of a right-continuous curve; `before` ahead of its start.

    It is looked up once for each distinct time of a key and joined back, so a window holds times, not rows."""
    from ledgerline.operators.joins import latest_at_or_before

    k = F.struct(*keys) if keys else F.lit(1)
    left = points.select(*keys, at).distinct().withColumn("__key", k)
    right = curve.select(k.alias("__key"), F.col(x).cast(points.schema[at].dataType).alias("__x"), F.col(y).alias("__y"), F.lit(0).alias("__o"))
    found = latest_at_or_before(left, right, "__key", at, "__x", "__y", "__o", name).drop("__key")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*keys, at]]
    out = points.alias("p").join(found.alias("f"), same, "left")
    return out.select(*[F.col(f"p.{c}") for c in points.columns], F.coalesce(F.col(f"f.{name}"), F.lit(before)).alias(name))


def trapezoid(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, area, span)."""
    w = Window.partitionBy(*keys).orderBy(x)
    part = (F.lead(x).over(w) - F.col(x)) * (F.col(y) + F.lead(y).over(w)) / 2
    return df.select(*keys, F.col(x).alias("__x"), part.alias("__a")).groupBy(*keys).agg(F.sum("__a").alias("area"), (F.max("__x") - F.min("__x")).alias("span"))


def monotone(curve: Column) -> Column:
    """Running minimum of a survival curve."""
    step = lambda acc, v: F.concat(acc, F.array(F.least(v, F.coalesce(F.element_at(acc, -1), v))))
    return F.aggregate(curve, F.array().cast("array<double>"), lambda acc, v: F.when(F.size(acc) == 0, F.array(v)).otherwise(step(acc, v)))


def is_monotone(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Whether x strictly increases in the order the points were given (pos)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return df.select(*keys, (F.lag(x).over(w) < F.col(x)).alias("up")).groupBy(*keys).agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("increasing"))


def dominated(t, dead, risk, n, alone=None) -> tuple[float, float]:
    """(won, pairs) over cells: pairs of a death and a cell that outlives it (a later time, or a censoring at the same
    time); won where the death's risk is higher, half where it is equal. Times are halved again and again: deaths of the
    earlier half meet the later half's risks in one sorted lookup. alone: cells whose own time does not count (by cell)."""
    import numpy as np

    def met(d: np.ndarray, o: np.ndarray) -> tuple[float, float]:
        if not len(d) or not len(o):
            return 0.0, 0.0
        order = np.argsort(risk[o], kind="stable")
        r, upto = risk[o][order], np.concatenate([[0.0], np.cumsum(n[o][order])])
        below, same = upto[np.searchsorted(r, risk[d], "left")], upto[np.searchsorted(r, risk[d], "right")]
        return float((n[d] * (below + same) / 2).sum()), float(n[d].sum() * upto[-1])

    won = pairs = 0.0
    order = np.argsort(t, kind="stable")
    starts = np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(t[order]) != 0])), [len(order)]]) if len(order) else np.zeros(1, int)
    stack = [(0, len(starts) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 1:
            continue
        if b - a == 1:
            own = order[starts[a] : starts[b]]
            own = own if alone is None else own[~alone[own]]
            w, p = met(own[dead[own]], own[~dead[own]])
        else:
            mid = (a + b) // 2
            early, late = order[starts[a] : starts[mid]], order[starts[mid] : starts[b]]
            w, p = met(early[dead[early]], late)
            stack += [(a, mid), (mid, b)]
        won, pairs = won + w, pairs + p
    return won, pairs


def grid_pairs(i, j, dead, lost, tied_time, tied_risk) -> tuple[float, float]:
    """(won, pairs) between whole cells of a grid of time ranges i and risk ranges j (one row a cell; dead, lost: deaths and
    censorings in it): pairs in different risk ranges, or in one of a single risk, that lie in different time ranges, or
    in one of a single time."""
    import numpy as np

    rows, cols = int(i.max(initial=-1)) + 1, int(j.max(initial=-1)) + 1
    d, c = np.zeros((rows, cols)), np.zeros((rows, cols))
    d[i, j], c[i, j] = dead, lost
    point_i, point_j = np.zeros(rows, bool), np.zeros(cols, bool)
    point_i[i[tied_time]], point_j[j[tied_risk]] = True, True
    every = d + c
    outlive = np.cumsum(every[::-1], axis=0)[::-1] - every + c * point_i[:, None]
    below = np.cumsum(outlive, axis=1) - outlive
    same = outlive * point_j
    others = outlive.sum(axis=1, keepdims=True) - outlive
    return float((d * (below + same / 2)).sum()), float((d * (others + same)).sum())


def c_index(df: DataFrame, keys: Sequence[str], time: str, event: str, risk: str, digits: int = 8, rows_each: int = 200_000) -> DataFrame:
    """Harrell's C: pairs whose earlier time is a death (a death and a censoring at one time count too); equal risks half.

    Rows are summed per (time, event, risk to `digits` digits: risks that near are equal), and times and risks are cut into
    ranges of about rows_each such rows; a time or a risk that fills a range is one by itself. A pair is counted
    once, in one of three places: within a range of several times by lookups in that range; within a range of several
    risks, for times of different ranges, by lookups in that range; all others from the counts of the grid of ranges,
    at most MOST_RANGES squared a key. So no task holds more rows than a range, nor pairs any."""
    import pyarrow as pa

    cells = df.groupBy(*keys, F.col(time).cast("double").alias("t"), F.col(event).alias("e"), F.round(F.col(risk), digits).cast("double").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells, "c-index")
    at, of = cuts_of(cells, "t", "r", rows_each=rows_each)
    cells = cells.select("*", at.number(F.col("t")).alias("i"), of.number(F.col("r")).alias("j"), at.is_point(F.col("t")).alias("pi"), of.is_point(F.col("r")).alias("pj"))
    ship(df.sparkSession)
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["won double", "pairs double"])

    def counted(count):
        def run(key, table):
            columns = {c: table[c].to_numpy() for c in table.column_names if c not in keys}
            won, pairs = count(**columns)
            return pa.table({**{k: pa.array([v.as_py()], table.schema.field(k).type) for k, v in zip(keys, key)}, "won": pa.array([won]), "pairs": pa.array([pairs])})

        return run

    by_time = cells.where("NOT pi").groupBy(*keys, "i").applyInArrow(counted(lambda t, e, r, n, i, **_: dominated(t, e.astype(bool), r, n.astype(float))), schema)
    parts = [by_time]
    if at.edges:
        by_risk = cells.where("NOT pj").groupBy(*keys, "j").applyInArrow(counted(lambda e, r, n, i, pi, **_: dominated(i, e.astype(bool), r, n.astype(float), ~pi.astype(bool))), schema)
        grid = cells.groupBy(*keys, "i", "j").agg(F.sum(F.when(F.col("e"), F.col("n")).otherwise(0)).alias("dead"), F.sum(F.when(F.col("e"), 0).otherwise(F.col("n"))).alias("lost"), F.bool_or("pi").alias("pi"), F.bool_or("pj").alias("pj"))
        whole = grid.groupBy(*keys).applyInArrow(counted(lambda i, j, dead, lost, pi, pj: grid_pairs(i, j, dead, lost, pi.astype(bool), pj.astype(bool))), schema)
        parts += [by_risk, whole]
    per = parts[0]
    for p in parts[1:]:
        per = per.unionByName(p)
    return per.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("pairs")).alias("c_index"), F.sum("pairs").alias("pairs"))


def integrated_brier(per_time: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, integrated_brier): trapezoid area over the span; null where there is one time."""
    area = trapezoid(per_time, keys, x, y)
    return area.select(*keys, F.try_divide("area", "span").alias("integrated_brier"))


def weighted_brier(df: DataFrame, keys: Sequence[str], time: str, event: str, surv: str, t: str, g_own: str, g_t: str) -> DataFrame:
    """Censoring-weighted Brier at t: deaths by t weigh S^2 / G(own time), those past t (1 - S)^2 / G(t); G = 0 counts as infinite."""
    inf = lambda g: F.nullif(F.col(g), F.lit(0.0))
    s = F.col(surv)
    part = F.when((F.col(time) <= F.col(t)) & F.col(event), s * s / inf(g_own)).when(F.col(time) > F.col(t), (1 - s) * (1 - s) / inf(g_t)).otherwise(0.0)
    return df.groupBy(*keys).agg(F.avg(F.coalesce(part, F.lit(0.0))).alias("brier"))


def dynamic_auc(df: DataFrame, keys: Sequence[str], time: str, event: str, risk: str, t: str, g_own: str) -> DataFrame:
    """Deaths by t, weighted 1 / G(own time), against everyone followed past t."""
    from ledgerline.operators.metrics import auroc

    rows = df.where((F.col(time) > F.col(t)) | ((F.col(time) <= F.col(t)) & F.col(event)))
    case = F.col(time) <= F.col(t)
    w = F.when(case, F.coalesce(1 / F.nullif(F.col(g_own), F.lit(0.0)), F.lit(0.0))).otherwise(1.0)
    return auroc(rows, case.cast("int"), F.col(risk), keys, weight=w)


def window_upper(df: DataFrame, time: str, event: str, q: float = 0.9, margin: float = 0.999) -> DataFrame:
    """One row: 0.999 x the earlier of the 90th percentile and the last of the event times."""
    dead = df.where(F.col(event)).select(F.col(time).cast("double").alias("__t"))
    return exact_quantiles(dead, "__t", [q, 1.0], name="__q").select((F.least(F.get("__q", F.lit(0)), F.get("__q", F.lit(1))) * margin).alias("upper"))


