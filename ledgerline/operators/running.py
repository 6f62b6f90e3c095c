"""Running sums, carried values and exact quantiles over an order, without a window that holds all rows of a key.

The order is cut into ranges of about RANGE_ROWS rows each; a window runs inside each (key, range), and what
the ranges before hand on (a sum, a product, a last value: one row a key and range) is combined with it. Where
ranges start comes from approximate quantiles, in one pass with the count; a table of one range is one window.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.storage import written

RANGE_ROWS = 500_000
#: Ranges of an order at most; from there on they grow with the table.
MOST_RANGES = 1024
#: Edges are searched in groups of this many.
STEP = 32


class Cuts(NamedTuple):
    """edges: where ranges start; heavy: values with a range's worth of rows of their own, after which another one starts."""

    edges: list
    heavy: list

    def number(self, value: Column) -> Column:
        return range_number(value, self.edges) + _passed(value, self.heavy)

    def is_point(self, value: Column) -> Column:
        """Is the value's range that value alone?"""
        return value.isin(*self.heavy) if self.heavy else F.lit(False)


def cuts_of(df: DataFrame, *orders: str, rows_each: int = RANGE_ROWS, most: int = MOST_RANGES) -> list[Cuts]:
    """The cuts of each column, in one pass over df."""
    at = F.array(*[F.lit(i / most) for i in range(1, most)])
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(o, at, 10 * most).alias(f"c{i}") for i, o in enumerate(orders)]).first()
    ranges = min(-(-row.n // rows_each), most)
    out = []
    for i in range(len(orders)):
        found = (row[f"c{i}"] or [])[most // ranges - 1 :: most // ranges] if ranges > 1 else []
        heavy = sorted({a for a, b in zip(found, found[1:]) if a == b})
        out.append(Cuts(sorted(set(found)), heavy))
    return out


def range_edges(df: DataFrame, order: str, rows_each: int = RANGE_ROWS) -> list:
    """Where ranges of about rows_each rows start; empty for a table of one range."""
    return cuts_of(df.select(order), order, rows_each=rows_each)[0].edges


def range_number(order: str | Column, edges: Sequence) -> Column:
    """How many edges are at or before the order: among every STEP-th first, then in the group after it."""
    c = F.col(order) if isinstance(order, str) else order
    if not edges:
        return F.lit(0)
    upto = lambda group: F.size(F.filter(group, lambda e: e <= c))
    if len(edges) <= STEP:
        return upto(F.array(*map(F.lit, edges)))
    groups = F.array(*[F.array(*map(F.lit, edges[i : i + STEP])) for i in range(0, len(edges), STEP)])
    group = F.greatest(upto(F.array(*map(F.lit, edges[::STEP]))) - 1, F.lit(0))
    return group * STEP + upto(F.get(groups, group))


def _passed(value: Column, heavy: Sequence) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, heavy)), lambda e: e < value)) if heavy else F.lit(0)


def _keyed(df: DataFrame, keys: Sequence[str], number: Column) -> DataFrame:
    """With __key (one value for all keys, null keys alike) and __range."""
    return df.withColumns({"__key": F.struct(*keys) if keys else F.lit(0), "__range": number})


def _inside():
    return Window.partitionBy("__key", "__range")


def _earlier():
    return Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)


def running_sums(df: DataFrame, order: str, values: Sequence[str], keys: Sequence[str] = (), rows_each: int = RANGE_ROWS, following: str | None = None, totals: bool = False) -> DataFrame:
    """df has one row per keys and `order`; adds before_<value>: the sum over all smaller orders of the same keys. With
    totals also total_<value>, over all orders of the keys; following: a column for the next larger order of the keys."""
    df = written(df, "ordered")
    edges = range_edges(df, order, rows_each)
    parts = _keyed(df, keys, range_number(order, edges))
    inner = _inside().orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, -1)
    own = {f"__i_{v}": F.coalesce(F.sum(v).over(upto), F.lit(0)) for v in values} | ({"__n": F.lead(order).over(inner)} if following else {})
    if not edges:
        whole = {f"total_{v}": F.sum(v).over(_inside()) for v in values} if totals else {}
        out = parts.withColumns(own | whole)
        return out.select(*df.columns, *[F.col(f"__i_{v}").alias(f"before_{v}") for v in values], *whole, *([F.col("__n").alias(following)] if following else []))
    sums = parts.groupBy("__key", "__range").agg(*[F.sum(v).alias(f"__s_{v}") for v in values], F.min(order).alias("__first"))
    later = Window.partitionBy("__key").orderBy("__range")  # one row a range, as in the two below
    sums = sums.select(
        F.col("__key").alias("__of_key"), F.col("__range").alias("__of_range"), F.lead("__first").over(later).alias("__after"),
        *[F.coalesce(F.sum(f"__s_{v}").over(_earlier()), F.lit(0)).alias(f"__b_{v}") for v in values], *[F.sum(f"__s_{v}").over(Window.partitionBy("__key")).alias(f"total_{v}") for v in values],
    )
    out = parts.withColumns(own).join(sums, (F.col("__key") == F.col("__of_key")) & (F.col("__range") == F.col("__of_range")))
    extra = [f"total_{v}" for v in values] * totals + ([F.coalesce("__n", "__after").alias(following)] if following else [])
    return out.select(*df.columns, *[(F.col(f"__i_{v}") + F.col(f"__b_{v}")).alias(f"before_{v}") for v in values], *extra)


def next_order(df: DataFrame, order: str, keys: Sequence[str] = (), name: str = "next", rows_each: int = RANGE_ROWS) -> DataFrame:
    """df has one row per keys and `order`; adds the next larger order of the same keys."""
    return running_sums(df, order, [], keys, rows_each, following=name)


def _scanned(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str, rows_each: int, inside, outside, end, both) -> DataFrame:
    """A segmented scan: `inside` over a (key, range), `end` of one, `outside` over the ends before, `both` to combine."""
    edges = range_edges(df.select(order[0].alias("__o")), "__o", rows_each)
    parts = _keyed(df, keys, range_number(order[0], edges)).withColumn("__value", value)
    within = inside("__value").over(_inside().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if not edges:
        return parts.withColumn(name, within).select(*[c for c in df.columns if c != name], name)
    ends = parts.groupBy("__key", "__range").agg(end(F.col("__value"), F.struct(*order)).alias("__end"))
    ends = ends.select(F.col("__key").alias("__of_key"), F.col("__range").alias("__of_range"), outside("__end").over(_earlier()).alias("__before"))
    out = parts.withColumn("__within", within).join(ends, (F.col("__key") == F.col("__of_key")) & (F.col("__range") == F.col("__of_range")))
    return out.withColumn(name, both(F.col("__within"), F.col("__before"))).select(*[c for c in df.columns if c != name], name)


def carried_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """The last value so far that is not null, in ascending order. Ranges are of the first order column; rows that share its
    value stay together."""
    last = lambda c: F.last(c, ignorenulls=True)
    return _scanned(df, keys, order, value, name, rows_each, last, last, lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)), F.coalesce)


def carried_product(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """The product of all values so far, in ascending order."""
    return _scanned(df, keys, order, value, name, rows_each, F.product, F.product, lambda v, o: F.product(v), lambda a, b: a * F.coalesce(b, F.lit(1.0)))


def exact_quantiles(df: DataFrame, value: str, cuts: Sequence[float], keys: Sequence[str] = (), name: str = "quantiles") -> DataFrame:
    """(keys, quantiles): linear between neighbours, as numpy has it. Rows are counted per value and the ranks found in
    running counts, so no task holds a column's values."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    found = running_sums(per, value, ["__c"], keys, totals=True).withColumnRenamed("total___c", "__n")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before___c") <= rank) & (rank < F.col("before___c") + F.col("__c")), F.col(value).cast("double")))

    ends = []
    for i, q in enumerate(cuts):
        rank = F.lit(q) * (F.col("__n") - 1)
        ends += [at(F.floor(rank)).alias(f"__a{i}"), at(F.ceil(rank)).alias(f"__b{i}")]
    row = found.groupBy(*keys).agg(*ends, F.max("__n").alias("__n"))
    part = lambda i, q: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (F.lit(q) * (F.col("__n") - 1) - F.floor(F.lit(q) * (F.col("__n") - 1)))
    return row.select(*keys, F.array(*[part(i, q) for i, q in enumerate(cuts)]).alias(name))
