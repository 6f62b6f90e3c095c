"""Event timelines: order, rendering, budgets over lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import age_at
from ledgerline.functions.text import demographics
from ledgerline.operators.running import RANGE_ROWS, carried_last


def ordered_text(df: DataFrame, keys: Sequence[str], order: Sequence[Column], line: Column, name: str, separator: str = "\n") -> DataFrame:
    """Lines of each group in order, as one text; null lines are left out."""
    return df.groupBy(*keys).agg(lines_in_order(order, line, separator).alias(name))


def lines_in_order(order: Sequence[Column], line: Column, separator: str = "\n") -> Column:
    """The aggregate of ordered_text, to stand beside others. Nulls of the order come first."""
    rows = F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), separator)


def newest_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], line: str, most: int) -> DataFrame:
    """The newest whole lines whose lengths (and line breaks) stay within the budget; an older short line does not come back.

    order is newest first. A newest line that is over the budget alone is kept, cut to it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length(line) + 1).over(w)  # grows with every line, so what fits is a prefix
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    marked = df.withColumn("used", used.cast("bigint")).withColumn("__first", first)
    return marked.where((F.col("used") <= most) | F.col("__first")).withColumn(line, F.when(F.col("used") > most, F.substring(line, 1, most)).otherwise(F.col(line))).drop("__first")


def last_dates(df: DataFrame, keys: Sequence[str], date: Column, k: int) -> DataFrame:
    """Rows of the k newest distinct dates."""
    w = Window.partitionBy(*keys).orderBy(F.desc("__date"))
    return df.withColumn("__date", date).withColumn("date_rank", F.dense_rank().over(w).cast("bigint")).where(F.col("date_rank") <= k).drop("__date")


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """The last non-null value so far; a key's rows are spread over ranges of the first order column."""
    return carried_last(df, keys, order, value, name, rows_each)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """First (or last) row per key in the given order; an aggregate over a struct, which combines before the shuffle."""
    pick = F.max_by if last else F.min_by
    row = df.groupBy(*keys).agg(pick(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("__row"))
    return row.select(*keys, "__row.*").select(*df.columns)


def demographics_of(events: DataFrame, keys: Sequence[str], code: str, time: str, order: Sequence[Column], as_of: Column, sexes: dict[str, str]) -> DataFrame:
    """(keys, header): age and sex from the pseudo-events of birth and gender, the first of each; unknown where there is none."""
    first = lambda keep, value: F.min_by(F.when(keep, value), F.when(keep, F.struct(*order)))
    is_sex = F.col(code).startswith("Gender/")
    row = events.groupBy(*keys).agg(first(F.col(code) == "MEDS_BIRTH", F.col(time)).alias("__birth"), first(is_sex, F.substring_index(F.col(code), "/", -1)).alias("__sex"), F.max(as_of).alias("__at"))
    words = F.element_at(F.create_map(*[F.lit(x) for kv in sexes.items() for x in kv]), F.col("__sex"))
    return row.select(*keys, demographics(age_at(F.col("__birth"), F.col("__at")), words).alias("header"))


def distinct_events(df: DataFrame, keys: Sequence[str], event_id: str, time: str, line: Column) -> DataFrame:
    """Retrieved events without repeats and without null ids, unknown times first."""
    one = df.where(F.col(event_id).isNotNull()).dropDuplicates([*keys, event_id])
    return ordered_text(one, keys, [F.coalesce(F.col(time).cast("string"), F.lit("")), F.col(event_id)], line, "patient_string")
