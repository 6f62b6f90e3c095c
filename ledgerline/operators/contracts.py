"""Data contracts, diffs and completeness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.running import exact_quantiles


class ContractError(ValueError):
    """A table breaks a rule it must keep."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if found := duplicate_keys(df, keys).take(3):
        raise ContractError(f"{list(keys)} repeats, e.g. {[tuple(r)[:-1] for r in found]}")
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"missing columns {missing}")
    return df


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule; one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n")


def require_layout(df: DataFrame, columns: Sequence[str], keys: Sequence[str], run: str, probability: str, answer: str) -> DataFrame:
    """Columns, one run, a probability in [0, 1] or an answer in every row, unique keys."""
    require_columns(df, columns)
    p = F.col(probability)
    row = df.agg(F.count_distinct(run).alias("runs"), F.count_if(p.isNull() & F.col(answer).isNull()).alias("empty"), F.count_if((p < 0) | (p > 1)).alias("out_of_range")).first()
    if row.runs > 1 or row["empty"] or row.out_of_range:
        raise ContractError(f"layout: {row.runs} runs, {row['empty']} rows without answer, {row.out_of_range} probabilities out of range")
    return require_unique(df, keys)


def inconsistent(df: DataFrame, entity: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Entities with more than one value (null counts as none) in any of the columns."""
    counts = [F.count_distinct(c).alias(c) for c in columns]
    return df.groupBy(*entity).agg(*counts).where(" OR ".join(f"`{c}` > 1" for c in columns))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; disjoint samples have none."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def reconciled(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after) where the row counts differ."""
    a, b = before.groupBy(key).agg(F.count(F.lit(1)).alias("before")), after.groupBy(key).agg(F.count(F.lit(1)).alias("after"))
    return a.join(b, key, "full_outer").fillna(0, ["before", "after"]).where("before <> after")


def run_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """Key by key: side (only_a, only_b, both) and a flag per field; texts are compared without line-end blanks."""
    from ledgerline.functions.text import trim_line_ends

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"in_{s}"), *[(trim_line_ends(F.col(f)) if f in texts else F.col(f)).alias(f"{s}_{f}") for f in fields])

    joined = side(a, "a").join(side(b, "b"), list(keys), "full_outer")
    where = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("both")
    return joined.select(*keys, where.alias("side"), *[((where == "both") & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f"diff_{f}") for f in fields])


def completeness(expected: DataFrame, rows: DataFrame, keys: Sequence[str], parsed: str) -> DataFrame:
    """(expected, present, parsed) over the expected keys."""
    got = rows.groupBy(*keys).agg(F.bool_or(F.col(parsed).isNotNull()).alias("__parsed"), F.lit(True).alias("__there"))
    return expected.join(got, list(keys), "left").agg(F.count(F.lit(1)).alias("expected"), F.count("__there").alias("present"), F.count_if(F.col("__parsed")).alias("parsed"))


def frequent_errors(rows: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent error texts (a report: the limit is its purpose)."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def cited_evidence(reasons: DataFrame, records: DataFrame, allowed: Sequence[str], cutoff: Column) -> DataFrame:
    """Per reason (record, file, date): allowed, in_time and found in the records."""
    known = records.select("record", "date").distinct().withColumn("__known", F.lit(True))
    return reasons.join(known, ["record", "date"], "left").select(*reasons.columns, F.col("file").isin(*allowed).alias("allowed"), (F.col("date") <= cutoff).alias("in_time"), F.col("__known").isNotNull().alias("found"))


def input_qa(rows: DataFrame, arm: str, header: str, after: str, kept: str, images: str, expected: str, gap: str) -> DataFrame:
    """What each arm's inputs hold: rows, rows with a header, with events after the prediction, with a report that had to
    go, with another number of images than expected; median, 90th percentile and maximum of the days since the newest
    record; and how many rows break a rule."""
    broken = (F.col(after) > 0) | ~F.col(header) | F.col(kept) | ~F.col(images).eqNullSafe(F.col(expected))
    counts = rows.groupBy(arm).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(header).alias("with_header"), F.count_if(F.col(after) > 0).alias("with_later_events"), F.count_if(kept).alias("with_report"),
        F.count_if(~F.col(images).eqNullSafe(F.col(expected))).alias("wrong_images"), F.count_if(F.coalesce(broken, F.lit(True))).alias("broken"),
    )
    gaps = exact_quantiles(rows, gap, [0.5, 0.9, 1.0], [arm], "__gap")
    at = [F.get("__gap", F.lit(i)).alias(n) for i, n in enumerate(("gap_median", "gap_p90", "gap_max"))]
    return counts.join(gaps, arm, "left").select(*counts.columns, *at)


def record_qa(rows: DataFrame, arm: str, header: str, header_text: str, in_record: str, in_window: str, signed_later: str, removed: str, trimmed: str, after: str, without_reports: Sequence[str] = (), unknown: str = "unknown") -> DataFrame:
    """What each arm's record inputs hold: rows; with a header, and of those with age and with sex known; with the report in
    the record, in the window, signed after the prediction's day, and removed; trimmed; events after the prediction in all;
    and the rows that break a rule: an event after the prediction, no header, or a report in the window that was kept, but
    for the arms that show no reports. header_text: the header, `Age: .. Sex: ..`, where either part may be unknown."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    known = lambda part: yes(header) & (F.regexp_extract(F.lower(F.coalesce(header_text, F.lit(""))), rf"{part}:\s*(\w+)", 1) != unknown) & F.lower(F.coalesce(header_text, F.lit(""))).contains(f"{part}:")
    broken = (F.col(after) > 0) | ~yes(header) | (yes(in_window) & ~yes(removed) & ~F.coalesce(F.col(arm).isin(*without_reports), F.lit(False)))
    return rows.groupBy(arm).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yes(header)).alias("with_header"), F.count_if(known("age")).alias("age_known"), F.count_if(known("sex")).alias("sex_known"),
        F.count_if(yes(in_record)).alias("report_in_record"), F.count_if(yes(in_window)).alias("report_in_window"), F.count_if(yes(in_window) & yes(signed_later)).alias("report_signed_later"), F.count_if(yes(removed)).alias("report_removed"),
        F.count_if(yes(trimmed)).alias("trimmed"), F.coalesce(F.sum(after), F.lit(0)).cast("bigint").alias("events_after"), F.count_if(F.coalesce(broken, F.lit(True))).alias("broken"),
    )


def image_qa(rows: DataFrame, arm: str, images: str, expected: str, error: str, spreads: str, has_prior: str, gap: str, blank: float = 2.0) -> DataFrame:
    """What each arm's image inputs hold: cases; with as many images as expected; load errors; with a slice that is nearly blank
    (its values spread by less than `blank`; spreads: an array, one a slice) and the median number of those a case; with a
    prior, with an earlier one, and the median days to it; and the cases that break a rule: another number of images
    although all loaded, or a prior that is not earlier."""
    prior = F.coalesce(F.col(has_prior), F.lit(False))
    own = rows.withColumns({"__blank": F.size(F.filter(F.coalesce(F.col(spreads), F.array().cast("array<double>")), lambda s: s < blank)), "__gap": F.when(prior, F.col(gap))})
    right, earlier = F.col(images).eqNullSafe(F.col(expected)), F.coalesce(F.col("__gap") > 0, F.lit(False))
    counts = own.groupBy(arm).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(right).alias("as_expected"), F.count(error).alias("load_errors"), F.count_if(F.col("__blank") > 0).alias("with_blank"),
        F.count_if(prior).alias("with_prior"), F.count_if(prior & earlier).alias("prior_earlier"), F.count_if((~right & F.col(error).isNull()) | (prior & ~earlier)).alias("broken"),
    )
    median = lambda c, name: exact_quantiles(own, c, [0.5], [arm], "__q").select(arm, F.get("__q", F.lit(0)).alias(name))
    return counts.join(median("__blank", "blank_median"), arm, "left").join(median("__gap", "gap_median"), arm, "left")


def agrees(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of a re-read table that differ from their source by more than the tolerance, or are on one side only."""
    j = a.select(*keys, *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(1).alias("__ina")).join(b.select(*keys, *[F.col(v).alias(f"__b_{v}") for v in values], F.lit(1).alias("__inb")), list(keys), "full_outer")
    off = F.col("__ina").isNull() | F.col("__inb").isNull()
    for v in values:
        x, y = F.col(f"__a_{v}"), F.col(f"__b_{v}")
        off = off | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    return j.where(off)
