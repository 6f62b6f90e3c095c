"""Predicates and row filters: labels, time windows, categories, leaks, budgets, filter chains."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.dates import shifted


def resolve_column(df: DataFrame, token: str, partial: bool = False) -> str | None:
    """The first column whose lower-case name equals (or holds) the token."""
    t = token.lower()
    return next((c for c in df.columns if c.lower() == t or partial and t in c.lower()), None)


def present(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The named columns that exist."""
    return df.select(*[c for c in keep if c in df.columns])


def strict(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """The named columns, or None when one is missing (the next source is then tried)."""
    return df.select(*columns) if set(columns) <= set(df.columns) else None


def first_strict(sources: Sequence[Callable[[], DataFrame]], columns: Sequence[str]) -> DataFrame | None:
    return next((d for s in sources if (d := strict(s(), columns)) is not None), None)


def split_is(split: Column, *names: str) -> Column:
    return F.lower(F.trim(split)).isin(*names)


def scored(label: Column, mapping: dict[str, str], unscored: Sequence[str] = ()) -> Column:
    return label.cast("string").isin(*[k for k in mapping if k not in unscored])


def in_window(time: Column, anchor: Column, before: str, after: str | None = None) -> Column:
    """anchor - before <= time <= anchor + after, both ends in; a null time goes, a null anchor keeps all."""
    upper = anchor if after is None else shifted(anchor, after, 1)
    return anchor.isNull() & time.isNotNull() | time.between(shifted(anchor, before, -1), upper)


def category_matches(terms: Sequence[str], *cols: Column) -> Column:
    """Any term is part of the joined columns, without case."""
    text = F.lower(F.concat_ws(" ", *cols))
    return reduce(lambda a, b: a | b, [text.contains(t.lower()) for t in terms], F.lit(False))


def code_matches(code: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """With case: some of include (if any), none of exclude; a null code is empty."""
    c = F.coalesce(code, F.lit(""))
    some = reduce(lambda a, b: a | b, [c.contains(t) for t in include], F.lit(not include))
    return some & ~reduce(lambda a, b: a | b, [c.contains(t) for t in exclude], F.lit(False))


def not_listed(ids: Sequence[str], note_id: Column, code: Column, prefix: str) -> Column:
    """Rows whose note is listed go, if their code has the prefix."""
    return ~F.coalesce(note_id.isin(*ids) & code.startswith(prefix), F.lit(False))


def without_placeholder(text: Column, sentence: str) -> Column:
    return text.isNotNull() & ~F.lower(text).contains(sentence.lower())


def hidden_group(df: DataFrame, keys: Sequence[str], note: str, marker: str) -> DataFrame:
    """Groups with a marked note: (keys, hidden)."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(F.lower(F.col(note)).contains(marker.lower())), F.lit(False)).alias("hidden"))


def group_any(df: DataFrame, keys: Sequence[str], flag: Column, name: str) -> DataFrame:
    """df with whether any row of its group has the flag; nulls count as not. Groups are reduced before they are joined
    back, so a group of any size is one row."""
    found = df.groupBy(*keys).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias(name))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return df.alias("l").join(found.alias("r"), same).select("l.*", f"r.{name}")


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def leak_counts(df: DataFrame, cut: Column, text_dates: Sequence[str] = ()) -> DataFrame:
    """(column, later): values after the cut in every date column, in one pass over the table."""
    cols = [*date_columns(df), *text_dates]
    counts = [F.count_if(F.col(c).cast("date") > cut if c not in text_dates else F.try_to_timestamp(F.col(c)).cast("date") > cut).alias(c) for c in cols]
    return df.agg(*counts).unpivot([], cols, "column", "later")


def with_outcome(df: DataFrame, tokens: Column, images: Column, per_image: int, limit: int) -> DataFrame:
    """outcome: overflow where the budget is passed, missing where there is nothing to count, else ok."""
    need = tokens + images * per_image
    return df.withColumn("need", need.cast("bigint")).withColumn("outcome", F.when(need.isNull(), "missing").when(need > limit, "overflow").otherwise("ok"))


def two_way(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where the flag holds, all others)."""
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    return marked.where("__flag").drop("__flag"), marked.where("NOT __flag").drop("__flag")


#: Row filters by name: (parameters) -> DataFrame -> DataFrame.
FILTERS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {}


def register_filter(name: str):
    def add(fn):
        FILTERS[name] = fn
        return fn

    return add


@register_filter("window")
def _window(time: str, anchor: str, before: str, after: str | None = None):
    return lambda df: df.where(in_window(F.col(time), F.col(anchor), before, after))


@register_filter("category")
def _category(terms: Sequence[str], columns: Sequence[str]):
    return lambda df: df.where(category_matches(terms, *map(F.col, columns)))


@register_filter("code")
def _code(column: str, include: Sequence[str] = (), exclude: Sequence[str] = ()):
    return lambda df: df.where(code_matches(F.col(column), include, exclude))


@register_filter("notes")
def _notes(ids: Sequence[str], note_id: str, code: str, prefix: str):
    return lambda df: df.where(not_listed(ids, F.col(note_id), F.col(code), prefix))


def chain(df: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """Applies configured filters in order; an unknown name is an error."""
    for step in steps:
        params = {k: v for k, v in step.items() if k != "fn"}
        if step["fn"] not in FILTERS:
            raise KeyError(f"no filter named {step['fn']!r}")
        df = df.transform(FILTERS[step["fn"]](**params))
    return df
