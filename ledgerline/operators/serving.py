"""Asking a model over a table: request hashes, a stored-answer cache, waves, caps, usage.

The model is an injected batch function, list of requests -> list of replies; `echo_model` is a
deterministic stand-in. Replies are cached in a table by request hash, so a second run asks nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.hashing import fingerprint
from ledgerline.storage import written

Model = Callable[[list[str]], list[str | None]]
ADAPTERS: dict[str, Callable[..., Model]] = {}


def register_adapter(name: str):
    def add(make):
        ADAPTERS[name] = make
        return make

    return add


@register_adapter("echo")
def echo_model(options: Sequence[str] = ("yes", "no")) -> Model:
    """Picks an option by the request's hash."""
    return lambda requests: [options[int(hashlib.sha256(r.encode()).hexdigest(), 16) % len(options)] for r in requests]


def adapter(name: str, **params) -> Model:
    if name not in ADAPTERS:
        raise KeyError(f"no adapter named {name!r}")
    return ADAPTERS[name](**params)


def with_request_key(df: DataFrame, *parts: Column, name: str = "message_key") -> DataFrame:
    return df.withColumn(name, fingerprint(*parts))


def waves(df: DataFrame, case: str, order: Sequence[Column], cached: Column | None = None) -> DataFrame:
    """wave 0: each case's first question whose answer is not stored; wave 1: all others."""
    known = F.lit(0) if cached is None else F.coalesce(cached, F.lit(False)).cast("int")
    w = Window.partitionBy(case).orderBy(known, *order)
    return df.withColumn("wave", F.when(F.row_number().over(w) == 1, 0).otherwise(1))


def ask(df: DataFrame, request: str, model: Model, name: str = "response_text", batch: int = 64) -> DataFrame:
    """Adds the model's reply; a failed batch has null replies and the error's text."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch].copy()
                try:
                    part[name], part["error"] = model(part[request].tolist()), None
                except Exception as e:
                    part[name], part["error"] = None, f"{type(e).__name__}: {e}"[:500]
                yield part

    return df.mapInPandas(run, schema)


def ask_with_cache(df: DataFrame, request: str, model: Model, cache: DataFrame, readable: Callable[[Column], Column], key: str = "message_key") -> tuple[DataFrame, DataFrame]:
    """(rows with replies, rows to add to the cache). Only distinct requests that the cache lacks are asked, each once: the
    replies are written to a table that both results read. Only readable replies are kept for the cache. cache: (key,
    response_text)."""
    wanted = df.select(key, request).dropDuplicates([key])
    fresh = written(ask(wanted.join(cache.select(key), key, "left_anti"), request, model), "replies")
    known = cache.select(key, "response_text", F.lit(None).cast("string").alias("error"), F.lit(True).alias("from_cache"))
    replies = known.unionByName(fresh.select(key, "response_text", "error", F.lit(False).alias("from_cache")))
    return df.join(replies, key, "left"), fresh.where(readable(F.col("response_text"))).select(key, "response_text")


def within_cap(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: Column, cap: float) -> DataFrame:
    """Requests that a spend cap lets through per key: what came before, counted at the mean cost where unknown, stays below
    the cap. It is rounded to nine places first, so that a spend that meets the cap is not let through by what adding lost."""
    mean = F.avg(cost).over(Window.partitionBy(*keys))
    before = F.sum(F.coalesce(cost, mean, F.lit(0.0))).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("allowed", F.round(F.coalesce(before, F.lit(0.0)), 9) < cap)


def answered(df: DataFrame, answer: str, error: str) -> DataFrame:
    """Rows with a readable answer and no error."""
    return df.where(F.col(answer).isNotNull() & F.col(error).isNull())
