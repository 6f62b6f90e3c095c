"""Index generators and intensity windows over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import bound


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(_none())


def every_index(depth: Column) -> Column:
    return _upto(depth)


def evenly_spaced(depth: Column, k: int) -> Column:
    """k indices int(i / (k - 1) * (depth - 1))."""
    if k <= 0:
        return _none()
    at = lambda i: (i / F.lit(float(max(k - 1, 1))) * (depth - 1)).cast("bigint")
    return F.when(depth > 0, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at)).otherwise(_none())


def up_to(depth: Column, k: int) -> Column:
    return F.when(depth <= k, _upto(depth)).otherwise(evenly_spaced(depth, k))


def uniform_tail(depth: Column, k: int) -> Column:
    """All, or round(i / k * (depth - 1)) for i = 1..k, half to even."""
    at = lambda i: F.bround(i / F.lit(float(k)) * (depth - 1), 0).cast("bigint")
    return F.when(depth <= k, _upto(depth)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(k)), at))


def fraction_range(depth: Column, count: int, low: float = 0.0, high: float = 1.0) -> Column:
    a, b = F.bround(F.lit(low) * (depth - 1), 0), F.bround(F.lit(high) * (depth - 1), 0)
    k = max(1, count)
    at = lambda j: F.bround(a + (b - a) * j / F.lit(float(max(k - 1, 1))), 0).cast("bigint")
    return F.when(depth > 0, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at)))).otherwise(_none())


def every_nth(depth: Column, n: int) -> Column:
    return F.when(depth > 0, F.filter(_upto(depth), lambda i: i % n == 0)).otherwise(_none())


def centre(depth: Column) -> Column:
    return F.when(depth > 0, F.array(F.floor(depth / 2).cast("bigint"))).otherwise(_none())


def centre_run(depth: Column, k: int) -> Column:
    start = F.floor((depth - k) / 2).cast("bigint")
    return F.when(depth <= k, _upto(depth)).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda i: i + start))


def index_range(depth: Column, low: int, high: int) -> Column:
    return F.filter(_upto(depth), lambda i: (i >= low) & (i < high))


#: Selector registry: name -> (depth column, parameters) -> array of indices.
SELECTORS = {
    "all": every_index, "evenly_spaced_k": evenly_spaced, "up_to_k": up_to, "uniform_tail": uniform_tail, "fraction_range": fraction_range,
    "every_n": every_nth, "center": centre, "center_k": centre_run, "slice_range": index_range,
}


def window_values(values: Column, low: float, high: float) -> Column:
    """Clipped to [low, high] and scaled to 0-255 (double)."""
    return F.transform(values, lambda v: (F.least(F.greatest(v.cast("double"), F.lit(low)), F.lit(high)) - low) / (high - low) * 255.0)


def window_bytes(values: Column, low: float, high: float, rounded: bool) -> Column:
    """As window_values, in whole numbers: rounded half to even, or cut."""
    return F.transform(window_values(values, low, high), lambda v: (F.bround(v, 0) if rounded else F.floor(v)).cast("bigint"))


def min_max_bytes(values: Column) -> Column:
    """Per-array scaling to 0-255; NaN counts as 0 and a constant array is all zero."""
    clean = F.transform(values, lambda v: F.when(F.isnan(v) | v.isNull(), 0.0).otherwise(v.cast("double")))
    scaled = lambda z: F.transform(z["c"], lambda v: F.when(z["high"] > z["low"], F.floor((v - z["low"]) / (z["high"] - z["low"]) * 255.0)).otherwise(0).cast("bigint"))
    return bound(clean, lambda c: bound(F.struct(c.alias("c"), F.array_min(c).alias("low"), F.array_max(c).alias("high")), scaled))


def three_windows(values: Column, windows: list[tuple[float, float]]) -> Column:
    """One struct (r, g, b) of whole numbers a value, each channel through its own window, rounded half to even."""
    channel = lambda v, w: F.bround((F.least(F.greatest(v.cast("double"), F.lit(w[0])), F.lit(w[1])) - w[0]) / (w[1] - w[0]) * 255.0, 0).cast("bigint")
    return F.transform(values, lambda v: F.struct(*[channel(v, w).alias(c) for c, w in zip("rgb", windows)]))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def second_half(values: Column) -> Column:
    half = F.floor(F.size(values) / 2).cast("int")
    return F.slice(values, half + 1, F.size(values) - half)


def fitting_count(bytes_each: Column, limit: int, counts: list[int]) -> Column:
    """The largest of the counts whose base64 size fits the limit."""
    size = F.ceil(bytes_each / 3) * 4
    return F.array_max(F.filter(F.array(*[F.lit(c).cast("bigint") for c in counts]), lambda c: c * size <= limit))
