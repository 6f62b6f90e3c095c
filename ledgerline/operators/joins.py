"""Joins of the cohort algebra: precedence, uniqueness, as-of picks, cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.arrays import cosine
from ledgerline.functions.dates import shifted
from ledgerline.operators.running import RANGE_ROWS, carried_last
from ledgerline.storage import written


def right_wins(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join; a column that both sides have comes from the right."""
    return left.drop(*[c for c in left.columns if c in right.columns and c not in on]).join(right, list(on), how)


def restrict(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def without_done(df: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key, compared as text, is not done yet."""
    d = done.select(*[F.col(c).cast("string").alias(f"__{c}") for c in on])
    cond = [F.col(c).cast("string") == F.col(f"__{c}") for c in on]
    return df.join(d, cond, "left_anti")


def attach_link(df: DataFrame, link: DataFrame, on: dict[str, str], checked: bool = True) -> DataFrame:
    """Left join; keys whose types differ are compared as text. A link key that repeats is an error where it is met: the
    link is gathered by the join's own keys, so the check costs no pass and no shuffle of its own."""
    keys, rest = list(on.values()), [c for c in link.columns if c not in on.values()]
    same = {b: df.schema[a].dataType == link.schema[b].dataType for a, b in on.items()}
    as_key = lambda c, b: F.col(c) if same[b] else F.col(c).cast("string")
    renamed = link.select(*[as_key(k, k).alias(f"__{k}") for k in keys], *rest)
    if checked:
        names = [f"__{k}" for k in keys]
        row, n = F.first(F.struct(F.lit(1).alias("__one"), *rest)), F.count(F.lit(1))
        said = F.concat(F.lit(f"{keys} repeats: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in names]))
        gathered = renamed.where(" AND ".join(f"`{k}` IS NOT NULL" for k in names)).groupBy(*names).agg(row.alias("__row"), n.alias("__n"))
        renamed = gathered.select(*names, F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(said).cast(gathered.schema["__row"].dataType)).alias("__row")).select(*names, *[F.col(f"__row.{c}").alias(c) for c in rest])
    cond = [as_key(a, b) == F.col(f"__{b}") for a, b in on.items()]
    return df.join(renamed, cond, "left").drop(*[f"__{k}" for k in keys])


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which no key repeats on either side; one that does is an error where it is met."""
    return keyed_once(left, on).join(keyed_once(right, on), list(on))


def keyed_once(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """df, gathered by its keys; a key that repeats raises an error."""
    rest = [c for c in df.columns if c not in on]
    gathered = df.groupBy(*on).agg(F.first(F.struct(F.lit(1).alias("__one"), *rest)).alias("__row"), F.count(F.lit(1)).alias("__n"))
    said = F.concat(F.lit(f"{list(on)} repeats: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in on]))
    row = F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(said).cast(gathered.schema["__row"].dataType))
    return gathered.select(*on, row.alias("__row")).select(*on, *[F.col(f"__row.{c}").alias(c) for c in rest])


def alike(df: DataFrame, vector: Column, master: DataFrame, column: str, above: float) -> DataFrame:
    """Rows whose vector has a cosine above `above` with the one vector of master (refused if it has not one row)."""
    if master.limit(2).count() != 1:
        raise ValueError("the master vector is one row")
    one = master.select(F.col(column).alias("__master"))
    return df.withColumn("__vector", vector).crossJoin(F.broadcast(one)).where(cosine(F.col("__vector"), F.col("__master")) > above).drop("__vector", "__master")


def nearest(df: DataFrame, id_: str, vector: str, targets: DataFrame, name: str, target: str, block: int = 1000) -> DataFrame:
    """df with `nearest` and `cos`: the target (name, vector) of highest cosine to each row's vector; ties (to 9 digits) go to
    the smaller name. A row without a direction (null or zero) gets the smallest name and a null cosine.

    Up to `block` targets are broadcast. Of more, see pivot_pairs: a row meets only the targets around those pivots that may
    hold its nearest one, in pieces of `block` targets, and keeps the best."""
    count = targets.count()
    scored = F.transform("__targets", lambda z: F.struct(F.round(cosine(F.col(vector), z["v"]), 9).alias("cos"), (-z["n"]).alias("neg")))
    if count <= block:
        gathered = targets.agg(F.collect_list(F.struct(F.col(name).alias("n"), F.col(target).alias("v"))).alias("__targets"))
        met = df.crossJoin(F.broadcast(gathered)).withColumn("__best", F.array_max(scored))  # one row of at most `block` targets
        return met.select(*df.columns, (-F.col("__best.neg")).cast(targets.schema[name].dataType).alias("nearest"), F.col("__best.cos").alias("cos"))
    dealt, gathered = pivot_pairs(df, id_, vector, targets, name, target, block)
    best = dealt.join(gathered, ["__pivot", "__piece"]).select(id_, F.array_max(scored).alias("__best")).groupBy(id_).agg(F.max("__best").alias("__best"))
    least = targets.agg(F.min(name).alias("__least"))
    found = df.join(best, id_, "left").crossJoin(F.broadcast(least))  # one row
    return found.select(*df.columns, F.coalesce((-F.col("__best.neg")).cast(targets.schema[name].dataType), "__least").alias("nearest"), F.col("__best.cos").alias("cos"))


def pivot_pairs(df: DataFrame, id_: str, vector: str, targets: DataFrame, name: str, target: str, block: int = 1000, most: int = 1024) -> tuple[DataFrame, DataFrame]:
    """What rows have to meet to find their target of highest cosine: (id, vector, __pivot, __piece), and the targets
    (__pivot, __piece, __targets) in pieces of about `block`.

    Pivots are some of the targets (as many as the root of their number, `most` at most, in hash order), broadcast as one row.
    Each target belongs to its nearest pivot, whose radius is the distance of its farthest one, between unit vectors. A row's
    distance to a pivot less the radius bounds its distance to the pivot's targets from below (triangle inequality); the
    nearest pivot, a target itself, bounds the least distance from above. So all pivots past that are skipped, exactly.
    A pivot's targets are dealt to pieces by hash, so a crowded one is many rows."""
    count = targets.count()
    directed = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) > 0
    sound = targets.select(F.col(name).alias("n"), F.col(target).alias("v")).where(directed(F.col("v")))
    few = sound.orderBy(F.xxhash64("n"), "n").limit(min(most, math.isqrt(count) + 1)).agg(F.collect_list("v").alias("__pivots"))  # `most` vectors
    near = lambda v: F.transform("__pivots", lambda p: cosine(v, p))
    apart = lambda c: F.sqrt(F.greatest(2 - 2 * c, F.lit(0.0)))
    placed = sound.crossJoin(F.broadcast(few)).withColumn("c", near(F.col("v"))).select("n", "v", (F.array_position("c", F.array_max("c")) - 1).cast("int").alias("__pivot"), apart(F.array_max("c")).alias("d"))
    placed = written(placed, "around-pivots")
    sizes = placed.groupBy("__pivot").agg(F.max("d").alias("r"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__pieces"))
    circles = sizes.agg(F.collect_list(F.struct("__pivot", "r", "__pieces")).alias("__circles"))  # `most` at most
    pieces = placed.join(F.broadcast(sizes.drop("r")), "__pivot").withColumn("__piece", F.pmod(F.xxhash64("n"), F.col("__pieces")).cast("int"))
    gathered = pieces.groupBy("__pivot", "__piece").agg(F.collect_list(F.struct("n", "v")).alias("__targets"))
    asked = df.where(directed(F.col(vector))).select(id_, vector).crossJoin(F.broadcast(few)).crossJoin(F.broadcast(circles)).withColumn("c", near(F.col(vector))).withColumn("top", F.array_max("c"))
    # Room for rounding: distances are right to about 1e-8, cosines are compared to 9 digits.
    closest = lambda z: F.greatest(apart(F.get("c", z["__pivot"])) - z["r"] - 1e-7, F.lit(0.0))
    reached = F.filter("__circles", lambda z: 1 - closest(z) * closest(z) / 2 >= F.col("top") - 4e-9)
    dealt = asked.select(id_, vector, F.inline(reached)).select(id_, vector, "__pivot", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)).alias("__piece"))
    return dealt, gathered


def seconds_of(time: Column) -> Column:
    """Whole seconds since 1970 of a date or time, by its fields: no time zone moves them."""
    return F.unix_date(time.cast("date")).cast("bigint") * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def in_intervals(anchors: DataFrame, events: DataFrame, on: Sequence[str], start: Column, end: Column, time: Column, width: int | None = None) -> DataFrame:
    """anchors with each event of the same keys in [start, end] (columns of anchors; time: of events); columns that both have
    come from anchors.

    Time is cut into bins of `width` seconds, by default the mean length of the intervals; an anchor stands in every bin that
    its interval touches, an event in its own. So a pair is formed once, in the event's bin, and none outside the anchor's
    bins, whatever a key holds; a key's bins are different tasks'. Null times and bounds meet nothing."""
    spans = anchors.select("*", seconds_of(start).alias("__from"), seconds_of(end).alias("__to")).where("__from <= __to")
    if width is None:
        width = max(1, int(spans.agg(F.avg(F.col("__to") - F.col("__from"))).first()[0] or 1))  # one row
    bins = F.sequence(F.floor(F.col("__from") / width), F.floor(F.col("__to") / width))
    dealt = spans.withColumns({"__start": start, "__end": end, "__bin": F.explode(bins)}).drop("__from", "__to")
    keyed = events.select(*[F.col(k).alias(f"__{k}") for k in on], time.alias("__time"), F.floor(seconds_of(time) / width).alias("__at"), *[c for c in events.columns if c not in anchors.columns])
    same = [F.col(k) == F.col(f"__{k}") for k in on] + [F.col("__bin") == F.col("__at"), F.col("__time").between(F.col("__start"), F.col("__end"))]
    return dealt.join(keyed, same).drop("__start", "__end", "__bin", "__at", "__time", *[f"__{k}" for k in on])


def events_of_notes(rows: DataFrame, notes: DataFrame, events: DataFrame, keys: Sequence[str], person: str, note: str, time: str, anchor: str, before: str) -> DataFrame:
    """Events in [anchor - before, anchor] of each row's person whose note is one of the row's (keys, note) notes: an equi-join
    on the note, whose range is looked for in bins of time."""
    own = rows.join(notes.select(*keys, note).distinct(), list(keys))
    return in_intervals(own, events, [person, note], shifted(F.col(anchor), before, -1), F.col(anchor), F.col(time))


def matched(a: DataFrame, b: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables on the keys that they share."""
    return restrict(a, b, on), restrict(b, a, on)


def label_columns(long: DataFrame, key: str, task: str, label: str, tasks: Sequence[str], allowed: Sequence[int] | None = None) -> DataFrame:
    """Long (key, task, label) to label__<task>; labels outside `allowed` become null; absent tasks are null columns."""
    value = F.col(label) if allowed is None else F.when(F.col(label).isin(*allowed), F.col(label))
    return long.groupBy(key).agg(*[F.max(F.when(F.col(task) == t, value)).alias(f"label__{t}") for t in tasks])


def star(base: DataFrame, long: DataFrame, key: str, task: str, label: str, tasks: Sequence[str]) -> DataFrame:
    """All members' labels beside each row of base: one aggregation and one join, whatever the number of members."""
    return base.join(label_columns(long, key, task, label, tasks), key, "left")


def append_absent(table: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """New rows of known entities whose key is not yet there; columns as in the table."""
    fresh = new.join(table.select(*on), list(on), "left_anti")
    return table.unionByName(fresh.select(*[c for c in table.columns if c in new.columns]), allowMissingColumns=True)


def override(column: str, registry_column: str) -> Column:
    """The registry's text where it is not empty."""
    return F.coalesce(F.nullif(F.trim(F.col(registry_column)), F.lit("")), F.col(column))


def pick(df: DataFrame, keys: Sequence[str], within: Column, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Per key the value of the row that comes first in `order` among those `within`; a hash aggregate, no sort."""
    return df.where(within).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(name))


def latest_at_or_before(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, order: str, name: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """Backward as-of: for each left row the value of the last right row of its key at or before its time.

    Both sides are put in one sequence per key and the last right value is carried forward, from time range to time range
    where there are several: no pairs, and no task holds all rows of a key. At equal times right rows come first, the
    larger `order` last."""
    lcols = left.columns
    a = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[order].dataType).alias("__o"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.struct(*lcols).alias("__row"))
    b = right.select(F.col(key).alias("__k"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(order).alias("__o"), F.col(value).alias("__v"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    # A condition that is always true but that Spark does not push down: it cannot derive constraints of a union from the range's lambda.
    both = a.unionByName(b).where(F.monotonically_increasing_id() >= 0)
    carried = carried_last(both, ["__k"], [F.col("__t"), F.col("__side"), F.col("__o")], F.col("__v"), name, rows_each)
    return carried.where("__side = 1").select("__row.*", name)


def previous(df: DataFrame, key: str, order: Sequence[Column], column: str, name: str) -> DataFrame:
    """The same entity's value one row earlier."""
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(key).orderBy(*order)))


def cells(*dims: DataFrame) -> DataFrame:
    """Every combination of small dimension tables; refuses more than a million cells."""
    total = 1
    out = None
    for d in dims:
        total *= d.count()
        if total > 1_000_000:
            raise ValueError("too many cells for a grid of conditions")
        out = d if out is None else out.crossJoin(d)
    return out


def pairs(models: DataFrame, name: str) -> DataFrame:
    """(a, b), a before b, of a small list of names."""
    if models.count() > 1000:
        raise ValueError("too many names to pair")
    return models.select(F.col(name).alias("a")).crossJoin(models.select(F.col(name).alias("b"))).where("a < b")


def label_clashes(a: DataFrame, b: DataFrame, on: Sequence[str], label: str) -> DataFrame:
    """(shared, clashes) of two tables on their common keys."""
    joined = a.select(*on, F.col(label).alias("__a")).join(b.select(*on, F.col(label).alias("__b")), list(on))
    return joined.agg(F.count(F.lit(1)).alias("shared"), F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("clashes"))
