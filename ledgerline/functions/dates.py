"""Dates in several formats, durations, ages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def parse_time(text: Column) -> Column:
    """`yyyy-MM-dd[ HH:mm[:ss]]`, ISO with T and Z, yyyyMMdd, yyyyMM (its first day); null where none fits."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?<=\d)T(?=\d)", " "), r"(?<=:\d{2})(\.\d+)?Z?$", "")
    shaped = [F.when(t.rlike(p), F.try_to_timestamp(v, F.lit(f))) for p, v, f in [
        (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", t, FORMATS[0]), (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", t, FORMATS[1]), (r"^\d{4}-\d{2}-\d{2}$", t, FORMATS[2]),
        (r"^\d{8}$", t, "yyyyMMdd"), (r"^\d{6}$", F.concat(t, F.lit("01")), "yyyyMMdd"),
    ]]
    return F.coalesce(*shaped).cast("timestamp_ntz")


#: The units of a duration as parts of an interval; none stands for days.
UNITS = {"": ("hours", 24), "h": ("hours", 1), "d": ("hours", 24), "w": ("hours", 168), "mo": ("months", 1), "y": ("years", 1)}


def parse_duration(text: str) -> dict[str, int]:
    """'365d', '2w', '6mo', '1y', '12h' or a bare number of days, as interval parts; months and years are whole."""
    said = text.strip().lower()
    unit = said.lstrip("0123456789.")
    number = said[: len(said) - len(unit)]
    part, size = UNITS.get(unit.strip(), ("", 0))
    if not part or not all(piece.isdigit() for piece in number.split(".", 1)):
        raise ValueError(f"not a duration: {text!r}")
    return {part: round(float(number) * size) if part == "hours" else int(float(number))}


def shifted(anchor: Column, text: str, sign: int) -> Column:
    """anchor moved by the duration; months clip to the month's end."""
    parts = parse_duration(text)
    return anchor + F.make_interval(**{k: F.lit(sign * v) for k, v in parts.items()})


def age_at(birth: Column, anchor: Column) -> Column:
    """Whole years by (month, day) comparison."""
    before = (F.month(anchor) * 100 + F.dayofmonth(anchor)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return (F.year(anchor) - F.year(birth) - before.cast("int")).cast("bigint")


def horizon_years(task: Column) -> Column:
    return F.nullif(F.regexp_extract(task, r"_(\d+)_yr", 1), F.lit("")).cast("bigint")
