"""String functions: event lines, reports, cleaning, line operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Fixed values of the rendered formats.
NO_EVENTS = "No clinical events found for this period."
TRUNCATED = "... [TRUNCATED]"
OMITTED = "[earlier records omitted to fit; the newest are kept]"
LEAD_INS = ["answer:", "response:", "the answer is", "answer is", "the response is", "response is", "correct option is"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def populated(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def one_decimal(cents: Column) -> Column:
    """A value given in hundredths, as text with two decimals; integer arithmetic, so every engine agrees."""
    a = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(a / 100).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


@pandas_udf(StringType())
def rounded_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Python's round(x, 1) as text (binary half-even), for parity with rendered lines."""
    for s in batches:
        yield s.map(lambda x: None if pd.isna(x) else str(round(float(x), 1)))


def event_line(time: Column, code: Column, description: Column | None = None, value: Column | None = None, unit: Column | None = None, note: Column | None = None, longest: int | None = None) -> Column:
    """`[time] | code (description) | VALUE: v unit | NOTE: text`; parts that are null are left out. value is text."""
    parts = [F.concat(F.lit("["), F.date_format(time, "yyyy-MM-dd HH:mm"), F.lit("]"))]
    desc = F.lit("") if description is None else F.coalesce(F.when(description != "", F.concat(F.lit(" ("), description, F.lit(")"))), F.lit(""))
    parts.append(F.concat(code, desc))
    if value is not None:
        parts.append(F.concat(F.lit("VALUE: "), value, F.lit("") if unit is None else F.coalesce(F.concat(F.lit(" "), unit), F.lit(""))))
    if note is not None:
        clean = F.trim(F.regexp_replace(note, "\n", " "))
        if longest:
            clean = F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest), F.lit("..."))).otherwise(clean)
        parts.append(F.when(clean != "", F.concat(F.lit("NOTE: "), clean)))
    return F.concat_ws(" | ", *parts)


def note_line(text: Column, at: Column | None = None) -> Column:
    body = F.concat(F.lit("NOTE: "), F.trim(F.regexp_replace(text, r"\s+", " ")))
    return body if at is None else F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit("] | "), body)


def strip_value(text: Column) -> Column:
    """Drops the VALUE part of every line."""
    return F.regexp_replace(text, r"(?m)\s*\|\s*VALUE:.*$", "")


def drop_lines(text: Column, marker: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.contains(line, F.lit(marker))), "\n")


def trim_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def truncate(text: Column, n: int) -> Column:
    """A text of at most four lines stays. Any other gets a leading line break and, where that makes it longer than n, is
    cut to n characters with a mark after them; nothing is left of it where n has no room."""
    cut = F.when(F.length(text) > n - 1, F.concat(F.substring(text, 1, max(0, n - 1)), F.lit(TRUNCATED))).otherwise(text)
    return F.when(F.size(F.split(text, "\n")) <= 4, text).otherwise(F.concat(F.lit("\n"), cut) if n > 1 else F.lit(""))


def count_events(text: Column) -> Column:
    """Lines that start with a bracketed time; null and the sentence for no events count 0."""
    return F.when(text.isNull() | (text == NO_EVENTS), 0).otherwise(F.regexp_count(text, F.lit(r"(?m)^\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}\]"))).cast("bigint")


def event_dates(text: Column) -> Column:
    """Distinct dates of the event lines."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d{4}-\d{2}-\d{2}) \d{2}:\d{2}\]"), F.lit(1)))
    return F.when(text.isNull(), 0).otherwise(F.size(found)).cast("bigint")


def clean_answer(text: Column) -> Column:
    """Trims, takes off wrapping quotes, lead-in phrases and truncation marks, and joins runs of white space."""
    s = F.trim(F.coalesce(text, F.lit("")))
    s = F.trim(F.regexp_replace(s, r"""(?s)^(["'])(.*)\1$""", "$2"))
    for phrase in LEAD_INS:
        s = F.trim(F.regexp_replace(s, rf"(?i)^{phrase}\s*", ""))
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"(?i)\s*\[TRUNCATED.*?\]\s*$", "")
    return F.trim(F.regexp_replace(s, r"(?i)\s*\[.*?truncated.*?\]\s*$", ""))


def strip_option(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^[A-Z]:\s*", "")


def clean_question(text: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(text, F.lit("")), r"(?i)\bOPTIONS\b"), 1))


def tag(text: Column, name: str) -> Column:
    """Content of the first <name>...</name>; empty where there is none."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is)<{name}\s*>(.+?)</{name}\s*>", 1))


def open_tag(text: Column, name: str) -> Column:
    """As tag(); an unclosed tag takes the rest."""
    closed = tag(text, name)
    return F.when(closed != "", closed).otherwise(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is)<{name}\s*>(.+)", 1)))


def replace_first(text: Column, mark: str, by: Column) -> Column:
    """Only the first occurrence of mark."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + len(mark), F.length(text)))).otherwise(text)


def keep_latest(text: Column, most: int) -> Column:
    """The newest whole lines within `most` characters, after a marker line; a newest line that is too long is cut."""
    room = most - len(OMITTED) - 1

    def count(lines: Column) -> Column:
        """How many lines from the end fit, line breaks included."""
        start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def add(seen: Column, line: Column) -> Column:
            used = seen["used"] + F.length(line) + 1
            fits = seen["open"] & (used <= room)
            return F.struct(used.alias("used"), (seen["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

        return F.aggregate(F.reverse(lines), start, add)["n"]

    def shortened(lines: Column) -> Column:
        kept = bound(count(lines), lambda n: F.slice(lines, F.size(lines) - n + 1, n))
        newest = F.coalesce(F.get(F.filter(F.reverse(lines), lambda x: x != ""), F.lit(0)), F.lit(""))
        own = bound(kept, lambda k: F.when(F.exists(k, lambda x: x != ""), k).otherwise(F.array(F.substring(newest, 1, max(0, room)))))
        return F.array_join(F.concat(F.array(F.lit(OMITTED)), own), "\n")

    return F.when(F.length(text) <= most, text).otherwise(bound(F.split(text, "\n"), shortened))


def last_k_dates(text: Column, k: int, most: int | None = None) -> Column:
    """Text from the first line of the k-th newest distinct date on; fewer dates where that is over `most` characters, and
    where one date alone is, its newest lines. A text of fewer dates is whole."""
    day = r"^\[(\d{4}-\d{2}-\d{2})"

    def cut(lines: Column) -> Column:
        dates = F.transform(lines, lambda x: F.regexp_extract(x, day, 1))
        newest = F.reverse(F.array_sort(F.array_distinct(F.filter(dates, lambda d: d != ""))))
        return bound(F.struct(lines.alias("lines"), dates.alias("dates"), newest.alias("newest")), choices)

    def from_date(z: Column, n: Column) -> Column:
        first = F.get(F.filter(F.transform(z["dates"], lambda d, i: F.when((d != "") & (d >= F.get(z["newest"], n - 1)), i)), lambda i: i.isNotNull()), F.lit(0))
        return F.array_join(F.slice(z["lines"], first + 1, F.size(z["lines"])), "\n")

    def choices(z: Column) -> Column:
        texts = F.transform(F.sequence(F.lit(k), F.lit(1), F.lit(-1)), lambda n: from_date(z, n))
        own = F.get(texts, F.lit(0)) if most is None else bound(texts, lambda t: F.coalesce(F.get(F.filter(t, lambda x: F.length(x) <= most), F.lit(0)), keep_latest(F.element_at(t, -1), most)))
        return F.when(F.size(z["newest"]) <= k, whole).otherwise(own)

    whole = text if most is None else keep_latest(text, most)
    return bound(F.split(text, "\n"), cut)


def demographics(age: Column, sex: Column) -> Column:
    """One line with age and sex; what is not known says so."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return F.concat(F.lit("PATIENT: age "), known(age), F.lit(" years at the prediction time; sex "), known(sex), F.lit("."))


def retrieved_line(time: Column, code: Column, name: Column, kind: Column, value: Column) -> Column:
    """`[time] | code (name) | VALUE: v` of a retrieved event; its kind where it has neither code nor name, `[unknown]`
    where it has no time; null where nothing but a time is left."""
    held = lambda c: F.when(F.trim(c) != "", c)
    stamp = F.coalesce(F.date_format(time, "'['yyyy-MM-dd HH:mm']'"), F.lit("[unknown]"))
    what = F.nullif(F.concat_ws(" ", F.nullif(code, F.lit("")), F.concat(F.lit("("), held(name), F.lit(")"))), F.lit(""))
    what = F.coalesce(what, F.nullif(kind, F.lit("")))
    said = F.concat(F.lit("VALUE: "), held(F.trim(F.regexp_replace(value, "\n", " "))))
    return F.when(what.isNotNull() | said.isNotNull(), F.concat_ws(" | ", stamp, what, said))


def template_prompt(template: Column, parts: dict[str, Column]) -> Column:
    """A template with every mark [NAME] replaced by its text; a null text is empty."""
    out = template
    for name, part in parts.items():
        out = F.replace(out, F.lit(f"[{name}]"), F.coalesce(part, F.lit("")))
    return out
