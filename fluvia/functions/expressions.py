"""Text, number, date and list expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def words(text: str | Column) -> Column:
    """Words of a text between white space, in lower case."""
    return F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"\s+"), lambda w: w != "")


def latin_words(text: str | Column) -> Column:
    """Runs of the letters A-Z, in lower case."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit("([a-z]+)"), F.lit(1))


def week_of(date: str | Column) -> Column:
    """(year, week) of MM/DD/YYYY, where week is the day of the year divided by seven."""
    d = F.to_date(date, "MM/dd/yyyy")
    return F.struct(F.year(d).alias("year"), F.floor(F.dayofyear(d) / 7).cast("int").alias("week"))


def distinct_items(*columns: str | Column) -> Column:
    """The different non-empty values of several columns of a row."""
    return F.filter(F.array_distinct(F.array(*columns)), lambda x: x.isNotNull() & (x != ""))


def pairs(items: str | Column) -> Column:
    """All pairs of a list, the earlier item first."""
    items = F.col(items) if isinstance(items, str) else items
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.filter(items, lambda y, j: j > i), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def dollars_to_euros(price: str | Column) -> Column:
    """In single precision, cut to a whole number."""
    p = F.col(price) if isinstance(price, str) else price
    return (p.cast("float") * F.lit(0.908).cast("float")).cast("bigint")


def hexadecimal(x: str | Column) -> Column:
    return F.lower(F.hex(x))


def octal(x: Column) -> Column:
    return F.conv(x.cast("string"), 10, 8)


@F.pandas_udf(LongType())
def collatz_steps(start: pd.Series) -> pd.Series:
    """Steps of the Collatz sequence down to 1: a loop whose length the data decide, run for a whole batch at a time."""
    import numpy as np

    x, steps = start.to_numpy(np.int64).copy(), np.zeros(len(start), np.int64)
    live = np.flatnonzero(x > 1)
    while len(live):
        v = x[live]
        x[live] = np.where(v % 2 == 0, v // 2, 3 * v + 1)
        steps[live] += 1
        live = live[x[live] > 1]
    return pd.Series(steps)
