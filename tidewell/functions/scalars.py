"""Column functions shared by the metric operators."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(c.cast("timestamp"))


def quarter_of(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def previous_year_quarter(q: Column) -> Column:
    return F.concat((F.substring(q, 1, 4).cast("int") - 1).cast("string"), F.substring(q, 5, 2))


def kst_day(c: Column) -> Column:
    """The calendar day nine hours ahead of UTC."""
    return F.date_format(c + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd")


def ratio(a: Column, b: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def scaled_round(c: Column, places: int) -> Column:
    """A double rounded as DuckDB does: its product with a power of ten to the whole number, half away from zero, divided again.

    Spark rounds the shortest decimal text of the double instead, so 294.715, which is a little less, becomes 294.72 there.
    """
    x, scale = c.cast("double"), F.lit(10.0**places)
    out = F.round(x * scale, 0) / scale
    return F.when(F.abs(out) < float("inf"), out).otherwise(x)


def quotient(a: Column, b: Column) -> Column:
    """A quotient of doubles as DuckDB gives it: by zero it is infinite by the signs of both, and 0 / 0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    endless = F.when(b.cast("string").startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(b == 0, a * endless).otherwise(F.try_divide(a, b))


def quoted_leaf(path: Column) -> Column:
    """The last part of a ``a > b > c`` path."""
    return F.element_at(F.split(path, " > "), -1)


def iso_seconds(c: Column) -> Column:
    """Seconds of an ISO 8601 duration of days, hours, minutes and seconds; null if it is none."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, rf"(\d+){unit}", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long")
    return F.when(c.rlike(r"^P(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$"), part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S"))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))


def bigrams(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"\s+", "")
    n = F.length(s)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(s, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    return ratio(2 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Places that are summed one by one before blocks are put together.
BLOCK = 512
# The characters that go from a text, and how often it is normalised at most.
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def normal_text(text: str) -> str:
    """Entities resolved, NFKC, no control characters, white space collapsed; repeated until nothing changes."""
    for _ in range(4):
        new = " ".join(_CONTROL.sub("", unicodedata.normalize("NFKC", html.unescape(text))).split())
        if new == text:
            break
        text = new
    return text


@F.pandas_udf(T.StringType())
def normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normal_text(t))


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def spans(text: Column, pattern: str) -> Column:
    """The matches of a pattern, as an array of (start, stop, found), places counted from 0; none for a null text.

    What stands between the matches has the same lengths as the pieces that the text splits into, which tells the
    places. They are summed in blocks of BLOCK, then over the blocks, so that work grows with the matches and not with
    their square. A pattern that matches the empty text is not meant.
    """
    told = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("gaps")))

    def summed(numbers: Column) -> Column:
        """Running sums, 0 before them."""
        return F.aggregate(numbers, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def placed(x: Column) -> Column:
        steps = F.transform(x["found"], lambda m, i: F.length(m) + F.length(F.element_at(x["gaps"], i + 1)))
        count = F.floor((F.size(steps) + BLOCK - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda b: summed(F.slice(steps, (b - 1) * BLOCK + 1, F.lit(BLOCK))))
        # through an array of one, so that the blocks are summed once
        whole = F.element_at(F.transform(F.array(blocks), lambda bs: F.flatten(F.zip_with(bs, F.slice(summed(F.transform(bs, lambda s: F.element_at(s, -1))), F.lit(1), F.size(bs)), lambda s, base: F.transform(F.slice(s, F.lit(2), F.size(s)), lambda n: n + base)))), 1)
        return F.zip_with(whole, x["found"], lambda stop, m: F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("found")))

    # through an array of one, so that matches and gaps are found once
    kind = "array<struct<start:int,stop:int,found:string>>"
    return F.coalesce(F.element_at(F.transform(told, placed), 1).cast(kind), F.array().cast(kind))


def around(text: Column, start: Column, stop: Column) -> Column:
    """The characters of a text from place start to before stop; places outside the text are cut off."""
    a = F.greatest(start, F.lit(0))
    return F.substring(text, a + 1, F.greatest(stop - a, F.lit(0)))
