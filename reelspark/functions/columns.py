"""Column expressions that replace the reference's scalar UDFs with built-ins.

All of them stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's for equal results.
RATING_LOG_PREFIX = "MOVIE_RATING_PREFIX:"   # marker in application log lines
DEFAULT_RELEASE_YEAR_FEATURES = 1990          # feature jobs: title missing or too short
DEFAULT_RELEASE_YEAR_CATALOGUE = -1           # catalogue: year not parsable
STRICT_LIKE_THRESHOLD = 3.5                   # training-sample label, score > 3.5
INCLUSIVE_LIKE_THRESHOLD = 3.5                # feature label, rating >= 3.5
PREF_GENRE_THRESHOLD = 3.0                    # preferred genres, score > 3.0
STRONG_RATING_THRESHOLD = 3.0                 # re-rank boost, score > 3


def epoch_seconds(c: Column, dtype: T.DataType) -> Column:
    """Whole epoch seconds of a timestamp column, independent of session zone.

    ``TIMESTAMP`` (an instant) maps directly; ``TIMESTAMP_NTZ`` (wall clock) is
    read as UTC wall clock, as DuckDB's ``epoch()`` does.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return (F.unix_date(F.to_date(c)).cast("bigint") * 86400
                + F.hour(c).cast("bigint") * 3600
                + F.minute(c).cast("bigint") * 60
                + F.second(c).cast("bigint"))
    if isinstance(dtype, T.TimestampType):
        return F.unix_seconds(c)
    return c.cast("bigint")


def epoch_col(df: DataFrame, name: str) -> Column:
    return epoch_seconds(F.col(name), df.schema[name].dataType)


def year_month(ts_seconds: Column) -> Column:
    """``yyyyMM`` integer of epoch seconds in UTC (the reference's ``changeDate``)."""
    d = F.date_from_unix_date(F.floor(ts_seconds / F.lit(86400)).cast("int"))
    return (F.year(d) * 100 + F.month(d)).cast("int")


def like_label(score: Column, threshold: float, strict: bool) -> Column:
    cond = score > threshold if strict else score >= threshold
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("int")


def release_year(title: Column, default: int = DEFAULT_RELEASE_YEAR_FEATURES) -> Column:
    """Year in the trailing ``(YYYY)`` of a title; ``default`` when absent."""
    y = F.regexp_extract(title, r"\((\d{4})\)\s*$", 1)
    return F.coalesce(F.when(y != "", y.try_cast("int")), F.lit(default)).cast("int")


def clean_title(title: Column) -> Column:
    """Title without its trailing ``(YYYY)``, trimmed; null stays null."""
    return F.trim(F.regexp_replace(title, r"\s*\(\d{4}\)\s*$", ""))


def split_genres(genres: Column) -> Column:
    return F.split(genres, r"\|")


def log10_at_least_one(n: Column) -> Column:
    """``log10(max(n, 1))``: a missing or zero count contributes nothing."""
    return F.log10(F.greatest(n.cast("double"), F.lit(1.0)))


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c.cast("double"), places)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def guarded_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; -1 when either is null or lengths differ."""
    return (F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(-1.0))
            .otherwise(dot(a, b) / (norm2(a) * norm2(b))))


def sorted_genre_tokens(genre_lists: Column) -> Column:
    """All genres of a list of ``A|B|C`` strings, flattened and sorted."""
    return F.array_sort(F.flatten(F.transform(genre_lists, lambda g: split_genres(g))))


def genre_frequency_order(sorted_tokens: Column) -> Column:
    """Distinct genres of a sorted token array, most frequent first, ties by name.

    The count of genre g is the span between its first and last position in
    the sorted array (native ``array_position``, no per-element lambda).
    Pass a column reference (see ``sorted_genre_tokens``), not an expression,
    so the array is built once per row.
    """
    n = F.size(sorted_tokens)
    rev = F.reverse(sorted_tokens)

    def counted(g):
        first = F.array_position(sorted_tokens, g)
        last = n - F.array_position(rev, g) + 1
        return F.struct((first - last - 1).alias("neg_n"), g.alias("genre"))

    return F.transform(F.array_sort(F.transform(F.array_distinct(sorted_tokens), counted)),
                       lambda s: s["genre"])
