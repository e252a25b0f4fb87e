"""Text and number expressions that must equal the usual Python definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark a link.
URL_TOKENS = ("http://", "https://", "www.")


def n_chars(body: Column) -> Column:
    return F.length(F.coalesce(body, F.lit("")))


def n_words(body: Column) -> Column:
    """Words parted by Unicode white space."""
    return F.size(F.filter(F.split(F.coalesce(body, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def n_upper(body: Column) -> Column:
    return F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"\p{Lu}"))


def n_punct(body: Column) -> Column:
    return F.regexp_count(F.coalesce(body, F.lit("")), F.lit("[!?.,;:]"))


def upper_ratio(body: Column) -> Column:
    return F.coalesce(F.try_divide(n_upper(body), n_chars(body)), F.lit(0.0))


def has_url(body: Column) -> Column:
    b = F.coalesce(body, F.lit(""))
    hit = F.lit(False)
    for t in URL_TOKENS:
        hit = hit | b.contains(t)
    return hit.cast("int")


def log_score(score: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(score, F.lit(0)), F.lit(0)).cast("double"))


def round_half_even(x: Column) -> Column:
    """Count from a real prediction: clipped at zero, ties to the even number."""
    return F.bround(F.greatest(x, F.lit(0.0))).cast("bigint")


def hour_utc(ts: Column) -> Column:
    return F.when(ts > 0, F.hour(F.timestamp_seconds(ts))).otherwise(0)


def weekday_utc(ts: Column) -> Column:
    """Monday is 0."""
    return F.when(ts > 0, F.weekday(F.timestamp_seconds(ts))).otherwise(0)


def month_utc(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM")


def months_between(a: Column, b: Column) -> Column:
    """Whole months from ``a`` to ``b``, both ``YYYY-MM``."""
    part = lambda x, i, n: F.substring(x, i, n).cast("int")
    return (part(b, 1, 4) - part(a, 1, 4)) * 12 + part(b, 6, 2) - part(a, 6, 2)


def width_bucket(width: Column) -> Column:
    return F.when(width <= 1, "1").when(width <= 3, "2-3").when(width <= 9, "4-9").otherwise("10+")


def truncated(text: Column, n: int) -> Column:
    """First ``n`` characters, with an ellipsis where something is cut."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("…")))
