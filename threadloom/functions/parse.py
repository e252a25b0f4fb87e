"""Parsing of model output with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How numbers are found in output that is no valid JSON; letters match in either case.
RX = {
    "score": r'"?score"?\s*[:=]\s*(-?\d+)',
    "controversiality": r'"?controvers\w*"?\s*[:=]\s*(\d+)',
    "width": r'"?width"?\s*[:=]\s*(-?\d+)',
}
RX_SUMMARY = r'"reply_summary"\s*:\s*"(.*?)"\s*[,}]'
RX_FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"
RX_RATING = r'"?rating"?\s*[:=]\s*([1-5])'


def unfenced(raw: Column) -> Column:
    """Content of the first fence, else the text itself, trimmed."""
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(raw, RX_FENCE, 1), F.lit("")), raw))


def _object(raw: Column) -> Column:
    """The parsed object, or null for anything else and for an empty one."""
    v = F.try_parse_json(unfenced(raw))
    return F.when(F.schema_of_variant(v).startswith("OBJECT") & (F.schema_of_variant(v) != "OBJECT<>"), v)


def _int(v: Column, key: str) -> Column:
    """Whole number as Python's int() reads it; 0 where it can't."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    text = F.try_variant_get(v, f"$.{key}", "string")
    number = F.try_variant_get(v, f"$.{key}", "double")
    whole = F.when(kind == "STRING", F.trim(text).try_cast("bigint")).when(kind == "BOOLEAN", (text == "true").cast("bigint")).otherwise(number.try_cast("bigint"))
    return F.coalesce(whole, F.lit(0))


def prediction(raw: Column) -> Column:
    """``score, controversiality, width, reply_summary`` of a model's answer; strict JSON first, else by pattern; numbers default to 0, text to ''."""
    v = _object(raw)
    found = lambda k: F.coalesce(F.nullif(F.regexp_extract(raw, "(?i)" + RX[k], 1), F.lit("")).try_cast("bigint"), F.lit(0))
    field = lambda k: F.when(v.isNotNull(), _int(v, k)).otherwise(found(k)).alias(k)
    text = F.when(v.isNotNull(), F.try_variant_get(v, "$.reply_summary", "string")).otherwise(F.regexp_extract(raw, "(?s)" + RX_SUMMARY, 1))
    return F.struct(field("score"), field("controversiality"), field("width"), F.coalesce(text, F.lit("")).alias("reply_summary"))


def rating(raw: Column) -> Column:
    """Rating 1 to 5, or null."""
    strict = F.try_variant_get(F.try_parse_json(unfenced(raw)), "$.rating", "int")
    return F.coalesce(F.when(strict.between(1, 5), strict), F.nullif(F.regexp_extract(raw, RX_RATING, 1), F.lit("")).try_cast("int"))


def summary(raw: Column) -> Column:
    """Summary of a bare or fenced JSON object or string; blank and anything else is null."""
    v = F.try_parse_json(unfenced(raw))
    kind = F.schema_of_variant(v)
    text = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$.summary", "string")).when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(F.trim(text) != "", text)


def last_object(raw: Column) -> Column:
    """Text from the first ``{`` to the last ``}``, or null."""
    return F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))
