"""Identifier expressions of the comment dump."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_id(ref: Column) -> Column:
    """Id without its kind prefix: what follows the first underscore (all of it where there is none)."""
    return F.regexp_replace(ref, "^[^_]*_", "")


def hash_unit(seed: str, *keys: Column) -> Column:
    """Deterministic draw in [0, 2**32) from a seed and keys, the same in every engine."""
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_order(seed: str, *keys: Column) -> Column:
    """Deterministic shuffle key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def ordinal(created: Column, ident: Column) -> Column:
    """Order of siblings: time of creation, then id, as one comparable string."""
    return F.concat(F.lpad(F.coalesce(created, F.lit(0)).cast("string"), 12, "0"), F.lit(":"), ident)
