"""Text access and normalisation shared by the training-data operators."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and symbols that look like Latin letters.
LOOKALIKES = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n", "ν": "v", "ο": "o", "α": "a", "ι": "i", "κ": "k", "τ": "t", "ρ": "p",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "’": "'", "‘": "'", "´": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "‑": "-", " ": " ", " ": " ", " ": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
})


#: Anything past accented Latin letters, and the odd characters below that.
_ODD = re.compile("[^\x00-\x9f\xa1-\xac\xae-\xb3\xb5-\u024f]")


def plain(text: str) -> str:
    """NFC text with look-alike letters, odd spaces and zero-width characters undone."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii() or not _ODD.search(text):
        return text
    return unicodedata.normalize("NFC", text).translate(LOOKALIKES)


SENTENCE = re.compile(r"[.!?]+(?=\s|$|[\"')\]*_])|\n+")


def record_texts(records: DataFrame, *keep: str) -> DataFrame:
    """One row per stimulus and reply: ``record_id, comment_id, body`` and the columns in ``keep``.

    Only ``id`` and ``body`` of the nested columns are read. Null bodies are dropped;
    a null ``replies`` array counts as empty. Repeated rows stay: callers end with a distinct.
    """
    pair = F.transform(
        F.arrays_zip(
            F.concat(F.array("stimulus.id"), F.coalesce(F.col("replies.id"), F.array().cast("array<string>"))).alias("i"),
            F.concat(F.array("stimulus.body"), F.coalesce(F.col("replies.body"), F.array().cast("array<string>"))).alias("b"),
        ),
        lambda x: F.struct(x["i"].alias("comment_id"), x["b"].alias("body")),
    )
    flat = records.select("record_id", *[F.col(k).alias(k.split(".")[-1]) for k in keep], pair.alias("pairs"))
    names = [k.split(".")[-1] for k in keep]
    return flat.select("record_id", *names, F.explode("pairs").alias("t")).select("record_id", *names, "t.comment_id", "t.body").filter("body is not null")
