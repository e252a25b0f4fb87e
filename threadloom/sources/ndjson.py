"""Comment dumps as (compressed) newline-delimited JSON, and lean JSONL files."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.comments import DUMP_COLUMNS

TEXTS = ["id", "parent_id", "link_id", "subreddit", "author"]
NUMBERS = ["score", "controversiality", "created_utc", "gilded"]
#: Lines that one task hands to the JVM at a time.
LINES = 20_000


def local_path(uri: str) -> str:
    return uri[5:].replace("//", "/", 1) if uri.startswith("file:") else uri


def compressed_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``line, _source_file`` of zstd files, one file per task, decompressed as a stream.

    zstd frames can't be split; only the list of names passes the driver. Bytes that are no UTF-8
    become replacement characters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for batch in batches:
            for name in batch["path"]:
                with open(local_path(name), "rb") as raw:
                    text = io.TextIOWrapper(zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(raw, read_across_frames=True), encoding="utf-8", errors="replace")
                    lines: list[str] = []
                    for line in text:
                        lines.append(line.rstrip("\n"))
                        if len(lines) >= LINES:
                            yield pd.DataFrame({"line": lines, "_source_file": os.path.basename(name)})
                            lines = []
                    yield pd.DataFrame({"line": lines, "_source_file": os.path.basename(name)})

    names = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)))
    return names.mapInPandas(run, "line string, _source_file string")


def plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, _source_file`` of plain or gzip files."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("_source_file"))


def _whole(text: Column, kind: Column) -> Column:
    """Integer as Python's int() reads a JSON value: numbers are cut, digit strings read, anything else is null."""
    return F.when(kind == "STRING", F.trim(text).try_cast("bigint")).when(kind == "BOOLEAN", (text == "true").cast("bigint")).otherwise(text.try_cast("double").try_cast("bigint"))


def parsed(lines: DataFrame) -> DataFrame:
    """The 15 columns plus ``bad``: lenient casts, empty ids to null, ``edited`` as text ('false' where unset).

    A line that is no JSON object is kept with ``bad`` true and nulls; blank lines are dropped.
    """
    v = F.try_parse_json("line")
    rows = lines.filter(F.trim("line") != "").select("_source_file", v.alias("v")).withColumn("bad", F.coalesce(~F.schema_of_variant("v").startswith("OBJECT"), F.lit(True)))
    rows = rows.withColumn("v", F.when(~F.col("bad"), F.col("v")))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    cols = {k: F.nullif(get(k), F.lit("")) for k in TEXTS} | {k: get(k) for k in ("body", "distinguished", "author_flair_text")} | {k: _whole(get(k), kind(k)) for k in NUMBERS}
    cols["edited"] = F.when(F.col("bad"), F.lit(None)).when(get("edited").isNull() | (get("edited") == "false"), "false").when((kind("edited") == "BOOLEAN"), "True").otherwise(get("edited"))
    cols["stickied"] = F.when(kind("stickied") == "BOOLEAN", get("stickied") == "true").when(get("stickied").isNotNull(), ~get("stickied").isin("", "0", "0.0"))
    cols["_source_file"] = F.col("_source_file")
    return rows.select(*[cols[c].alias(c) for c in DUMP_COLUMNS], "bad")


def write_zst(rows: DataFrame, folder: str) -> list[str]:
    """Write one zstd NDJSON file per ``_source_file`` in ``folder``; returns the names. Each file is replaced whole when done."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        name = os.path.join(local_path(folder), key[0])
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name + ".tmp", "wb") as f, zstandard.ZstdCompressor().stream_writer(f) as z:
            for line in part["line"]:
                z.write(line.encode() + b"\n")
        os.replace(name + ".tmp", name)
        return pd.DataFrame({"path": [name]})

    line = F.to_json(F.struct(*[c for c in DUMP_COLUMNS if c != "_source_file"]), {"ignoreNullFields": "false"})
    files = rows.select("_source_file", line.alias("line")).groupBy("_source_file").applyInPandas(run, "path string")
    return sorted(r["path"] for r in files.collect())


def write_parquet(rows: DataFrame, path: str, *partitions: str) -> None:
    """Columnar output, zstd, committed whole."""
    w = rows.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL, gzip or plain, under an explicit schema; a narrow schema prunes while parsing. Blank and cut-off lines are dropped."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("_corrupt is null").drop("_corrupt")


def write_jsonl(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """JSONL with nulls kept; ``gzip`` for lean copies."""
    w = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.option("compression", "gzip") if gzip else w).json(path)
