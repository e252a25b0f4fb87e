"""Row-group probe of Parquet files: evenly spaced groups instead of a full scan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.ndjson import local_path


def picked(groups: int, wanted: int) -> list[int]:
    """Evenly spaced row groups, first and last included."""
    return sorted({int(i * (groups - 1) / max(wanted - 1, 1)) for i in range(wanted)}) if groups else []


def probe(spark: SparkSession, files: list[str], wanted: int = 8, rows_cap: int = 2_000_000) -> DataFrame:
    """``path, subreddit, rows_total, rows, contr`` over the probed groups of each file, a file per task.

    Reading stops after the group that reaches ``rows_cap``; that cap is the feature.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            for name in batch["path"]:
                f = pq.ParquetFile(local_path(name))
                seen, parts = 0, []
                for g in picked(f.metadata.num_row_groups, wanted):
                    t = f.read_row_group(g, columns=["subreddit", "controversiality"]).to_pandas()
                    parts.append(t)
                    seen += len(t)
                    if seen >= rows_cap:
                        break
                if parts:
                    t = pd.concat(parts).groupby("subreddit", dropna=False)["controversiality"].agg(["size", "sum"]).reset_index()
                    yield pd.DataFrame({"path": name, "subreddit": t["subreddit"], "rows_total": f.metadata.num_rows, "rows": t["size"], "contr": t["sum"].fillna(0).astype("int64")})

    names = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)))
    return names.mapInPandas(run, "path string, subreddit string, rows_total bigint, rows bigint, contr bigint")


def rates(probed: DataFrame) -> DataFrame:
    """Per file: sampled rows, share of the file, share controversial (0 without rows)."""
    return probed.groupBy("path").agg(F.max("rows_total").alias("rows_total"), F.sum("rows").alias("rows_sampled"), F.coalesce(F.try_divide(F.sum("contr").cast("double"), F.sum("rows")), F.lit(0.0)).alias("contr_rate")).withColumn("sample_frac", F.coalesce(F.try_divide(F.col("rows_sampled").cast("double"), "rows_total"), F.lit(0.0)))
