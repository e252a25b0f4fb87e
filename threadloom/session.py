"""Spark session and lineage-cutting helpers shared by every operator."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "threadloom") -> SparkSession:
    """Session for tests, bench and interactive use on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, from ``spark.checkpoint.dir``.

    Only where the setting is missing and the master is a single local JVM is a
    temporary folder used; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="threadloom-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir() or made


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The table survives lost executors, is read once per use instead of being
    recomputed, and is deleted when the driver exits.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark).rstrip('/')}/threadloom-{uuid.uuid4().hex}/{name}"
    _dropped_at_exit(spark, path)
    return path


def _dropped_at_exit(spark: SparkSession, path: str) -> None:
    if not _STAGED:
        atexit.register(drop_staged)
    _STAGED.append((spark, path))


def drop_staged() -> None:
    """Delete every folder that this process wrote to the shared folder."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)
        except Exception:  # noqa: BLE001 - the session is already gone
            continue


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, from the shared folder: they need no installed copy."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    folder = f"{shared_dir(spark).rstrip('/')}/threadloom-{uuid.uuid4().hex}"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{root.name}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    _dropped_at_exit(spark, path.toString())
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_table(sf_dir: str, name: str) -> bool:
    return Path(f"{sf_dir}/{name}.parquet").exists()
