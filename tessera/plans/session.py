"""Session building and table access shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for (AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, each: int) -> DataFrame:
    """rows dealt by key over partitions of about so many rows.

    A file is read by as many tasks as it has row groups, and a shuffle has as many partitions as it is set to; either
    lets a task's time and memory grow with the table. Later groups and joins on the key need no shuffle of their own.
    """
    return rows.repartition(max(1, -(-rows.count() // each)), key)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tessera-ship-")
    archive = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in root.rglob("*.py"):
            z.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    A folder of this machine's own is taken only where the master is local, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = of_context.get() if of_context.isDefined() else None
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = f"file://{tempfile.gettempdir()}/checkpoints"
    return configured.rstrip("/")
