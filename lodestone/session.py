"""Session settings, table access, and the package's way to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(app: str = "lodestone", master: str | None = None, cpus: int = 8) -> SparkSession:
    """A session with the settings the queries assume; on a cluster, master and memory come from spark-submit."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        b = b.master(master).config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g")
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (the driver serves the archive to all executors)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors share: the one spark.checkpoint.dir names; only where that is unset and
    the master is local, as in tests, a local one; on a cluster that is an error.

    The setting is read from the session and never changed when present."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), f"lodestone-{uuid.uuid4().hex}"))
    return sc.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
