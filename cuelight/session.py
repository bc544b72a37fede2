"""Session helpers shared by every query: table loading and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once a session, unless their path has it already."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = os.path.join(tempfile.mkdtemp(), "cuelight_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "cuelight").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder (a file or a folder of parts)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session's setting. Only a local session without the setting gets a local one; a
    cluster must name a folder that all its executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cuelight-checkpoint"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with their lineage cut at a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
