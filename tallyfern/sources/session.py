"""Session-level facts the operators need: shared folder and checked broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster that has it not installed.

    Tasks name the package's functions instead of carrying them, so workers must be
    able to import it.
    """
    root = Path(__file__).resolve().parents[2]
    with tempfile.TemporaryDirectory() as folder:
        archive = Path(folder) / "tallyfern.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((root / "tallyfern").rglob("*.py")):
                out.write(file, file.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, read from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary
    folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tallyfern-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` evaluated once and marked for broadcast if it has at most
    ``max_rows`` rows.

    The check reads no more than ``max_rows + 1`` rows.  A larger table comes
    back as it is, and the join that uses it stays a shuffle join with AQE's
    skew handling.  Meant for narrow tables: the rows pass through the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
