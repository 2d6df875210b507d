"""Session set-up and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where that is unset (tests, notebooks on one machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str, suffix: str = "") -> str:
    """A new path in the shared folder; what is put there is removed when the Python driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}{suffix}"
    _MADE.append((spark, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage like ``checkpoint()``, yet keeps column pruning, statistics and a compact form on disk.
    The files are removed when the Python driver ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"staged-{label}")
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for a session; they may have no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_sent", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._ledgerloom_sent = True


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`staged`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _MADE:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone already
            return
