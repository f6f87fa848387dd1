"""Session construction and lineage control.

On a cluster the session is built by the platform; library code only reads
its settings. ``build_session`` is for tests, the bench and local use.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "kiln", driver_memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only when nothing is
    configured and the master is local (tests) a fresh scratch folder is created.
    Executors on other machines cannot see such a folder, so a cluster must name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="kiln-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str = "step", schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back (under ``schema``, if given).
    For loops: a checkpoint is computed twice, and it hands the plan's constraints on, which grow with every join."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()  # fits run in several threads, and Spark fails on a file that is being added


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that functions run there
    find their modules whatever path the driver was started with."""
    sc = spark.sparkContext
    with _SHIPPING:
        if sc.applicationId in _SHIPPED:
            return
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="kiln-code-"), "kiln_code.zip")  # read by the driver alone
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("kiln", os.path.relpath(full, top)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
