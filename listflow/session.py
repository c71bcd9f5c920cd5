"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites per column expression are for debugging; rule tables make many expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str | int = "*", memory: str = "8g", shuffle_partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and the benchmark, with ``shared`` as its working folder. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("listflow")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, one per
    application: on a cluster, executors could not read one machine's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.get(spark.sparkContext.applicationId)
        if base is None:
            base = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="listflow-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Working folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def read_at_session_time(spark: SparkSession) -> None:
    """Timestamps without a zone are read as UTC everywhere in this package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
