"""Session construction with the settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "tidemark", **extra: str) -> SparkSession:
    """A single-machine session for tests and benches."""
    conf = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores if str(cores).isdigit() else 8),
        "spark.driver.memory": os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's spark.checkpoint.dir where it is set. Only a session on one machine
    (tests) may go without; it gets a temporary folder. On a cluster an unset one is refused."""
    from_conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not from_conf and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    folder = from_conf or tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder
