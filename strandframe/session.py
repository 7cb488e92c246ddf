"""Session settings the operators are designed for, and the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split over tasks; the other side holds one row per key.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where the join's partitioning is wanted above it: one more shuffle beats one hot task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Fixed when a session starts.
STARTUP_CONF = {
    # No call-site lookup per column expression: wide aggregates are built several times faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def apply_recommended(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a folder of its own: one per
    process, named in the setting from then on and removed at the end.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="strandframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return spark.conf.get("spark.checkpoint.dir")
