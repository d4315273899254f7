"""Session helpers.

The library never hard-codes cluster paths. Anything that must be written
between stages (checkpoints, round-trip files, saved models) goes under the
shared folder the cluster names in ``spark.checkpoint.dir``. Only when that
setting is absent (local runs and tests) do we create a private temp folder
and register it as the checkpoint directory.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "vitalframe", driver_memory: str = "16g") -> SparkSession:
    """Build (or reuse) a session with the settings the library is tuned for.

    On a cluster, call this without ``master`` and let spark-submit decide.
    In local mode the executors live in the driver JVM, so ``driver_memory``
    is the only memory knob (it only applies when the JVM is started here).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", driver_memory)
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # The JVM never compiles a generated method above 8,000 bytes of bytecode:
        # let such stages fall back to smaller methods that it does compile.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; a private temp folder only in local mode.

    Outside local mode other nodes could not read a driver's folder, so a
    cluster without ``spark.checkpoint.dir`` is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    # Unset: local run or test. A private temp folder is fine here only.
    local = tempfile.mkdtemp(prefix="vitalframe-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root for stage outputs.

    It is removed when the application ends.
    """
    # the checkpoint folder is this application's own (Spark adds a unique name)
    base = os.path.join(checkpoint_root(spark), "vitalframe")
    target = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        fs.mkdirs(target)  # a path must exist to be marked
        fs.deleteOnExit(target)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
