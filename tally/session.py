"""Session construction and the shared scratch location.

Cluster jobs take their scratch space from ``spark.checkpoint.dir`` (a
shared, fault-tolerant folder named by the cluster).  Only when it is unset
(local runs and tests) do we create one under the system temp dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins and partition counts at
# runtime, splits skewed shuffle partitions, and coalesces small ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_SHIPPED: dict[str, str] = {}


def get_spark(app: str = "tally", cpus: int | str | None = None, shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if cpus is not None:  # tests and bench; a cluster's submit command names its own master
        builder = builder.master(f"local[{cpus}]")
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("TALLY_DRIVER_MEMORY", "8g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    Reads ``spark.checkpoint.dir`` from the session; sets a local one only
    when the session has none and runs in one process (as in tests); on a
    cluster a local folder would lose data, so that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="tally-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", root)
        except Exception:  # noqa: BLE001 - core confs may be read-only at runtime
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application, so
    that functions of its modules run there whatever the workers' path is."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tally-package-"), "tally-package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(target)
    _SHIPPED["app"] = sc.applicationId


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the checkpoint root."""
    return f"{checkpoint_root(spark)}/tally-{name}-{uuid.uuid4().hex[:12]}"
