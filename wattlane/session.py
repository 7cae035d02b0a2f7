"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "wattlane") -> SparkSession:
    """Build (or reuse) a session with AQE, UTC and no web UI.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then come from the cluster config.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master and master.startswith("local"):
        # Local runs only: the driver JVM is the executor. On a cluster the
        # deployment sets memory.
        b = b.config("spark.driver.memory", os.environ.get("WATTLANE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_dir(spark)
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Uses ``spark.checkpoint.dir`` from the session (the cluster's shared
    folder). Only where it is unset and the master is local (one machine,
    as in tests) a fresh folder under /tmp is created and registered; on a
    cluster executors would each write to their own disk and later reads
    would miss rows, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif not is_local(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wattlane-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def is_local(master: str) -> bool:
    """Driver and executors are one process on one machine."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path inside the shared scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "stage"):
    """Write ``df`` as a parquet table in the shared scratch folder and read
    it back: cuts the lineage (small plans, no recomputation after an
    executor loss) and fixes every value computed so far."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: dict[str, list[str]] = {}


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote in this application.
    For the caller who has read all results that need them; returns how
    many there were."""
    jvm = spark.sparkContext._jvm
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    return len(paths)


def local_path(p: str) -> str:
    return p[len("file:"):] if p.startswith("file:") else p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's FileSystem so it works on any store."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wattlane`` importable in the Python workers (needed by the
    operators that run pandas code in tasks): zip the package once per
    application and register it with ``addPyFile``."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="wattlane-pkg-"), "wattlane.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
