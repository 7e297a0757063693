"""Session helpers.

A cluster hands us a configured session; we only fill gaps that local runs
(tests, bench) leave open. Nothing here overrides a value the cluster set.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Settings that matter for every plan in this package. Applied only when the
# session does not already carry a value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "vigil") -> SparkSession:
    """A local session for tests and the bench; the UI stays off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the platform and read from the
    session. Only when it is unset (local tests) a fresh scratch folder is
    created and registered.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="vigil-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint_subdir(spark: SparkSession, name: str) -> str:
    """A named folder under the shared checkpoint root (streaming state, cut lineage)."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package wrote, in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialize` writes inside go at the end: for steps of a stream that never ends."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove_path(spark, path)


def materialize(df, name: str, by: str | None = None):
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor does not recompute the upstream plan)
    and gives the planner the real on-disk size of the result, so a later
    join picks a broadcast only when the data is provably small. ``by``: a
    column to write in folders, so that readers of one value read no other.
    """
    spark = df.sparkSession
    path = checkpoint_subdir(spark, f"{name}-{uuid.uuid4().hex}")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    # Later jobs of this application may read it; it goes when the application ends.
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    # The schema is known: reading it back needs no footer job.
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package (pandas UDFs, keyed streaming state).

    Workers unpickle those functions by module reference. The package's modules are
    zipped once per application on the driver and registered with
    ``SparkContext.addPyFile``: Spark itself hands that file to every executor, so
    neither a shared folder nor ``--py-files`` is needed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="vigil-py-"))
    zpath = os.path.join(folder, f"{os.path.basename(pkg)}.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
