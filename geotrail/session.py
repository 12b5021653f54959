"""Session helpers that do not depend on where Spark runs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "geotrail") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GEOTRAIL_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once per session, unless their search path has it already.

    Python workers import the operators' functions by name; on a cluster they run on other machines, in other folders.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if getattr(context, "_geotrail_shipped", False):
        return
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        # Spark serves the file from here as long as the session lasts.
        folder = tempfile.mkdtemp(prefix="geotrail-code-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, f"geotrail_code_{os.getpid()}_{context.startTime}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(package):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
        context.addPyFile(path)
    context._geotrail_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for ``checkpoint()``: the one the cluster names in ``spark.checkpoint.dir``.

    Only on one machine, as in tests, a folder of our own is made where that setting is absent; it goes with the process. On a cluster
    its absence is an error, as each machine's own disk would not survive it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if named:
            context.setCheckpointDir(named)
        elif not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        else:
            folder = tempfile.mkdtemp(prefix="geotrail-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
            context.setCheckpointDir(folder)
    own = context._jsc.sc().getCheckpointDir().get()
    _gone_at_the_end(spark, own)
    return named or own


def results_dir(spark: SparkSession) -> str:
    """Where results are kept that several questions of one application share: in the shared folder, under the application's own name."""
    folder = f"{ensure_checkpoint_dir(spark)}/geotrail-results-{spark.sparkContext.applicationId}"
    _gone_at_the_end(spark, folder)
    return folder


def _gone_at_the_end(spark: SparkSession, folder: str) -> None:
    """Has a folder of this application's own removed when it ends."""
    context = spark.sparkContext
    known = context.__dict__.setdefault("_geotrail_folders", set())
    if folder not in known:
        known.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        # Only what is there can be marked.
        fs.mkdirs(path)
        fs.deleteOnExit(path)


def is_small(df: DataFrame, most_bytes: int = 64 * 1024 * 1024) -> bool:
    """Whether the optimizer's estimate of the size of ``df`` is at most ``most_bytes``."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= most_bytes


def small_side(df: DataFrame, most_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """``df`` with a broadcast hint if it ``is_small``; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, most_bytes) else df


def free_name(taken, wish: str) -> str:
    """A column name near ``wish`` that none of ``taken`` has."""
    low = {t.lower() for t in taken}
    name = wish
    while name.lower() in low:
        name = "_" + name
    return name
