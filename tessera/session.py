"""Session factory and the shared working folder of iterative jobs."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tessera", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("TESSERA_SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``; only where nothing is set (tests, one machine) a temporary
    folder of our own is made. A machine-local folder on a cluster would lose data with an executor, so a
    session that isn't local must have the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tessera-ship-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/tessera_package.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(at, name)
                    out.write(whole, os.path.relpath(whole, os.path.dirname(package)))
    context.addPyFile(f"{folder}/tessera_package.zip")
    _shipped.add(context.applicationId)


class Workspace:
    """Tables written to the shared folder, to cut lineage between the rounds of an iterative job.

    A table survives the loss of any executor. ``drop`` frees a table that no later plan reads; what a
    returned DataFrame still reads stays until the driver's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self._clean)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return a DataFrame that reads it back."""
        self._count += 1
        path = f"{self.root}/{name}-{self._count}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._tessera_path = path
        return back

    def counted(self, df: DataFrame, condition: str, name: str = "t") -> tuple[DataFrame, int]:
        """The same, and how many rows meet a condition, counted while they are written."""
        seen = Observation()
        back = self.table(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), name)
        return back, seen.get["n"]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_tessera_path", None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _clean(self) -> None:
        """At the end of the process, on any file system; if the session has ended, only where no session is needed."""
        where = urlparse(self.root)
        if where.scheme in ("", "file"):
            shutil.rmtree(where.path, ignore_errors=True)
        elif self.spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):
                self._delete(self.root)


def tasks(spark: SparkSession) -> int:
    """Partitions for stages whose work isn't in proportion to their bytes, which AQE would otherwise merge by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
