"""Session settings and the shared folder for intermediate tables."""

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter's settings apply."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("viewmart")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # A layer job compiles more classes than the default cache of 100 holds.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in ADAPTIVE_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A local master may fall back on a temporary folder, since driver and executors are one
    process there. A cluster without the setting is an error: a machine-local folder would
    be lost with the machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="viewmart-"))
        folder = context.getCheckpointDir()
    if folder.startswith("file:") and not context.master.startswith("local"):
        raise ValueError(f"{folder} is local to each machine; name a folder that all executors share")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, deleted when the enclosing ``scratch`` block or the program ends."""
    path = f"{shared_dir(spark)}/viewmart/{label}-{uuid.uuid4().hex}"
    _paths.get().append((spark, path))
    return path


def _delete(made: list[tuple[SparkSession, str]]) -> None:
    while made:
        spark, path = made.pop()
        # PySpark has no public call that deletes a folder of any file system.
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)


def _delete_last(made: list[tuple[SparkSession, str]]) -> None:
    try:
        _delete(made)
    except Exception:  # noqa: BLE001 - the JVM may be gone before the program ends
        pass


_program: list[tuple[SparkSession, str]] = []
_paths: ContextVar[list[tuple[SparkSession, str]]] = ContextVar("paths", default=_program)
atexit.register(_delete_last, _program)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where a result feeds several later steps. The copy cuts the lineage, outlives lost
    executors, and its file sizes tell the optimizer how large the table really is.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_folder`` before its block ends; nothing may read it later."""
    _delete([(spark, path)])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables settled inside the block when it ends; nothing may read them later.

    Each thread and task has its own block, so jobs that run side by side keep their tables.
    """
    made: list[tuple[SparkSession, str]] = []
    before = _paths.set(made)
    try:
        yield
    finally:
        _paths.reset(before)
        _delete(made)
