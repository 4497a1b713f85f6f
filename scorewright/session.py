"""Where intermediate tables live.

Results that must stay identical between two passes (a ranked layout, a
first-phase search result) are written as Parquet under the folder the cluster
names in ``spark.checkpoint.dir``.  A written table survives executor loss and,
unlike an RDD checkpoint, keeps column pruning and filter pushdown.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark's setting by which the shuffle files of an execution go when it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str] = {}
# Folders of the open ``intermediates`` blocks, the innermost last.
_open_blocks: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediates; never machine-local on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    already_set = context._jsc.sc().getCheckpointDir()
    if already_set.isDefined():
        return already_set.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="scorewright-")
    return _local_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    app = spark.sparkContext.applicationId
    folder = _open_blocks[-1] if _open_blocks else f"{shared_folder(spark)}/scorewright/{app}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside go when the block ends, also on failure.

    Frames that read them have to be written or collected inside.  Blocks nest; one
    driver thread uses them at a time.
    """
    folder = new_path(spark, "run")
    _open_blocks.append(folder)
    try:
        yield folder
    finally:
        _open_blocks.remove(folder)
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of executions inside go when these end, not when the driver's garbage does."""
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so later passes see the same rows.

    The shuffles behind it are not needed any more and go at once.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with _shuffles_go(spark):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written; the intermediate tables it wrote go then."""
    path = new_path(spark, name)
    with intermediates(spark):
        return materialise(make(), name, path)


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table over all cores, where its files give fewer parts than that.

    Only for CPU-heavy work on a plain scan: counting its parts then runs nothing,
    and a table with so few parts is small enough to move.  Larger ones stay as
    they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
