"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")

# Settings the operators are planned for. Nothing here is needed for right
# results: a session built elsewhere gives the same rows.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

_local_roots: dict[str, str] = {}


def build_session(app: str = "polderlake", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing_by_cores(spark: SparkSession) -> Iterator[None]:
    """Folders that are opened within are listed by a few tasks for each core.

    Spark's default is a task for each folder, up to 10,000, and a task costs far more than the
    listing of a folder. The setting only deals the folders, so it changes no result.
    """
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), max(32, 4 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a temporary folder; on a cluster such a folder would live on
    one machine, so there the missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = _local_roots.setdefault(
            sc.applicationId, tempfile.mkdtemp(prefix="polderlake-"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application staged below the shared scratch folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(
        f"{scratch_root(spark)}/polderlake/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared scratch folder."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/polderlake/{app}/{label}-{uuid.uuid4().hex[:12]}"


def side_by_side(spark: SparkSession, calls: Sequence[Callable[[], T]]) -> list[T]:
    """Results of calls that do not depend on each other; their Spark jobs share the cores.

    All are waited for before the first failure, in the order of the calls, is raised.
    """
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]
    return [r.result() for r in running]
