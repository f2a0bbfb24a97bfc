"""Session settings and reliable materialisation."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One source file may be 1 MB, so Arrow batches are bounded by bytes; narrow rows
# still travel in large batches.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; cluster sizing is left alone.

    Also ships this package to the Python workers, which need not share the
    driver's working folder.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    _ship(spark.sparkContext.applicationId)
    return spark


@cache
def _ship(_application: str) -> None:
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lintlake-")
    archive = shutil.make_archive(f"{folder}/lintlake", "zip", package.parent, package.name)
    SparkSession.active().sparkContext.addPyFile(archive)


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lintlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    Only when none is configured (a local test session) is a temporary one made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = _test_folder()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return folder.rstrip("/")


@cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="lintlake-")


_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``materialize`` has written inside; for work whose result is stored by then."""
    token = _written.set([])
    try:
        yield
    finally:
        paths = _written.get()
        _written.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            where = hadoop(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several branches read an expensive result (the parsed facts).
    A Parquet table survives lost executors and, unlike a cached or
    checkpointed frame, lets every branch read only its own columns. Small
    tables also get a known size, which join planning goes by. All tables of
    an application lie in one folder, to be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lintlake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a small input at least one partition per core.

    For plain scans only, whose partitions are known without running anything.
    A small table may be a single file; a large one already has more
    partitions than there are cores and is returned untouched, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Rows of a clustered table in one task, few enough that what is made of them is sorted in memory.
CLUSTER_ROWS = 250_000
#: Rows of one key that one task may take; of a table with a larger key nothing is clustered.
CLUSTER_KEY_ROWS = 100_000


def clustered(scan: DataFrame, key: str) -> DataFrame:
    """Exchange a plain scan by ``key`` while its rows are narrow.

    Steps by that key need no exchange of the texts that are made of the rows
    later. Keys are counted first: a table in which one has more rows than a
    task should take is only spread, and each step exchanges what it needs. The
    number of partitions follows the rows, as their bytes do not show what they
    become; unless rows are few, they are as many as other exchanges have, or
    joins by the key would move these rows again instead of the other side.
    """
    spark = scan.sparkSession
    found = scan.groupBy(key).count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    if (found["most"] or 0) > CLUSTER_KEY_ROWS:
        return spread(scan)
    rows = found["rows"] or 0
    usual = min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 10_000)
    return scan.repartition(max(spark.sparkContext.defaultParallelism, usual, -(-rows // CLUSTER_ROWS)), key)
