"""Sessions, input tables and staged intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def session(app: str = "millrace", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster, pass your own session instead."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one where none is named and all runs on one machine (tests)."""
    found = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_STAGED: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = os.path.join(shared_dir(spark), "millrace", f"{name}-{uuid.uuid4().hex}")
    _STAGED.append((spark, path))
    return path


@contextmanager
def staged_scope() -> Iterator[None]:
    """What is staged within is deleted at the end; a result must be written, or collected, before."""
    begin = len(_STAGED)
    try:
        yield
    finally:
        for spark, path in _STAGED[begin:]:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        del _STAGED[begin:]


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and the table outlives lost executors.

    Unlike checkpoint(), the copy is columnar and compressed, so that later steps read only what they need, and the
    optimizer knows its size. An empty df keeps its schema.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input that are worth a task of their own where rows are worked on in Python.
TASK_BYTES = 4 << 20


def spread(df: DataFrame, key: str | Column, of: DataFrame | None = None) -> DataFrame:
    """df in as many partitions as there are cores, for work in Python, if its input (``of``) is so small that Spark makes fewer; else df as it is.

    Small files, and small results of a shuffle, are packed into one task, which is right for work that takes no longer than the
    reading. Only the layout depends on it.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str((df if of is None else of)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n, key) if size < n * TASK_BYTES else df


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, for where it isn't installed on the executors. Once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "millrace.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._millrace_shipped = True
