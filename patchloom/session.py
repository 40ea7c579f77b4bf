"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cpus: int | str = 8, app: str = "patchloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cores = int(cpus) if str(cpus).isdigit() else 8
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that lives in the plan itself, so reading it needs no job."""
    types = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(types)
    arrow = to_arrow_schema(types)
    table = pa.table({f.name: pa.array(c, f.type) for f, c in zip(arrow, columns)}, schema=arrow)
    return spark.createDataFrame(table, types)


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may do without the setting: its one machine then lends a
    temporary folder. Elsewhere executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _test_dir(spark.sparkContext.master)
    return f"{base.rstrip('/')}/patchloom-{uuid.uuid4().hex}"


@cache
def _test_dir(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="patchloom-")


_WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it as parquet to the shared folder.

    The table survives lost executors, and later reads of it are cheap scans
    with column pruning and filter pushdown. ``drop_written`` deletes such tables.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_count() -> int:
    """How many tables are ``written`` and not dropped."""
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int = 0, last: int = 0) -> int:
    """Delete the tables ``written`` so far, when no result that reads them is needed any more.

    The first ``since`` tables and the ``last`` newest ones stay.
    """
    gone, end = 0, max(len(_WRITTEN) - last, since)
    for place in _WRITTEN[since:end]:
        path = hadoop_path(spark, place)
        gone += file_system(spark, path).delete(path, True)
    del _WRITTEN[since:end]
    return gone


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="patchloom-ship-")) / "patchloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
