"""Where intermediate tables live.

Long jobs are cut by writing Parquet into the folder that all executors and
the driver share (``spark.checkpoint.dir``): a lost executor then costs a
re-read, never a recomputation of everything before it. What a loop has
replaced is removed at once, everything else of the application when the
driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local one is set only where none is configured and all runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="veldra-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _remove_all() -> None:
    for root, spark in _roots.items():
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            _remove(spark, root)


def new_path(spark: SparkSession, name: str) -> str:
    root = f"{shared_dir(spark)}/veldra-{spark.sparkContext.applicationId}"
    _roots.setdefault(root, spark)
    return f"{root}/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str = "stage", instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, with its lineage cut; ``instead_of`` is a staged table that is not read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if instead_of is not None:
        _remove(spark, instead_of.staged_path)
    return out
