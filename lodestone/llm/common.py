"""Intermediate tables in the cluster's shared folder, Arrow batches, and small helpers the operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch on its way to a worker: a batch stands in the JVM, in the worker and in its results at once.
BATCH_BYTES = "6m"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's setting by which a query's shuffle files go when it is done, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.  Only a local session without one gets a temporary one: on a cluster
    executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffles it took are deleted; what release() doesn't delete before goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"
    with _without_shuffles(spark):
        df.write.parquet(path)
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


@contextlib.contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run within leave no shuffle files, unless the session says otherwise."""
    said = spark.conf.get(_CLEANUP, None)
    if said is None:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if said is None:
            spark.conf.unset(_CLEANUP)


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def in_batches(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_BYTES, unless the session says otherwise: whole texts are large rows."""
    conf = df.sparkSession.conf
    if conf.get(_BYTES, None) in (None, "67108864b"):
        conf.set(_BYTES, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def release(*frames: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lodestone_path", None)
        if path:
            _file_system(df.sparkSession, path).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, for bodies that use it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
