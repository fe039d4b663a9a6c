"""What the operators of this subpackage share: tables, words, storage that survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.plans.storage import ship

#: ASCII white space: what separates words.
SPACES = r"[ \t-\r]+"
CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (local mode)."""
    if not (path := spark.conf.get(CHECKPOINT_DIR, None)):
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the cluster shares")
        path = getattr(sc, "_quarrymill_dir", None)
        if path is None:
            path = sc._quarrymill_dir = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
            atexit.register(_remove, path)
    return path


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), where workers can import this package even if it isn't installed there."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mixed(x):
    """A bijection of 64-bit integers that spreads their bits (the finaliser of splitmix64)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def discarded(df: DataFrame, part: str = "") -> None:
    """Removes a stored table, or a part of it, that no later step reads; lets go of the files of finished shuffles."""
    spark = df.sparkSession
    jvm, sc = spark._jvm, spark.sparkContext
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if not part else {f.split(f"/{part}/")[0] + "/" + part for f in df.inputFiles() if f"/{part}/" in f}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    released(spark)


def released(spark: SparkSession) -> None:
    """Lets go of the files of finished shuffles, which Spark removes once the driver has collected what refers to them.

    The first collection can leave some that a listener still holds; the second one finds them.
    """
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.3)


def stored(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts the lineage, outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrymill-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
