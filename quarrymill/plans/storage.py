"""Cutting lineage in iterative plans, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from the checkpoint folder from now on; survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
            path = tempfile.mkdtemp(prefix="quarrymill-cut-")
        sc.setCheckpointDir(path)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed: the driver serves it to executors."""
    sc = spark.sparkContext
    if not getattr(sc, "_quarrymill_shipped", False):
        package = Path(__file__).resolve().parents[1]
        with tempfile.NamedTemporaryFile(prefix="quarrymill-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(f.name)
        atexit.register(lambda: Path(f.name).unlink(missing_ok=True))
        sc._quarrymill_shipped = True
