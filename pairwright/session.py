"""What a job needs of its session: the shared folder and tables kept there."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this application.

    It is the one that ``spark.checkpoint.dir`` names. Only a local session that names none
    (tests) gets a new temporary folder; on a cluster that is an error, as machines do not share
    such folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pairwright-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as compressed Parquet and read again.

    This cuts the lineage and survives the loss of executors; the folder goes when the
    cluster clears its checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """``df``, which joins are to shuffle and not to send through the driver.

    Spark takes the size of compressed files for that of their rows, so that a table of millions of
    ids passes as small enough to broadcast.
    """
    return df.hint("merge")


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """``spark``, once its executors can import this package: it is sent to them as a zip file, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="pairwright-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        sc.addPyFile(str(target))
    return spark
