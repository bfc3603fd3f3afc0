"""Session helpers: table access, lineage cuts, and list-of-columns utilities shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the session at the cluster's shared checkpoint folder.

    The folder is the one in `spark.checkpoint.dir`; only where neither that setting nor a
    directory is set, and only on a local master, a temporary folder is used.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="scholion-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(shared)


#: Tables written by `cut`, to be removed at the end.
_tables: list[str] = []


def _remove(jvm, conf) -> None:
    """Deletes the tables of this driver; what cannot be reached any more stays with the folder."""
    try:
        for path in _tables:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001  # the JVM is gone
        pass


def cut(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the shared folder and read again.

    It is computed once, its lineage ends there, it survives lost executors, and unlike a plain
    checkpoint it is compressed. The table is removed when the driver's Python ends, since results
    may be read from it until then.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    _tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
