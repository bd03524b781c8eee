"""Session helpers: a tuned session for local runs, and tables written to the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fathomline")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one named by spark.checkpoint.dir; what it holds is deleted when
    Python ends. Only a local session may do without the setting and then has a temporary folder; on a
    cluster the machines would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    own = f"{base.rstrip('/')}/fathomline-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_delete, spark, own)
    return own


_OWN: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder that materialize wrote to, if the session is still there."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the cluster cleans its folder
        return


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: results survive lost executors, and
    several readers don't compute it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_below(df: DataFrame, most_bytes: int) -> DataFrame:
    """With the broadcast hint if the rows, counted with their texts' lengths, take at most ``most_bytes``;
    else as it is. ``df`` is read for it, so it should be a written table."""
    parts = [F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(16) for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    size = df.agg(F.sum(sum(parts, F.lit(32))).alias("size")).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
