"""Writing intermediate tables where every executor can read them, and dropping them when they are used up."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Paths that stand, with the session that wrote each, oldest first.
_written: dict[str, SparkSession] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. One of our own only on a single machine: other executors could not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if not _written:
        atexit.register(sweep)
    _written[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _path_of[out] = path
    return out


def standing() -> set[str]:
    """Paths of the tables that have been written and not been dropped."""
    return set(_written)


def drop(paths: set[str]) -> None:
    """Delete tables, and let Spark's cleaner find the shuffle files that were read to write what came after them."""
    for path in paths & set(_written):
        spark = _written.pop(path)
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            if not paths & set(_written):
                spark.sparkContext._jvm.System.gc()
        except Exception:  # noqa: BLE001  the session may have ended first; the folder is the cluster's to clean then
            return


def free(*frames: DataFrame) -> None:
    """Delete tables that settle() returned; all that reads them must have been written."""
    drop({path for f in frames if (path := _path_of.pop(f, None))})


def sweep() -> None:
    """Delete all that is left; called when the driver ends."""
    drop(standing())


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """The frame, with measures that are taken while it is written, such as rows and characters; no job of their own. They can be read after the write."""
    watch = Observation(name)
    return df.observe(watch, *[c.alias(k) for k, c in measures.items()]), watch


def ranges(df: DataFrame) -> int:
    """Into how many ranges a total order is cut: as many as the cluster shuffles to, and one for each core at least."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
