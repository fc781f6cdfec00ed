"""Tables in the folder that all executors share: they end a lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A task holds a whole row group of what it reads and of what it writes.
ROW_GROUP = 16 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one for local runs and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(shared_dir, "own"):
            shared_dir.own = tempfile.TemporaryDirectory(prefix="weft-shared-")
        folder = shared_dir.own.name
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted by release() or at the driver's end."""
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    The table stays until drop(), release() or the driver's end, since a lazily evaluated result may still read it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialize() returned; no result may read them any more."""
    paths = {t.stored_at for t in tables}
    for entry in [e for e in _written if e[1] in paths]:
        _written.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone; the folder's owner clears the rest
        return


@atexit.register
def release() -> None:
    """Delete all tables written so far; call it once their results are stored."""
    while _written:
        _delete(*_written.pop())
