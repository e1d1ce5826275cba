"""The session, and tables written to the folder all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_made: list[tuple[SparkSession, str]] = []


def session(app: str = "alembiq", **conf: str) -> SparkSession:
    """A session with adaptive execution; settings given as keywords with dots written as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may lack it (tests), and gets a folder of its own."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own = _own or f"file://{tempfile.mkdtemp(prefix='alembiq-')}"
        found = _own
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table or set of files; removed when the driver ends."""
    path = f"{shared_folder(spark)}/alembiq/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, and survives lost executors.

    ``instead`` is a result of this function that only ``df`` still needed; its files are removed.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    if instead is not None:
        remove_written(instead)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def remove_written(*results: DataFrame) -> None:
    """Remove the files of results of ``checkpointed`` that nothing reads any more."""
    for df in results:
        remove(df.sparkSession, df._written_to)


@atexit.register
def clean_up() -> None:
    """Remove all intermediate tables and files; call it when no DataFrame that reads them is needed any more. Runs when the driver ends."""
    while _made:
        spark, path = _made.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the shared folder's owner cleans up then
            return
