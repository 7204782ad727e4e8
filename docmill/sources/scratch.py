"""Tables that a job writes once and reads several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. A session on one machine that names none gets
    a folder of its own, which goes when Python ends; on a cluster it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="docmill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what it takes to make its rows runs once, whatever reads them, and
    filters and columns of the readers stay on this side of it. Its folder is ``table.written_to``."""
    path = f"{shared_folder(df.sparkSession)}/docmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(table: DataFrame) -> None:
    """Remove a table of ``written_once`` that no plan reads any more."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
