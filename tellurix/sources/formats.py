"""Reading and writing files with a declared schema. Text formats are never inferred: that would read them twice."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A file or folder of any of FORMATS. CSV and JSON need a schema; bad fields become null (mode PERMISSIVE)."""
    if kind not in FORMATS:
        raise ValueError(f"{kind}: not one of {', '.join(FORMATS)}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None and kind != "text" else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write `df`, in folders by the columns `by`; rows of a folder are first brought together, so that it gets few files."""
    if kind not in FORMATS:
        raise ValueError(f"{kind}: not one of {', '.join(FORMATS)}")
    out = df.hint("rebalance", *by) if by else df
    writer = out.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}))
    (writer.partitionBy(*by) if by else writer).save(path)


def stream(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "parquet", files_per_batch: int | None = None, names: str = "*") -> DataFrame:
    """Files of the pattern `names` as they come into a folder, oldest first by modification time."""
    options = {"pathGlobFilter": names} | ({"maxFilesPerTrigger": str(files_per_batch)} if files_per_batch else {})
    return spark.readStream.format(kind).schema(schema).options(**options).load(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir); a local master may do without, as it
    has no other machines. The folder goes when the driver's Python ends."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = f"file://{tempfile.gettempdir()}"
    folder = f"{base.rstrip('/')}/tellurix/{uuid.uuid4().hex}"
    atexit.register(delete, spark, folder)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before; the folder is the cluster's to clean
        pass


def made(spark: SparkSession, folder: str) -> None:
    """Makes a folder, unless it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def kept(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: its rows are then fixed, and survive the loss of any executor."""
    folder = shared_folder(df.sparkSession)
    write(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
