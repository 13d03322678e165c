"""What the operators share: tables in the shared folder, words, and Arrow passes over texts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a worker remembers at a time for one purpose; workers live on from operator to operator.
MEMO = 1 << 17

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local master gets a temporary one; a cluster must name its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


@lru_cache
def own_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='tellurix-')}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage and survives the loss of any executor. `drop` frees tables that are no longer
    needed; the rest, such as the one behind the operator's result, go when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.paths, self.number = spark, {}, count()
        self.base = f"{shared_folder(spark)}/tellurix/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}-{next(self.number)}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t))
            delete(self.spark, path)

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*[t for t, _ in list(self.paths.values()) if all(t is not k for k in kept)])

    def close(self) -> None:
        try:
            delete(self.spark, self.base)
        except Exception:  # the session has ended before this; the folder is the cluster's to clean
            pass


def row_key(*columns: str) -> Column:
    """A digest of a row's values, nulls told apart: rows with the same one are alike in these columns."""
    return F.md5(F.concat_ws("\0", *[F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns]))


def n_words(text: Column) -> Column:
    """Words of a whole text; 0 of a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """`f` over Arrow batches. Batches hold few rows, as a text may be very long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                yield f(b.slice(at, 1000))

    return df.mapInArrow(run, schema)


def record_batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which the smallest of them are as good as a random choice."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from those of the words."""
    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mixed(out)


def long_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """A list column of 64-bit numbers, without a Python object for each."""
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.array([], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))
