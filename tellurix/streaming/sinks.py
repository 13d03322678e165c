"""Where streams end: tables that survive a restart, and stay right when a batch comes twice."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tellurix.sources import formats

Parts = Callable[[DataFrame, int], Mapping[str, DataFrame]]


def to_parquet(df: DataFrame, folder: str) -> StreamingQuery:
    """Appends what the stream has now to the Parquet table `folder`/rows. Its log names the files of each batch that is
    done, so a batch that failed half way, or comes again, leaves no rows twice."""
    out = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    return out.trigger(availableNow=True).start()


def by_batch(df: DataFrame, folder: str, parts: Parts, mode: str = "append") -> StreamingQuery:
    """Writes the tables that `parts` makes of each batch and its id, as `folder`/<name>/batch=<id>. A batch that comes again
    overwrites what it wrote before, so it adds nothing as long as `parts` gives the same rows for the same batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # each part reads it
        try:
            for name, rows in parts(batch, number).items():
                formats.write(rows, f"{folder}/{name}/batch={number}", mode="overwrite")
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def rows(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """A sink's table; empty if nothing was written yet."""
    formats.made(spark, folder)
    return spark.read.schema(schema).parquet(folder)


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch that has one: the state of a table of updates."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def late_apart(time: str, late: str, folder: str) -> Parts:
    """For `by_batch`: rows that are older than the newest of all earlier batches by more than `late` go to the table `late`,
    the others to `on_time`, and none vanishes. The newest time of each batch is kept beside them, so a replayed batch is split as
    it was before. Rows without a time are on time."""

    def parts(batch: DataFrame, number: int) -> Mapping[str, DataFrame]:
        spark, kind = batch.sparkSession, batch.schema[time].dataType.simpleString()
        newest = rows(spark, f"{folder}/newest", f"newest {kind}, batch long").where(F.col("batch") < number).agg((F.max("newest") - F.expr(f"interval {late}")).alias("limit"))
        limit = newest.first().limit
        behind: Column = F.coalesce(F.col(time) < F.lit(limit).cast(kind), F.lit(False))
        return {"on_time": batch.where(~behind), "late": batch.where(behind), "newest": batch.agg(F.max(time).alias("newest"))}

    return parts


def fed(arrivals: Iterable[DataFrame], folder: str, start: Callable[[DataFrame], StreamingQuery]) -> list[StreamingQuery]:
    """Puts one table of rows after another into `folder`/in, each time running the stream over it to its end: it goes on from
    its checkpoint as after a restart. Each table is one batch."""
    runs = []
    for df in arrivals:
        formats.write(df, f"{folder}/in", mode="append")
        runs.append(start(formats.stream(df.sparkSession, f"{folder}/in", df.schema)))
        runs[-1].awaitTermination()
    return runs
