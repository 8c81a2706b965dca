"""Streams of events tagged and counted by quarter-hour; an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import floor_quarter


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of the one file at path."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def tag(events: DataFrame) -> DataFrame:
    return events.withColumn("quarter", floor_quarter(F.col("ts")))


def counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by quarter-hour and type; the watermark lets old groups' state go."""
    timed = events.withColumn("at", F.to_timestamp(F.col("ts"))).withWatermark("at", late)
    return timed.groupBy(F.window("at", "15 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, appended to Parquet; what was written before is not read again."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_new(batch: DataFrame, done: DataFrame, key: str = "run_key") -> DataFrame:
    """Rows of a batch whose run key hasn't been processed."""
    return batch.join(done.select(key), key, "left_anti")


def counts_once(stream: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> None:
    """counts() of all that is there now, the whole table written anew by each batch; a batch that is run again writes the same."""

    def write(df: DataFrame, _: int) -> None:
        df.select(F.col("w.start").alias("quarter"), "event_type", "n").write.mode("overwrite").parquet(path)

    counts(stream, late).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Ingest:
    """Rows of any number of streams and replays, each taken once by its key; what comes too late is kept apart.

    Under `path` each batch of a run has folders of its own: rows (taken in time), late (others that are new) and ledger (key and
    time of both). A batch takes the rows whose key no other batch's ledger has. A row is late if its time is more than
    `late` before the newest time of the batches before it. Folders are overwritten whole, the ledger last, so a batch that is run again after a
    lost driver gives the same, and a file that is read again, under this run's name or another, gives nothing. Only keys of the
    last `late` can be in time, so a batch in time is held against the ledger's end, which its files' statistics find; late rows, seldom, against
    all of it. Of rows with one key in a batch the earliest stays (of equal ones any); rows without key or time are left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str = "event_id", time: str = "ts", late: str = "1 day"):
        self.spark, self.path, self.key, self.time, self.late, self.schema = spark, path.rstrip("/"), key, time, late, schema
        kind = schema[key].dataType.simpleString()
        self.ledger_schema = f"`{key}` {kind}, at timestamp, run string, batch long"
        spark.createDataFrame([], f"`{key}` {kind}, at timestamp").write.mode("overwrite").parquet(f"{self.path}/ledger/run=none/batch=-1")

    def _folder(self, kind: str, run: str, batch: int) -> str:
        return f"{self.path}/{kind}/run={run}/batch={batch}"

    def take(self, batch: DataFrame, run: str, number: int) -> None:
        """One batch; its number rises within a run."""
        at = F.col(self.time).cast("timestamp")
        rows = batch.where(F.col(self.key).isNotNull() & F.col(self.time).isNotNull()).withColumn("_at", at)
        first = rows.groupBy(self.key).agg(F.min_by(F.struct(*rows.columns), "_at").alias("_r")).select("_r.*").persist()
        done = self.spark.read.schema(self.ledger_schema).parquet(f"{self.path}/ledger").where(~((F.col("run") == run) & (F.col("batch") >= number)))
        newest = done.agg((F.max("at") - F.expr(f"INTERVAL {self.late}")).alias("least")).first()["least"]
        in_time = F.lit(True) if newest is None else F.col("_at") >= F.lit(newest)
        end = done if newest is None else done.where(F.col("at") >= F.lit(newest))
        taken = first.where(in_time).join(end.select(self.key), self.key, "left_anti")
        behind = first.where(~in_time).join(done.select(self.key), self.key, "left_anti")
        names = batch.columns
        taken.select(*names).write.mode("overwrite").parquet(self._folder("rows", run, number))
        behind.select(*names).write.mode("overwrite").parquet(self._folder("late", run, number))
        keys = [self.spark.read.schema(self.schema).parquet(self._folder(k, run, number)).select(self.key, F.col(self.time).cast("timestamp").alias("at")) for k in ("rows", "late")]
        keys[0].unionByName(keys[1]).sortWithinPartitions("at").write.mode("overwrite").parquet(self._folder("ledger", run, number))
        first.unpersist()

    def run(self, stream: DataFrame, run: str, checkpoint: str) -> None:
        """All batches of a stream that are there now."""
        write = lambda df, number: self.take(df, run, number)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def rows(self, kind: str = "rows") -> DataFrame:
        """What was taken in time, or with kind late what wasn't."""
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")
