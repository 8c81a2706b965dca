"""Helpers shared by the corpus operators: shared storage, word rules, ordered prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word rules, space and the five control characters, as a regex class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Used only where a session names no shared folder, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints"
#: One row for each key goes to all executors only up to this many keys; beyond, the join shuffles.
BROADCAST_KEYS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; also makes checkpoint() use it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or DEFAULT_SHARED
    if ":/" not in where:  # Spark would take it for a folder of the default file system, Python for a local one
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        where = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable shared storage: no lost executor makes them be computed again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """What nothing refers to any more leaves the disk now: Spark's cleaner takes shuffle files when the driver collects garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


_held: dict[str, object] = {}


def release() -> None:
    """Drops the large thing that this worker holds, and gives its memory back."""
    import ctypes
    import gc

    if _held:
        _held.clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


def once(name: str, make):
    """What make() gives, made once in a worker; a worker serves many tasks and operators, and holds one such thing."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """What runs inside hands texts to Python in batches of few rows: a batch is held whole on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_list(text: Column) -> Column:
    """Maximal runs without white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def crc32_text(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def dealt(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(columns: Sequence[str], name: str) -> str:
    """A name like this one that no column has."""
    while name in columns:
        name = "_" + name
    return name


def row_key(df: DataFrame) -> Column:
    """A hash of all columns of a row: rows that share it are alike in every column (maps, which have no hash, aside)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def prefix_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str], row: str | None = None) -> DataFrame:
    """Exclusive running sums over all rows in the order of the columns `order`.

    sums: new column -> long column that is summed; row: name of a column for the rows before this one.
    Rows are dealt by ranges and stored once; then one small row for each range gives the sum before it,
    and each range adds its own rows up in a stream. Equal keys that differ in no column of `order` may
    stand either way round. The range count is the session's number of shuffle partitions, so the table of
    totals has that many rows. Columns of a new name are replaced. Empty input gives empty output.
    """
    spark = df.sparkSession
    one, range_ = free(df.columns, "_one"), free(df.columns, "_range")
    taken = {**sums, **({row: one} if row else {})}
    src = df.withColumn(one, F.lit(1).cast("long")) if row else df
    placed = cut(src.repartitionByRange(dealt(spark), *order).sortWithinPartitions(*order).withColumn(range_, F.spark_partition_id()))
    totals = placed.groupBy(range_).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(taken.values())]).collect()  # a row a range
    at, before = dict.fromkeys(taken, 0), {}
    for r in sorted(totals, key=lambda r: r[range_]):
        before[r[range_]] = dict(at)
        for i, n in enumerate(taken):
            at[n] += r[f"_t{i}"] or 0
    out_schema = df.drop(*taken).schema
    cols = list(out_schema.names)
    for n in taken:
        out_schema = out_schema.add(n, "long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now = None
        for b in batches:
            if not b.num_rows:
                continue
            if now is None:
                now = dict(before[b.column(range_)[0].as_py()])
            arrays = [b.column(c) for c in cols]
            for n, c in taken.items():
                v = b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(v)
                arrays.append(pa.array(ends - v + now[n]))
                now[n] += int(ends[-1])
            yield pa.RecordBatch.from_arrays(arrays, names=cols + list(taken))

    return placed.mapInArrow(run, out_schema)
