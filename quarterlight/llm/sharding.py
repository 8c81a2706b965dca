"""Sharding by bytes: contiguous, balanced shards from global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared_files
from .common import crc32_text, free, prefix_sums, scratch, table

SHARDS = 40
ROW_BYTES = 16


def assign_shards(df: DataFrame, shards: int = SHARDS, order: tuple[str, ...] = ("doc_id", "text_crc32", "size"), size: str = "size") -> DataFrame:
    """df (thin: an order and a size) with shard and slot.

    Rows stand in the order given; the running sum of sizes before a row plus half its own, over the total,
    picks one of `shards` equal targets, so every shard is a contiguous run whose bytes differ from the target
    by one row at most. slot counts a shard's rows from 0. Null sizes count as 0; if all are 0, shard 0 takes
    all; equal rows get neighbouring slots; columns named shard or slot are replaced; an empty table gives an empty result.
    """
    df = df.drop("shard", "slot")
    before, row, first_ = (free(df.columns, c) for c in ("_before", "_row", "_first"))
    placed = prefix_sums(df, order, {before: size}, row=row)
    total = df.agg(F.sum(size)).first()[0] or 0
    middle = (2 * F.col(before) + F.coalesce(F.col(size), F.lit(0))).cast("decimal(25,0)")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(total, 1)).cast("decimal(25,0)"))).cast("int")
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min(row).alias(first_))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col(row) - F.col(first_)).drop(before, row, first_)


def sized(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size in UTF-8 bytes plus ROW_BYTES, text_crc32 and what is to be kept; the texts go no further."""
    return docs.select("doc_id", *keep, (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + ROW_BYTES).cast("long").alias("size"), crc32_text(F.col(text)).alias("text_crc32"))


def write_shards(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> str:
    """Writes whole rows as one folder of Parquet for each shard, in order of doc_id, and gives the folder.

    Every row is written once: rows meet their shard by a number of their own, so null and repeated doc_ids and
    repeated rows do no harm. Columns named shard or slot are replaced.
    """
    spark = docs.sparkSession
    path, held = path or scratch(spark, "shards"), scratch(spark, "numbered")
    docs = docs.drop("shard", "slot")
    number = free(docs.columns, "_number")
    docs.withColumn(number, F.monotonically_increasing_id()).write.parquet(held)
    rows = spark.read.parquet(held)
    placed = assign_shards(sized(rows, keep=(number,)), shards).select(number, "shard", "slot")
    out = rows.join(placed, number).drop(number)
    out.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    shared_files.remove(spark, held)
    return path


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by bytes; null texts have 16 bytes, null doc_ids come first, repeated rows lie side by side."""
    out = assign_shards(sized(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
