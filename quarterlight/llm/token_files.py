"""Token ids in ORC: run-length encoded integers in stripes, with row indexes and a Bloom filter on doc_id."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt, prefix_sums, scratch, small_batches, table
from .tokens import Encoder

END_ID = 2
SLICE = 64
_SCHEMA = "doc_id long, file int, row_in_file long, ids array<int>"
OPTIONS = {
    "compression": "snappy",  # zstd saves a fifth of the space for a tenth of the time
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
}


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, special_as_text: bool = False) -> str:
    """Writes doc_id, file, row_in_file and ids of each row of docs (doc_id, text) in ascending doc_id order; gives the folder.

    Files hold successive ranges of doc_id, null first, each ascending; rows of one doc_id stand in order of
    their texts' hashes, and where they are many (all without one) they may go on in the next file. A null text has only
    the end id. A special token's string in a text gives its id, or with special_as_text is text like any other. Texts are dealt by range once, before they are encoded, and each range is encoded in a stream into its file.
    """
    path = path or scratch(docs.sparkSession, "token-ids")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from pyspark import TaskContext

        encoder, row, end, file = Encoder.at(tokenizer, special_as_text), 0, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                ids = [x + end for x in encoder.encode(part.column("text").to_pylist())]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype("int32")
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                rows = pa.array(np.arange(row, row + part.num_rows, dtype="int64"))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(ids), file, "int32")), rows, pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "file", "row_in_file", "ids"])

    order = ["doc_id", F.xxhash64("text")]
    placed = docs.select("doc_id", "text").repartitionByRange(dealt(docs.sparkSession), *order).sortWithinPartitions(*order)
    with small_batches(docs.sparkSession):
        placed.mapInArrow(run, _SCHEMA).write.options(**OPTIONS).orc(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, row_in_file and ids; filters on doc_id reach the stripes' indexes and Bloom filters."""
    return spark.read.schema(_SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of the files; stripes are read in parallel."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column("ids")
            raw = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4").view("u1")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype="int64")])
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("file"), b.column("row_in_file"), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["doc_id", "file", "row_in_file", "n_tokens", "ids_crc32"])

    thin = read_token_files(spark, path).mapInArrow(run, "doc_id long, file int, row_in_file long, n_tokens long, ids_crc32 long")
    with small_batches(spark):
        thin = cut(thin)
    return prefix_sums(thin, ["file", "row_in_file"], {"start": "n_tokens"}).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids stand in the files; null texts have the end id alone, rows without doc_id come first."""
    import public_tokenizers

    return token_index(spark, write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
