"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of their id and sorted within each file, so that files, stripes and row groups hold narrow ranges
of ids: a reader takes stripes in parallel and skips those whose statistics or Bloom filter rule an id out. Each row has
the place of its first id within its file; a file's own place is the sum of the totals of the files before it, one number
for each file, which is all that the driver holds.

Defined results: null and empty texts are one end id; null ids come first; repeated ids lie together, in the order of their
ids' checksum; an empty table gives readable files without rows. Only the key and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farness.llm.common import slices
from farness.llm.tokens import encoder, with_end

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, files: int | None = None, stripe_bytes: int = 32 << 20, index_rows: int = 1000
) -> None:
    """Writes the ids of every text, end_id behind each, in ascending order of the key. files: the shuffle partitions by default."""
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    dealt = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))

    def run(batches):
        from pyspark import TaskContext

        encode, part, place = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        for batch in slices(batches, 1, 4 << 20, encodes=True):
            ids, offsets = with_end(*encode(batch.column(1)), end_id)
            n = batch.num_rows
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(place + offsets[:-1]), pa.array(np.diff(offsets)), lists], [x.split()[0] for x in FILE_SCHEMA.split(", ")])
            place += ids.size

    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(index_rows), "orc.create.index": "true", "compression": "zstd"}
    dealt.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on doc_id and column choices reach the ORC reader."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def file_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """How many ids lie before each file: a number for each file, from two columns of the files."""
    totals = read_token_files(spark, path).groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n")).collect()
    out, before = {}, 0
    for part, n in sorted(totals):
        out[part] = before
        before += n
    return out


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the crc32 of the ids, as the files have them."""
    starts = file_starts(spark, path)

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy().view(np.uint32)))
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            before = np.fromiter((starts[p] for p in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before + batch.column(2).to_numpy()), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_token_files(spark, path).select("doc_id", "part", "part_start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
