"""What the operators of this subpackage share: tables, spare column names, Arrow streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that separate words in every contract of this subpackage.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steady(value: Column) -> Column:
    """The same value, computed where it is selected: filters on it aren't pushed below with all that it is made of."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names for new columns that clash with none of df's: the wanted ones, with underscores in front as needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of this session have BATCH_ROWS rows, unless it has a number of its own: with whole texts the default takes
    tens of MB of each task, several times over in the JVM (buffers double as they grow) and in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def give_back(encodes: bool = False) -> None:
    """Hands freed memory of this worker back to the system: workers outlive tasks and stages, and share an executor's memory.

    Tasks that don't encode drop the tokenizers that earlier ones left, with all the pieces that these remember.
    """
    import contextlib
    import ctypes
    import sys

    import pyarrow as pa

    if not encodes and (tokens := sys.modules.get("farness.llm.tokens")):
        tokens.encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: int, most: int = 8 << 20, encodes: bool = False):
    """Arrow record batches cut so that the given text column has about `most` bytes in each; a single longer text stays whole.

    What earlier tasks of this worker, or this one, have freed goes back to the system at both ends; tokenizers only stay if the task
    encodes.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import numpy as np

    give_back(encodes)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    batch = sizes = ends = None
    give_back(encodes)


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """crc32 of the key as text, modulo `folds`, equals `fold`; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
