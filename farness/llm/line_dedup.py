"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. A batch's lines are counted by their 128-bit key hash, merge-anti-joined with the keys that the runs hold
as settled (found often enough already), and written as a sorted run of level 0. When a level has `fanout` runs, they are
merged into one sorted run of the next level. Runs are bucketed and sorted by the hash, one file for each bucket, so joins with
them and merges of them neither shuffle nor sort them. They are tables under a folder whose manifest names them: runs outlive the call and the
session, and later batches go on with LineRuns.open().

At the end the settled keys are those whose merged count reaches min_docs. Only hashes are shuffled, after a partial count in each task; a
very common line is one row of each task. Texts stay where they are: up to most_broadcast settled keys, as counted, go
to every worker, which drops lines by binary search; more are joined by document, then only documents that lose lines are.
"""

from __future__ import annotations

import json
import struct
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farness.llm.common import BLANKS, slices, spare, steady
from farness.scratch import Scratch, delete

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
#: Lets a scan of a bucketed table with one file for each bucket tell that its rows are sorted.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


class LineRuns:
    """Sorted runs (h1, h2, n, first) by level under a folder; first is the least row id of the earliest batch that has the key.

    The folder's newest manifest names its runs. A batch that fails leaves the manifest as it was, so it can be added again.
    """

    def __init__(self, spark: SparkSession, path: str, min_docs: int, fanout: int = 2):
        self.spark, self.path, self.min_docs, self.fanout = spark, path.rstrip("/"), min_docs, fanout
        self.levels: dict[int, list[str]] = {}
        self.tables: dict[str, str] = {}
        self.buckets: dict[str, int] = {}
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, min_docs: int = 10, fanout: int = 2) -> LineRuns:
        """The runs stored under path, none if there are none yet. The folder must be one that driver and executors share."""
        runs = cls(spark, path, min_docs, fanout)
        folder, files = runs._file("")
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        if done := [int(n.partition("-")[2]) for n in names if n.startswith("manifest-")]:
            runs.version = max(done)
            state = json.loads(spark.read.text(f"{runs.path}/manifest-{runs.version}").first().value)
            runs.levels = {int(k): list(v) for k, v in state["levels"].items()}
            for name, buckets in state["buckets"].items():
                table = f"farness_{uuid.uuid4().hex}"
                where = f"{runs.path}/{name}".replace("'", "''")
                spark.sql(f"CREATE TABLE {table} (h1 BIGINT, h2 BIGINT, n BIGINT, first BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {int(buckets)} BUCKETS LOCATION '{where}'")
                runs.tables[name], runs.buckets[name] = table, int(buckets)
        return runs

    def _file(self, name: str) -> tuple:
        """A path under the folder and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def add(self, pairs: DataFrame) -> None:
        """One batch of (row id, h1, h2), each pair of a document and a key once."""
        counted = pairs.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("row").alias("first"))
        for name in [r for level, runs in sorted(self.levels.items()) if level for r in runs]:
            settled = self.run(name).where(F.col("n") >= self.min_docs).select(*KEY)
            counted = counted.join(settled.hint("merge"), KEY, "left_anti")
        levels, old = {k: list(v) for k, v in self.levels.items()}, []
        levels.setdefault(0, []).append(self._write(0, counted))
        level = 0
        while len(levels[level]) >= self.fanout:
            names = levels.pop(level)
            levels.setdefault(level + 1, []).append(self._write(level + 1, self._merged(names)))
            old += names
            level += 1
        self._commit(levels, old)

    def run(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs, older ones first, merged in the order of their hashes."""
        out = self.run(names[0])
        for name in names[1:]:
            a, b = out.alias("a"), self.run(name).hint("merge").alias("b")
            both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY], "full_outer")
            keys = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY]
            out = both.select(*keys, (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"), F.coalesce("a.first", "b.first").alias("first"))
        return out

    @contextmanager
    def _sorted_scans(self):
        before = self.spark.conf.get(_ORDERED, None)
        self.spark.conf.set(_ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_ORDERED, before) if before is not None else self.spark.conf.unset(_ORDERED)

    def _write(self, level: int, run: DataFrame) -> str:
        name, table = f"run-{level}-{uuid.uuid4().hex}", f"farness_{uuid.uuid4().hex}"
        # as many buckets as a shuffle has partitions: a bucket lies in one task and gets one file
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with self._sorted_scans():
            run.write.bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.tables[name], self.buckets[name] = table, buckets
        return name

    def _commit(self, levels: dict[int, list[str]], old: list[str]) -> None:
        levels = {k: v for k, v in levels.items() if v}
        names = [r for runs in levels.values() for r in runs]
        state = json.dumps({"levels": levels, "buckets": {r: self.buckets[r] for r in names}})
        # a manifest is there as a whole or not at all
        draft, files = self._file(f"draft-{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(state.encode()))
        out.close()
        if not files.rename(draft, self._file(f"manifest-{self.version + 1}")[0]):
            raise OSError(f"{self.path}: another manifest-{self.version + 1} is there")
        self.levels, self.version = levels, self.version + 1
        delete(self.spark, f"{self.path}/manifest-{self.version - 1}")
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            delete(self.spark, f"{self.path}/{name}")

    def settled(self, scratch: Scratch) -> DataFrame:
        """(h1, h2, first) of the keys found in min_docs documents or more."""
        names = [r for _, runs in sorted(self.levels.items(), reverse=True) for r in runs]
        with self._sorted_scans():
            return scratch.cut(self._merged(names).where(F.col("n") >= self.min_docs).select(*KEY, "first"))

    def close(self) -> None:
        """Takes the runs' names from the session's catalog; their files stay."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = {}


def _dropped_by_search(docs: DataFrame, text: str, row: Column, settled: list, min_chars: int, keep: str, names: tuple[str, str, str]) -> DataFrame:
    """docs plus the three columns; lines are looked up among the sorted settled keys, texts don't move."""
    import pandas as pd

    found = pd.DataFrame(settled, columns=[*KEY, "first"]).astype("int64").sort_values(KEY)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in (*KEY, "first")))
    (own,) = spare(docs, "_row")
    place, out_names = docs.columns.index(text), [*docs.columns, *names]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        import xxhash

        h1, h2, first = shared.value
        # what the JVM's xxhash64(7, key) starts the key with
        seed = xxhash.xxh64_intdigest(struct.pack("<i", 7), 42)
        as_long = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in slices(batches, place, 2 << 20):
            texts = pc.fill_null(batch.column(place), "").cast(pa.large_string())
            cut = pc.split_pattern(texts, "\n")
            bounds = cut.offsets.to_numpy().astype(np.int64)
            lines, bounds = cut.values.slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]
            coded = pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS)).dictionary_encode()
            keys = coded.dictionary
            raw = keys.to_pylist()
            one = np.fromiter((as_long(xxhash.xxh64_intdigest(k, 42)) for k in raw), np.int64, len(raw))
            at = np.searchsorted(h1, one)
            gone = np.zeros(len(raw), bool)
            stays_in = np.full(len(raw), -1, np.int64)
            for i in np.flatnonzero((at < h1.size) & (h1[np.minimum(at, max(0, h1.size - 1))] == one)).tolist() if h1.size else []:
                two, k = as_long(xxhash.xxh64_intdigest(raw[i], seed)), int(at[i])
                while k < h1.size and h1[k] == one[i] and h2[k] != two:
                    k += 1
                if k < h1.size and h1[k] == one[i] and len(raw[i]) >= min_chars:
                    gone[i], stays_in[i] = True, first[k]
            codes = coded.indices.to_numpy()
            lost = gone[codes]
            if keep == "first":
                owner = np.repeat(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), np.diff(bounds))
                lost &= stays_in[codes] != owner
            n_lost = np.add.reduceat(lost, bounds[:-1]) if lost.size else np.zeros(0, np.int64)
            kept = texts
            if lost.any():
                left = lines.filter(pa.array(~lost))
                ends = np.concatenate([[0], np.cumsum(~lost)])[bounds]
                kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), left), pa.scalar("\n", pa.large_string()))
            columns = [*batch.columns[:-1], pa.array(np.diff(bounds)), pa.array(n_lost.astype(np.int64)), kept.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, out_names)

    return docs.select("*", row.alias(own)).mapInArrow(run, f"{kinds}, `{names[0]}` bigint, `{names[1]}` bigint, `{names[2]}` string")


def _dropped_by_join(docs: DataFrame, text: str, row: Column, gone: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """docs plus the three columns; gone: (row, h1, h2) of the lines that documents lose."""
    n_lines, n_dropped, kept = names
    own, lost, lines, left = spare(docs, "_row", "_lost", "_lines", "_left")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    losses = gone.groupBy(F.col("row").alias(own)).agg(F.collect_set(F.struct(*KEY)).alias(lost))
    df = docs.withColumn(lines, row).join(losses, F.col(lines) == F.col(own), "left").drop(lines, own)
    stays = lambda x: ~F.array_contains(F.col(lost), key_hash(line_key(x)))
    df = df.select("*", F.split(t, "\n", -1).alias(lines))
    df = df.select("*", F.when(F.col(lost).isNull(), F.col(lines)).otherwise(F.filter(lines, stays)).alias(left))
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        steady(F.size(lines) - F.size(left)).cast("long").alias(n_dropped),
        F.concat_ws("\n", F.col(left)).alias(kept),
    )


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    batches: int = 4,
    scratch: Scratch | None = None,
    runs: LineRuns | None = None,
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """docs plus n_lines, n_dropped and kept_text (spare names on a clash; they come last, in this order).

    Lines whose key (blanks stripped at both ends, A-Z lowered, min_chars code points at least) is found in min_docs rows or
    more go everywhere (keep='none') or everywhere but in the first document by batch and id (keep='first'). With runs the documents of
    earlier calls count as well, which docs must not repeat; min_docs is then that of the runs.

    Defined results: a null or empty text is one empty line, which stays; every row counts as a document of its own, rows that
    repeat an id are 'first' together; a null id is told by its text; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "line-dedup")
    names = tuple(spare(docs, "n_lines", "n_dropped", "kept_text"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.coalesce(F.col(f"`{key}`").cast("long"), F.xxhash64(t))
    keys = F.array_distinct(F.filter(F.transform(F.split(t, "\n", -1), line_key), lambda k: F.length(k) >= min_chars))
    ledger = docs.select(row.alias("row"), F.transform(keys, key_hash).alias("keys"), F.pmod(F.xxhash64(row), F.lit(batches)).cast("int").alias("batch"))
    ledger = scratch.keep(ledger, "ledger", ("batch",))
    pairs = ledger.select("batch", "row", F.explode("keys").alias("k")).select("batch", "row", "k.h1", "k.h2")
    stored = runs if runs is not None else LineRuns(spark, scratch.path("runs"), min_docs)
    for b in range(batches):
        stored.add(pairs.where(F.col("batch") == b))
    settled = stored.settled(scratch)
    if runs is None:
        stored.close()
    if settled.count() <= most_broadcast:
        return _dropped_by_search(docs, text, row, [tuple(r) for r in settled.collect()], min_chars, keep, names)
    gone = pairs.join(settled, KEY)
    return _dropped_by_join(docs, text, row, gone if keep == "none" else gone.where("row <> first"), names)
