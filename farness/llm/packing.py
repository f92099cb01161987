"""Sum-of-squares online packing of token ids into windows of a fixed size.

Each task keeps a level array: how many of its open windows are filled up to each level. What is left of a document after
whole windows goes to the level (or a new window) for which the sum of the squared counts gets least; of equal ones, the
fullest. When a task has read its rows, the windows still open are filled up from each other, and the last one is
cut into sequences whose lengths are powers of two, which need no padding.

One pass without a shuffle: a task holds its open windows and one slice of texts. A task run again gives the same rows.

Defined results: null and empty texts are one end id; repeated rows are packed once each; a null doc_id is carried along.
An empty table gives no rows. Only the key and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.llm.common import slices
from farness.llm.tokens import encoder, with_end

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Rows of one output batch, about.
OUT_ROWS = 20_000
#: Bytes of texts that are encoded at a time, about; what that takes is some 20 times as much.
SLICE = 1 << 20


class LevelPacker:
    """Pieces are (key, start, ids, tokens of the document). add() and finish() give closed sequences: lists of pieces.

    most_open bounds memory: that many open windows are settled among themselves before more are opened.
    """

    def __init__(self, size: int, most_open: int = 4096):
        self.size, self.most_open = size, most_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def choose(self, n: int) -> int:
        """The level at which n more ids make the sum of squared counts least; 0 is a new window."""
        best, best_at = 2 * int(self.levels[n]) + 1, 0
        at = np.flatnonzero(self.levels[1 : self.size - n + 1]) + 1
        if at.size:
            to = at + n
            gain = np.where(to == self.size, 1, 2 * self.levels[to] + 2) - 2 * self.levels[at]
            if (least := gain.min()) <= best:
                best_at = int(at[np.flatnonzero(gain == least)[-1]])
        return best_at

    def add(self, key, ids: np.ndarray) -> list[list]:
        closed, n = [], ids.size
        whole = n - n % self.size
        for at in range(0, whole, self.size):
            closed.append([(key, at, ids[at : at + self.size], n)])
        if whole < n:
            piece = (key, whole, ids[whole:].copy(), n)
            level = self.choose(n - whole)
            window = self._take(level) if level else []
            window.append(piece)
            if level + n - whole == self.size:
                closed.append(window)
            else:
                self._put(level + n - whole, window)
                if self.n_open > self.most_open:
                    closed += self.finish()
        return closed

    def _take(self, level: int) -> list:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, level: int, window: list) -> None:
        self.levels[level] += 1
        self.n_open += 1
        self.open.setdefault(level, []).append(window)

    def finish(self) -> list[list]:
        """Closes all open windows: the fullest are filled from the emptiest, the last is cut at powers of two."""
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.levels[:] = 0
        self.open, self.n_open = {}, 0
        closed, last = [], len(left) - 1
        for k, window in enumerate(left):
            if k > last:
                break
            need = self.size - sum(p[2].size for p in window)
            while need and last > k:
                key, start, ids, n = left[last].pop()
                window.append((key, start + max(0, ids.size - need), ids[max(0, ids.size - need) :], n))
                if ids.size > need:
                    left[last].append((key, start, ids[: ids.size - need], n))
                need -= window[-1][2].size
                last -= not left[last]
            closed += [window] if not need else self._binary(window)
        return closed

    def _binary(self, window: list) -> list[list]:
        out, total = [], sum(p[2].size for p in window)
        for bit in reversed(range(total.bit_length())):
            need = (total >> bit & 1) << bit
            if need:
                out.append(sequence := [])
            while need:
                key, start, ids, n = window.pop(0)
                sequence.append((key, start, ids[:need], n))
                if ids.size > need:
                    window.insert(0, (key, start + need, ids[need:], n))
                need -= sequence[-1][2].size
        return out


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: the key as doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids.

    tokenizer is the path of a vocabulary file that every executor has.
    """
    schema = SCHEMA + ", ids array<int>" * with_ids

    def run(batches):
        from pyspark import TaskContext

        encode, packer = encoder(tokenizer).encode, LevelPacker(size)
        first, n_sequences, rows = TaskContext.get().partitionId() << 33, 0, []

        def emit(sequences):
            nonlocal n_sequences
            for sequence in sequences:
                offset = 0
                for k, start, ids, n in sequence:
                    rows.append((k, start, ids.size, zlib.crc32(ids), n, first + n_sequences, offset, *([ids.astype(np.int32)] * with_ids)))
                    offset += ids.size
                n_sequences += 1

        def flush():
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            names = [x.split()[0] for x in schema.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return out

        for batch in slices(batches, 1, SLICE, encodes=True):
            ids, offsets = with_end(*encode(batch.column(1)), end_id)
            for i, k in enumerate(batch.column(0).to_pylist()):
                emit(packer.add(k, ids[offsets[i] : offsets[i + 1]]))
                if len(rows) >= OUT_ROWS:
                    yield flush()
            if with_ids and rows:
                yield flush()
        emit(packer.finish())
        if rows:
            yield flush()

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
