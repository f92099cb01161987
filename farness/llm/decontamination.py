"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words: the words at its ones are hashed, the others are ignored, so a passage with
substituted words still has windows whose hashes agree. Hashes of the documents' windows are joined with those of the
benchmark's; around each hit the whole item is laid along the document and the matching words are counted, runs of them
joined across substitutions. A document holds an item if its matched words are enough. The masks leave out none that is: every
run of words that is counted has a window of one of them.

The benchmark's side of the join is broadcast in blocks of at most block_words words, counted beforehand; a larger benchmark takes
more passes over the documents, each block's result being written before the next. Nothing is shuffled.

Repetitive texts (tables of zeros) don't multiply: a window that an item repeats more than REPEATS times isn't joined place by
place; a run of such windows in the document gives one range of places where the item may start. Ranges are laid along from the
left until every word of the item has matched. What is found is the same, and memory is bounded by CELLS.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.llm.common import slices
from farness.llm.words import joined, mix, words
from farness.scratch import Scratch

#: The masks, four words each, chosen so that one at least hits in every run of words that SeedIndex.matches counts:
#: six matching words and more, half of the words between its ends at least, no two of them more than four apart.
MASKS = (
    "11010001", "1000100011", "101001001", "10001011", "10100101", "1110001", "100100011", "110010001", "1001010001",
    "10001000011", "1100010001", "11001001", "1001011", "101000101", "10001101", "1010011", "110101", "11000101",
)
SPAN = 12
SCHEMA = "doc_id long, item_id long, matched_words long, item_words long, share double, first_word long"
#: Bytes of words: letters, digits and everything beyond ASCII.
_LETTERS = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_PLACES = mix(np.arange(101, 101 + SPAN, dtype=np.uint64)) | np.uint64(1)
#: Bits of a hash that a seed's bitmap tells apart, at most; some 6 more than its windows need, so about one in 64 foreign windows passes.
_BITS = 22
#: A window found more often than that in one item is joined by ranges.
REPEATS = 3
#: How many words are laid against each other, or rows joined, at a time.
CELLS = 1 << 20


@dataclass(frozen=True)
class Overlap:
    """Items of fewer than least_item words aren't searched for, items of fewer than 12 must match in full.

    Others count as held if the matched words reach `words` or `share` of the item, whichever is less, but least_item at least.
    """

    words: int = 13
    share: float = 0.6
    least_item: int = 5
    least_run: int = 6


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return words(*joined(texts), keep=_LETTERS)


def seed_hashes(hashes: np.ndarray, places: list[int], salt: int) -> np.ndarray:
    """One hash for each window: of its words at the given places."""
    out = np.full(max(0, hashes.size - max(places)), np.uint64(salt), np.uint64)
    for k in places:
        out += hashes[k : k + out.size] * _PLACES[k]
    return mix(out)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Sorted rows, each once."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows


def _blocks(sizes: np.ndarray, most: int):
    """Ranges of rows whose sizes add up to about `most`, one row at least in each."""
    ends, a = np.cumsum(sizes), 0
    while a < sizes.size:
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        yield a, b
        a = b


class SeedIndex:
    """The benchmark's side of the join: for each seed, sorted hashes with the item and the place of the window."""

    def __init__(self, ids: list, texts: list, rule: Overlap):
        hashes, bounds = text_words(pa.array(texts, pa.large_string()))
        found: dict[bytes, int] = {}
        self.ids: list[list] = []
        self.items: list[np.ndarray] = []
        for i, name in enumerate(ids):
            own = hashes[bounds[i] : bounds[i + 1]]
            if own.size >= rule.least_item:
                k = found.setdefault(own.tobytes(), len(self.items))
                if k == len(self.items):
                    self.items.append(own)
                    self.ids.append([])
                self.ids[k].append(name)
        self.rule, self.seeds = rule, []
        self.sizes = np.array([x.size for x in self.items], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([*self.items, np.zeros(0, np.uint64)])
        full = [k for k, x in enumerate(self.items) if x.size >= SPAN]
        for salt, mask in enumerate(MASKS):
            self._seed([j for j, bit in enumerate(mask) if bit == "1"], salt, full)
        for n in sorted({x.size for x in self.items if x.size < SPAN}):
            self._seed(list(range(n)), 100 + n, [k for k, x in enumerate(self.items) if x.size == n])

    def _seed(self, places: list[int], salt: int, of: list[int]) -> None:
        parts = [seed_hashes(self.items[k], places, salt) for k in of]
        if not parts:
            return
        hashes = np.concatenate(parts)
        items = np.repeat(np.array(of, np.int64), [p.size for p in parts])
        at = np.concatenate([np.arange(p.size) for p in parts])
        shift = np.uint64(64 - min(_BITS, max(10, hashes.size.bit_length() + 6)))
        bitmap = np.zeros(1 << int(64 - shift), bool)
        bitmap[hashes >> shift] = True
        order = np.lexsort((at, items, hashes))
        hashes, items, at = hashes[order], items[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])]))
        count = np.diff(np.append(first, hashes.size))
        often = count > REPEATS
        once = ~np.repeat(often, count)
        ranges = (hashes[first[often]], items[first[often]], at[first[often]], at[(first + count - 1)[often]])
        self.seeds.append((places, salt, shift, bitmap, (hashes[once], items[once], at[once]), ranges))

    def _candidates(self, hashes: np.ndarray, bounds: np.ndarray, ranges: list):
        """Yields distinct rows (document, item, place in the batch's words where the item would start), those of one window
        maybe again later; rows (document, item, first such place, last) are put into ranges."""
        waiting, n_waiting = [], 0
        for places, salt, shift, bitmap, (known, items, at), (hot, hot_items, lo, hi) in self.seeds:
            own = seed_hashes(hashes, places, salt)
            near = np.flatnonzero(bitmap[own >> shift])
            doc = np.searchsorted(bounds, near, "right") - 1
            inside = near + max(places) < bounds[doc + 1]
            near, doc = near[inside], doc[inside]
            low, high = (np.searchsorted(known, own[near], side) for side in ("left", "right"))
            hit = np.flatnonzero(high > low)
            for a, b in _blocks((high - low)[hit], CELLS):
                k, n = hit[a:b], (high - low)[hit[a:b]]
                row = np.repeat(k, n)
                to = np.repeat(low[k] - (np.cumsum(n) - n), n) + np.arange(row.size)
                waiting.append(_distinct(np.stack([doc[row], items[to], near[row] - at[to]], axis=1)))
                n_waiting += len(waiting[-1])
                if n_waiting > CELLS:
                    yield _distinct(np.concatenate(waiting))
                    waiting, n_waiting = [], 0
            if hot.size:
                low, high = (np.searchsorted(hot, own[near], side) for side in ("left", "right"))
                hit = np.flatnonzero(high > low)
                hit = hit[np.lexsort((near[hit], low[hit], doc[hit]))]
                if hit.size:
                    # places of one window up to four apart make one range, since the window lies four times in the item at least
                    fresh = (doc[hit[1:]] != doc[hit[:-1]]) | (low[hit[1:]] != low[hit[:-1]]) | (near[hit[1:]] - near[hit[:-1]] > REPEATS + 1)
                    begin = np.flatnonzero(np.concatenate([[True], fresh]))
                    end = np.append(begin[1:], hit.size) - 1
                    n = (high - low)[hit[begin]]
                    row = np.repeat(np.arange(begin.size), n)
                    to = np.repeat(low[hit[begin]] - (np.cumsum(n) - n), n) + np.arange(row.size)
                    ranges.append(np.stack([doc[hit[begin]][row], hot_items[to], near[hit[begin]][row] - hi[to], near[hit[end]][row] - lo[to]], axis=1))
        if waiting:
            yield _distinct(np.concatenate(waiting))

    def _counted(self, hashes: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in the item) of the words that count along the diagonals of rows: matches() of all of them at once."""
        doc, item, start = rows.T
        size = self.sizes[item]
        low = np.maximum(0, bounds[doc] - start)
        n = np.maximum(0, np.minimum(size, bounds[doc + 1] - start) - low)
        row = np.repeat(np.arange(len(rows)), n)
        off = np.arange(row.size) + np.repeat(low - (np.cumsum(n) - n), n)
        same = np.flatnonzero(hashes[start[row] + off] == self.flat[self.starts[item][row] + off])
        row, off = row[same], off[same]
        if not row.size:
            return row, off
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (off[1:] - off[:-1] > 4)]))
        n = np.diff(np.append(first, row.size))
        dense = (n >= np.minimum(self.rule.least_run, size[row[first]])) & (2 * n >= off[first + n - 1] - off[first] + 1)
        keep = np.repeat(dense, n)
        return row[keep], off[keep]

    def _along(self, hashes: np.ndarray, bounds: np.ndarray, doc: int, item: int, spans: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
        """(the item's places that count, the first word in the batch) along all diagonals of ascending spans."""
        size = int(self.sizes[item])
        total, first, step = np.zeros(size, bool), hashes.size, max(1, CELLS // size)
        for low, high in spans:
            for a in range(max(low, int(bounds[doc]) - size + 1), min(high, int(bounds[doc + 1]) - 1) + 1, step):
                if a >= first and total.all():
                    return total, first
                starts = np.arange(a, min(a + step, high + 1))
                row, off = self._counted(hashes, bounds, np.stack([np.full(starts.size, doc), np.full(starts.size, item), starts], axis=1))
                if row.size:
                    total[off] = True
                    first = min(first, int((starts[row] + off).min()))
                step = min(4 * step, max(1, CELLS // size))
        return total, first

    def matches(self, own: np.ndarray, item: np.ndarray, start: int) -> tuple[np.ndarray, int]:
        """(which words of the item match along the diagonal, in runs that are dense enough; the first such place in own)."""
        low, high = max(0, -start), min(item.size, own.size - start)
        same = np.zeros(item.size, bool)
        same[low:high] = own[start + low : start + high] == item[low:high]
        at = np.flatnonzero(same)
        if not at.size:
            return same, 0
        runs = np.split(at, np.flatnonzero(np.diff(at) > 4) + 1)
        dense = [r for r in runs if r.size >= min(self.rule.least_run, item.size) and 2 * r.size >= r[-1] - r[0] + 1]
        out = np.zeros(item.size, bool)
        for r in dense:
            out[r] = True
        return out, start + int(dense[0][0]) if dense else 0

    def held(self, hashes: np.ndarray, bounds: np.ndarray):
        """Yields (document, item, matched words, first word) of the items that documents hold."""
        if not self.items:
            return
        width, ranges, codes, pairs, firsts = int(self.sizes.max()), [], [], [], []
        for rows in self._candidates(hashes, bounds, ranges):
            for a, b in _blocks(self.sizes[rows[:, 1]], CELLS):
                own = rows[a:b]
                row, off = self._counted(hashes, bounds, own)
                pair = own[row, 0] * len(self.items) + own[row, 1]
                codes.append(np.unique(pair * width + off))
                at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if row.size else row
                pairs.append(pair[at])
                firsts.append(np.minimum.reduceat(own[row, 2] + off, at) if row.size else row)
        if ranges:
            rows = _distinct(np.concatenate(ranges))
            edge = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(rows)], strict=True):
                spans: list[tuple[int, int]] = []
                for low, high in rows[a:b, 2:].tolist():
                    if spans and low <= spans[-1][1] + 1:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], high))
                    else:
                        spans.append((low, high))
                doc, item = int(rows[a, 0]), int(rows[a, 1])
                total, first = self._along(hashes, bounds, doc, item, spans)
                pair = doc * len(self.items) + item
                codes.append(pair * width + np.flatnonzero(total))
                if total.any():
                    pairs.append(np.array([pair]))
                    firsts.append(np.array([first]))
        if not codes:
            return
        found, matched = np.unique(np.unique(np.concatenate(codes)) // width, return_counts=True)
        pair, first = np.concatenate(pairs), np.concatenate(firsts)
        least = np.full(found.size, hashes.size)
        np.minimum.at(least, np.searchsorted(found, pair), first)
        doc, item = found // len(self.items), found % len(self.items)
        size, rule = self.sizes[item], self.rule
        share = np.array([math.ceil(rule.share * n) for n in size.tolist()], np.int64)
        need = np.where(size < SPAN, size, np.maximum(rule.least_item, np.minimum(rule.words, share)))
        for k in np.flatnonzero(matched >= need).tolist():
            yield int(doc[k]), int(item[k]), int(matched[k]), int(least[k] - bounds[doc[k]])


def _index_blocks(items: DataFrame, item_key: str, item_text: str, rule: Overlap, block_words: int):
    """Yields a broadcast index for each block of items, of at most about block_words words; one of none for an empty table."""
    spark = items.sparkSession
    tests = items.select(F.col(f"`{item_key}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    total = tests.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    for b in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        yield spark.sparkContext.broadcast(SeedIndex([r.id for r in own], [r.text for r in own], rule)), blocks


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rule: Overlap = Overlap(), block_words: int = 500_000) -> DataFrame:
    """A row for each document and benchmark item that it holds: SCHEMA, share being matched words over the item's words.

    Defined results: null and empty texts of either side hold and are held by nothing; items with equal words each get their own
    row; repeated rows of docs repeat rows; null keys are carried along; empty tables give no rows. Only the named columns are read.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scratch, out = None, None
    for shared, blocks in _index_blocks(items, item_key, item_text, rule, block_words):
        found = rows.mapInArrow(_search(shared), SCHEMA)
        if blocks > 1:
            scratch = scratch or Scratch(docs.sparkSession, "decontamination")
            found = scratch.cut(found)
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rule: Overlap = Overlap(), block_words: int = 500_000) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns, judged each by its own text alone.

    Ids play no part, so null and repeated ones need no care; null and empty texts hold nothing and stay; empty tables and
    columns of any name are fine.
    """
    scratch, place = None, docs.columns.index(text)
    for shared, blocks in _index_blocks(items, item_key, item_text, rule, block_words):
        docs = docs.mapInArrow(_drop(shared, place), docs.schema)
        if blocks > 1:
            scratch = scratch or Scratch(docs.sparkSession, "decontaminated")
            docs = scratch.cut(docs)
            shared.unpersist()
    return docs


def _drop(shared, place: int):
    def run(batches):
        index = shared.value
        for batch in slices(batches, place, 2 << 20):
            clean = np.ones(batch.num_rows, bool)
            clean[[doc for doc, *_ in index.held(*text_words(batch.column(place)))]] = False
            yield batch.filter(pa.array(clean))

    return run


def _search(shared):
    def run(batches):
        index = shared.value
        kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
        for batch in slices(batches, 1, 2 << 20):
            ids, out = batch.column(0).to_pylist(), []
            for doc, k, matched, first in index.held(*text_words(batch.column(1))):
                size = index.items[k].size
                out += [(ids[doc], name, matched, size, matched / size, first) for name in index.ids[k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run
