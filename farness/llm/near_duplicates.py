"""HyperMinHash near-duplicates over word shingles.

A text's shingle hashes fall into buckets by their top bits; of each bucket's least hash a register keeps the count of leading
zeros and some mantissa bits. Bands of registers (empty ones filled from others of the same text) give bucket keys for
candidates; the Jaccard similarity estimated from the registers, less the expected chance collisions, sorts out most
of them; the rest are confirmed on full shingle sets, so links are exact.

Scale. Texts with the same shingle set form a class, which has a number of its own, and only one representative of each goes on. Within a bucket no pairs are
listed: all members meet a leader first. What the confirmed links don't join yet goes on: small buckets meet pairwise. In larger ones each member
is told by its difference from a reference, the text with the most links in the bucket's largest component, with which it meets. Two members
that link, of which one isn't linked to the reference, share more than about half of the other's difference, so they are found by a
prefix filter on differences, the rarest shingles first. That holds for members at a distance of up to FAR from the reference; a
link beyond has both ends further than FAR - (1 - threshold) away (the distance is a metric), and those few go through rounds
of leaders. So no link between different components is lost, and thousands of near copies cost about as many rows as they have
edits. Components are found on tables; everything between steps is a table in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farness.llm.common import BLANKS, slices, spare, steady
from farness.llm.words import mix, shingle_sets
from farness.operators.components import connected_components
from farness.scratch import Scratch

#: Registers, mantissa bits, registers in a band. 25 bands of 5: a pair at similarity 0.85 shares none with probability 4e-7, at 0.8 5e-5.
REGISTERS, MANTISSA, ROWS = 128, 10, 5
BANDS = REGISTERS // ROWS
_REST = 64 - (REGISTERS.bit_length() - 1)
_EMPTY = 0xFFFF
#: Chance that two independent registers agree, times the share of mantissa (the constant of the published estimator times 4).
_CHANCE = 0.169919487159739093975315012348 * 4 / 2**MANTISSA
#: Buckets of up to so many members meet pairwise in the second round; larger ones by eight times as many leaders, 16 times as many in each round.
SMALL = 8
#: Up to this Jaccard distance from the reference members are told by their differences from it.
FAR = 0.5
SIGNATURE = "doc_id long, n_shingles long, f1 long, f2 long, registers binary, bands array<long>"
#: What tells rows of one id apart by their text.
TEXT = ["t1", "t2"]


def compress(least: np.ndarray) -> np.ndarray:
    """Registers of the least hashes (without their bucket bits): leading zeros, then the bits behind the first one."""
    high, low = least >> np.uint64(30), least & np.uint64((1 << 30) - 1)
    bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 30, np.frexp(low.astype(np.float64))[1]).astype(np.int64)
    leading = _REST - bits
    aligned = least << leading.astype(np.uint64)
    return (leading.astype(np.uint64) << np.uint64(MANTISSA) | (aligned >> np.uint64(_REST - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each sorted set of hashes; _EMPTY where a bucket has no hash."""
    out = np.full((len(sets), REGISTERS), _EMPTY, np.uint16)
    if total := sum(map(len, sets)):
        values = np.concatenate(sets)
        place = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * REGISTERS + (values >> np.uint64(_REST)).astype(np.int64)
        first = np.ones(total, bool)
        first[1:] = place[1:] != place[:-1]
        out.reshape(-1)[place[first]] = compress(values[first] & np.uint64((1 << _REST) - 1))
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with empty ones taken from full ones of the same row, along a fixed sequence of places for each register."""
    out = regs.copy()
    if not (rows := np.flatnonzero((regs == _EMPTY).any(axis=1) & (regs != _EMPTY).any(axis=1))).size:
        return out
    own, part = regs[rows], out[rows]
    lane = np.arange(REGISTERS, dtype=np.uint64)
    for step in range(4 * REGISTERS):
        empty = part == _EMPTY
        if not empty.any():
            break
        probe = mix(lane * np.uint64(1 << 20) + np.uint64(step + 1)) % np.uint64(REGISTERS) if step < 3 * REGISTERS else (lane + np.uint64(step)) % np.uint64(REGISTERS)
        part = np.where(empty, own[:, probe.astype(np.int64)], part)
    out[rows] = part
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    full = filled(regs)[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), full.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key ^ (full[:, :, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return key


def estimated(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity by registers less the chance collisions, registers in use) for rows of registers and set sizes."""
    used = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=1)
    same = ((a == b) & (a != _EMPTY)).sum(axis=1)
    both = ((a != _EMPTY) & (b != _EMPTY)).sum(axis=1)
    chance = _CHANCE * both * (na.astype(float) * nb) / np.maximum(1.0, (na.astype(float) + nb) ** 2)
    return np.maximum(0, same - chance) / np.maximum(1e-9, used - chance), used


def _names(sets: list[np.ndarray]) -> tuple[list, list]:
    """Two numbers that name each set of hashes; null for an empty one."""
    one = [int(s.sum(dtype=np.uint64).view(np.int64)) if s.size else None for s in sets]
    two = [int((np.bitwise_xor.reduce(mix(s + np.uint64(0x5851F42D4C957F2D))) ^ np.uint64(len(s))).view(np.int64)) if s.size else None for s in sets]
    return one, two


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """SIGNATURE and TEXT for every row; f1 and f2 name the shingle set (null without shingles), TEXT is by text_hash()."""

    def run(batches):
        for batch in slices(batches, 1, 2 << 20):
            sets = shingle_sets(batch.column(1), n)
            regs = registers(sets)
            keys = band_keys(regs)
            f1, f2 = _names(sets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()), lists, batch.column(2), batch.column(3)],
                [*(x.split()[0] for x in SIGNATURE.split(", ")), *TEXT],
            )

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *text_hash(F.col(f"`{text}`")))
    return rows.mapInArrow(run, f"{SIGNATURE}, t1 long, t2 long")


def text_hash(text: Column) -> list[Column]:
    """128 bits of hash of a text, as TEXT."""
    return [F.xxhash64(text, F.lit(k)).alias(name) for k, name in enumerate(TEXT)]


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate is no more than 4.5 standard deviations below the threshold."""
    own = lambda x: reps.select(F.col("node").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 4))
                na, nb = batch.column(3).to_numpy(), batch.column(5).to_numpy()
                share, used = estimated(a, b, na, nb)
                margin = 4.5 * np.sqrt(threshold * (1 - threshold) / np.maximum(1, used))
                can = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
                yield batch.select([0, 1]).filter(pa.array(can & (share >= threshold - margin)))

    full = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "ra", "na", "rb", "nb")
    return full.mapInArrow(run, "a long, b long")


@dataclass(frozen=True)
class _Texts:
    """Where the classes' shingle sets come from: the documents, and reps (node, doc_id, f1, f2, copies)."""

    docs: DataFrame
    reps: DataFrame
    key: str
    text: str
    n: int
    repeated: bool

    def sets(self, wanted: DataFrame, scratch: Scratch) -> DataFrame:
        """(id, shingles, copies) of the classes whose number is in wanted's column _id, made anew from the rows that their reps are."""
        n = self.n

        def run(batches):
            for batch in slices(batches, 0, 2 << 20):
                sets = shingle_sets(batch.column(0), n)
                # a row of the same id may have another text
                f1, f2 = _names(sets)
                right = [a == x and b == y for a, b, x, y in zip(f1, f2, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                own = [s for s, ok in zip(sets, right, strict=True) if ok]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int32)
                values = np.concatenate(own) if own else np.zeros(0, np.uint64)
                nodes, copies = (batch.column(k).filter(pa.array(right, pa.bool_())) for k in (1, 4))
                yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64))), copies], ["id", "shingles", "copies"])

        # a table of its own, so that its size is known; texts meet its ids alone first, so that only those wanted are shuffled
        named = scratch.cut(self.reps.select("node", F.col("doc_id").alias("_of"), "f1", "f2", "copies").join(wanted, F.col("node") == F.col("_id"), "left_semi"))
        rows = self.docs.select(F.col(f"`{self.key}`").cast("long").alias("_key"), F.col(f"`{self.text}`").alias("_text"))
        rows = rows.join(named.select(F.col("_of").alias("_any")), F.col("_key") == F.col("_any"), "left_semi")
        rows = rows.join(named, F.col("_key") == F.col("_of")).select("_text", "node", "f1", "f2", "copies")
        return rows.mapInArrow(run, "id long, shingles array<long>, copies long")

    def cut(self, wanted: DataFrame, scratch: Scratch) -> DataFrame:
        """sets() as a table (id, shingles), one row for each class."""
        made = scratch.cut(self.sets(wanted, scratch))
        if self.repeated:
            # rows that repeat both id and set
            made = scratch.cut(made.where("copies = 1").unionByName(made.where("copies > 1").dropDuplicates(["id"])))
        return made.select("id", "shingles")


def _confirmed(pairs: DataFrame, texts: _Texts, percent: int, scratch: Scratch) -> DataFrame:
    """Links (src, dst): pairs with 100 * intersection >= percent * union of the full sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    sets = texts.cut(wanted, scratch)
    own = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b")
    both = both.select("a", "b", steady(F.size(F.array_intersect("sa", "sb"))).alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return both.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _leaders(number: int) -> tuple[int, int]:
    """Places of the leaders of a large bucket that meet the others in this round: above the first, up to the second."""
    return (0, 8 * SMALL) if number == 1 else (8 * SMALL * 16 ** (number - 2), 8 * SMALL * 16 ** (number - 1))


def _star(ranked: DataFrame) -> DataFrame:
    """(id, lead, k) for all members and the leaders of their buckets: k buckets have that leader."""
    return ranked.where("id <> lead").groupBy("id", "lead").agg(F.count("*").alias("k"))


def _first(star: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member with the one leader that it shares the most buckets with, the least of equal ones."""
    best = star.groupBy("id").agg(F.min(F.struct((-F.col("k")).alias("k"), "lead")).alias("best"))
    return best.select(*_ordered(F.col("id"), F.col("best.lead"))).distinct()


def _second(star: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs (a, b) of members and leaders that are in different components."""
    of = lambda x: components.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    told = star.join(of("id"), "id", "left").join(of("lead"), "lead", "left")
    return told.where("coalesce(of_id, id) <> coalesce(of_lead, lead)").select(*_ordered(F.col("id"), F.col("lead"))).distinct()


def _round(members: DataFrame, number: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of members that meet in this round. members: key, id, size, component, far, distance, place, n (of the bucket).

    Members of different components meet, one of them far: in small buckets pairwise, in large ones each with the next leaders.
    A leader meets all members behind it, by place and id, so in the end every two have met or are joined. Pairs that can't link
    don't meet: those whose sizes, or distances from one leader, differ by too much.
    """
    side = lambda x: members.select("key", F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("size", "component", "far", "distance", "place")), *(["n"] if x == "y" else []))
    above, to = _leaders(number)
    lead = side("y").where(f"place_y > {above} AND place_y <= {to}")
    order = "(place_x > place_y OR place_x = place_y AND x > y) AND component_x <> component_y AND (far_x OR far_y)"
    sizes = f"size_x >= {threshold - 1e-9} * size_y AND size_y >= {threshold - 1e-9} * size_x"
    near = f"coalesce(abs(distance_x - distance_y) <= {1 - threshold + 1e-9}, true)"
    return side("x").join(lead, "key").where(f"{order} AND {sizes} AND {near}").select(*_ordered(F.col("x"), F.col("y"))).distinct()


def _referred(large: DataFrame, links: DataFrame) -> DataFrame:
    """large plus root (the largest component in the bucket, the least of equal ones) and ref (its vertex with the most links)."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    of = large.select("id", "component").distinct().join(ends, "id", "left")
    hubs = of.groupBy(F.col("component").alias("root")).agg(F.min(F.struct(-F.coalesce("links", F.lit(0)), "id")).alias("hub")).select("root", F.col("hub.id").alias("ref"))
    shares = large.groupBy("key", "component").agg(F.count("*").alias("k"))
    roots = shares.groupBy("key").agg(F.min(F.struct((-F.col("k")).alias("k"), "component")).alias("most")).select("key", F.col("most.component").alias("root"))
    return large.join(roots.join(hubs, "root"), "key")


def _differences(large: DataFrame, texts: _Texts, percent: int, scratch: Scratch) -> DataFrame:
    """ref, id, component, root, size, ref_size, differs (the symmetric difference), distance, linked, for members and their references."""
    star = scratch.cut(large.where("id <> ref").select("ref", "id", "component", "root").distinct())
    wanted = star.select(F.explode(F.array("ref", "id")).alias("_id")).distinct()
    sets = texts.cut(wanted, scratch)
    both = star.join(sets, "id").join(sets.select(F.col("id").alias("ref"), F.col("shingles").alias("of_ref")), "ref")
    differs = F.concat(F.array_except("shingles", "of_ref"), F.array_except("of_ref", "shingles"))
    both = scratch.cut(both.select("ref", "id", "component", "root", F.size("shingles").alias("size"), F.size("of_ref").alias("ref_size"), differs.alias("differs")))
    total, apart = F.col("size") + F.col("ref_size"), F.size("differs")
    return both.select("*", (2 * apart / (total + apart)).alias("distance"), (100 * (total - apart) >= percent * (total + apart)).alias("linked"))


def _by_difference(near: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components, one of them not linked to the reference, that share enough of their differences from it.

    With x not linked to the reference h, a link x-y means that they share more than (|y - h| + c (|h| - |y|)) / 2 of the shingles in
    which they differ from h, c = (1 - threshold) / (1 + threshold). So one of the first |y - h| - that many in any order is shared.
    """
    c = (1 - threshold) / (1 + threshold)
    need = F.floor((F.size("differs") + c * (F.col("ref_size") - F.col("size"))) / 2 - 1e-9) + 1
    outer = F.expr("component <> root AND NOT linked")
    often = near.where(outer).select("ref", F.explode("differs").alias("e")).groupBy("ref", "e").agg(F.count("*").alias("f"))
    facts = F.struct("id", "component", "size", F.size("differs").alias("d"), outer.alias("outer"), (F.size("differs") - need + 1).cast("int").alias("first"))
    every = near.select("ref", facts.alias("of"), "differs").select("ref", "of", F.explode("differs").alias("e"))
    listed = every.join(often, ["ref", "e"], "left").groupBy("ref", "of").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "e"))).alias("es"))
    placed = listed.select("ref", "of", F.posexplode("es").alias("p", "s")).where("s.f > 0").select("ref", F.col("s.e").alias("e"), "of", "p")
    x = placed.where("of.outer").select("ref", "e", F.col("of").alias("x"), F.col("p").alias("px"))
    y = placed.where("p < of.first").select("ref", "e", F.col("of").alias("y"), F.col("p").alias("py"))
    # the first shingle shared, in the common order, leaves no more to share than stands behind it on either side
    shared = f"(x.d + y.d - {c!r} * (x.size + y.size)) / 2 - 1e-9"
    pairs = x.join(y, ["ref", "e"]).where(f"x.component <> y.component AND x.d - px >= {shared} AND y.d - py >= {shared}")
    return pairs.select(*_ordered(F.col("x.id"), F.col("y.id"))).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, n: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets of n-word shingles (words are separated by the six
    ASCII blanks, A-Z lowered; a text of fewer words is one shingle). class_id is the least id with the same set, component_id
    the least id reachable by links, kept says that it is the document's own.

    Defined results: null, empty and blank texts have no shingles and link with nothing; a null id links with nothing, has a
    null component and is kept; rows that repeat an id are judged each by its own text, rows that repeat id and text alike (so that of
    both the id is kept; without_near_duplicates() leaves one row); an empty table gives no rows. Only the key and text columns
    are read.
    """
    return judged(docs, key, text, percent, n, scratch).select("doc_id", "n_shingles", "class_id", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, n: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, one of each group of linked ones: of the least id and, if several rows have it, of the least text by hash.

    Rows go, not ids: another text of the same id stays unless its own group has one before it. Rows without an id or without
    words stay. Columns of any name are carried along. Texts aren't shuffled unless they repeat an id.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-duplicates")
    every = scratch.keep(judged(docs, key, text, percent, n, scratch), "judged")
    usable = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    own, one, two = spare(docs, "_own", "_t1", "_t2")
    gone, id_of = usable.where("NOT kept"), F.col(f"`{key}`").cast("long")
    twice = scratch.keep(usable.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("again")), "twice")
    repeats, again = not twice.isEmpty(), F.col("doc_id") == F.col("again")
    # an id that one row with words has tells that row, so texts meet ids alone; rows of repeated ids are told by their text
    alone = scratch.keep((gone.join(twice, again, "left_anti") if repeats else gone).select(F.col("doc_id").alias(own)), "gone")
    out = docs.join(alone, (id_of == F.col(own)) & (F.length(F.btrim(F.col(f"`{text}`"), F.lit(BLANKS))) > 0), "left_anti")
    if repeats:
        name = [F.col("doc_id").alias(own), F.col("t1").alias(one), F.col("t2").alias(two)]
        hashed = lambda df: df.select("*", *[h.alias(x) for h, x in zip(text_hash(F.col(f"`{text}`")), (one, two), strict=True)])
        same = lambda rows, marks: (id_of == F.col(own)) & (rows[one] == marks[one]) & (rows[two] == marks[two])
        first = usable.where("kept").groupBy("group").agg(F.min(F.struct("doc_id", *TEXT)).alias("least")).select("least.*")
        marks = scratch.keep(first.join(twice, again, "left_semi").select(*name), "first")
        rows = hashed(docs)
        more = rows.join(marks, same(rows, marks), "left_semi").dropDuplicates([key, one, two])
        marks, rows = scratch.keep(usable.join(twice, again, "left_semi").select(*name).distinct(), "repeats"), hashed(out)
        out = rows.join(marks, same(rows, marks), "left_anti").unionByName(more)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def judged(docs: DataFrame, key: str, text: str, percent: int, n: int, scratch: Scratch | None = None) -> DataFrame:
    """near_duplicates() and, for every row, its TEXT and the group (a number) that its text is linked with."""
    scratch = scratch or Scratch(docs.sparkSession, "near-duplicates")
    signed = scratch.keep(signatures(docs, key, text, n), "signed")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    numbered = usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("class_id")).withColumn("node", F.monotonically_increasing_id())
    classes = scratch.keep(numbered, "classes")
    own = classes.select(F.col("class_id").alias("doc_id"), "f1", "f2", "node")
    facts = F.first(F.struct(F.col("n_shingles"), F.col("registers"), F.col("bands"))).alias("of")
    chosen = usable.join(own, ["doc_id", "f1", "f2"]).groupBy("doc_id", "f1", "f2", "node").agg(facts, F.count("*").alias("copies"))
    reps = scratch.keep(chosen.select("node", "doc_id", "f1", "f2", "copies", "of.*"), "reps")
    texts = _Texts(docs, reps, key, text, n, not reps.where("copies > 1").isEmpty())
    banded = reps.select(F.explode("bands").alias("key"), F.col("node").alias("id"), F.col("n_shingles").cast("int").alias("size"))
    full = banded.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("other"), F.count("*").alias("n")).where("lead <> other").drop("other")
    ranked = scratch.keep(banded.join(full, "key"), "members")
    threshold = percent / 100

    def link(pairs: DataFrame) -> DataFrame:
        return scratch.cut(_confirmed(scratch.cut(_likely(pairs, reps, threshold)), texts, percent, scratch))

    star = scratch.cut(_star(ranked))
    links = link(scratch.cut(_first(star)))
    links = links.unionByName(link(scratch.cut(_second(star, connected_components(links, scratch)))))
    components = connected_components(links, scratch)
    opened = scratch.cut(_open(ranked, components))
    left = ["key", "id", "size", "component", "far", "distance"]
    members = opened.where(f"n <= {SMALL}").withColumn("far", F.lit(True)).withColumn("distance", F.lit(None).cast("double")).select(*left)
    large, more = opened.where(f"n > {SMALL}"), None
    if not large.isEmpty():
        large = scratch.cut(_referred(large, links))
        told = _differences(large, texts, percent, scratch)
        more = _by_difference(told.where(F.col("distance") <= FAR), threshold)
        beyond = told.where(F.col("distance") > FAR - (1 - threshold) - 1e-9).select("ref", "id", (F.col("distance") > FAR).alias("far"), "distance")
        members = members.unionByName(large.join(beyond, ["ref", "id"]).select(*left))
        links = links.unionByName(told.where("linked").select(F.col("id").alias("src"), F.col("ref").alias("dst")))
    members, number = scratch.cut(_placed(members)), 1
    while more is not None or not members.isEmpty():
        pairs = _round(members, number, threshold)
        pairs = scratch.cut(pairs if more is None else pairs.unionByName(more).distinct())
        more, number = None, number + 1
        members = members.where(f"n > {SMALL} AND n > {_leaders(number)[0]}")
        found = None if pairs.isEmpty() else link(pairs)
        if number == 2 or found is not None and not found.isEmpty():
            links = links if found is None else links.unionByName(found)
            components = connected_components(links, scratch)
            renamed = members.drop("component").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
            members = scratch.cut(renamed.select(*members.columns))
    linked = classes.join(components.withColumnRenamed("id", "node"), "node").select("node", "component", "class_id")
    least = linked.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = classes.join(linked.join(least, "component").select("node", F.col("component").alias("group"), "component_id"), "node", "left")
    named = named.select("f1", "f2", "class_id", F.coalesce("group", "node").alias("group"), F.coalesce("component_id", "class_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2", *TEXT).join(named, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", class_id.alias("class_id"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "group", *TEXT)


def _open(ranked: DataFrame, components: DataFrame) -> DataFrame:
    """The members of buckets that have several components, with their component."""
    now = ranked.join(components, "id", "left").select("key", "id", "size", "lead", "n", F.coalesce("component", "id").alias("component"))
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return now.join(mixed, "key", "left_semi")


def _placed(members: DataFrame) -> DataFrame:
    """Members of buckets where some are far, with n (members left in the bucket) and a place among the leaders to come, by hash."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.max("far").alias("some")).where("some AND n > 1").select("key", "n")
    place = (F.pmod(F.xxhash64("id", "key"), F.col("n")) + 1).cast("long").alias("place")
    return members.join(sizes, "key").select(*members.columns, place, "n")
