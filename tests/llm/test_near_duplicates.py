"""Near-duplicates against a brute-force version, the parts of the sketch, and the odd cases."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from farness.llm import near_duplicates as nd
from farness.llm.words import shingle_sets

DOCS = "doc_id long, text string"


def shingles_of(text: str | None, n: int = 5) -> set:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = {i: shingles_of(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def edited(rng, words, vocabulary, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        if rng.random() < 0.4:
            del out[k]
        else:
            out[k] = rng.choice(vocabulary)
    return " ".join(out)


def corpus(seed: int, families: int, copies: int):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((60, 90, 150)))]
        texts += [edited(rng, base, vocabulary, rng.choice((0, 0, 1, 1, 2, 2, 3, 4, 8))) for _ in range(copies)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize(("seed", "families", "copies", "percent", "small"), [(1, 12, 8, 85, 64), (2, 2, 90, 85, 3), (3, 3, 60, 80, 1), (4, 1, 200, 85, 8)])
def test_components_equal_brute_force(spark, monkeypatch, seed, families, copies, percent, small):
    monkeypatch.setattr(nd, "SMALL", small)
    rows = corpus(seed, families, copies)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, DOCS), percent=percent).collect()}
    assert got == brute(rows, percent)


def test_odd_rows_have_defined_results(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (None, "one two"), (6, "one two three"), (4, "one two")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, kept int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (6, 1, 6, True)], key=str)
    assert nd.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_a_long_text_is_whole(spark):
    words = [f"v{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["other"])), (3, " ".join(words[:30_000]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (59_996, 1), 2: (59_996, 1), 3: (29_996, 3)}


def test_registers_keep_order_and_estimates_are_near():
    values = np.sort(np.random.default_rng(1).integers(1, 1 << 57, 2000).astype(np.uint64))
    packed = nd.compress(values).astype(int)
    leading, mantissa = packed >> nd.MANTISSA, packed & ((1 << nd.MANTISSA) - 1)
    assert (np.diff(-leading * (1 << nd.MANTISSA) + mantissa) >= 0).all()
    assert all(57 - int(v).bit_length() == k for v, k in zip(values, leading, strict=True))
    base = [f"a{i}" for i in range(3000)]
    texts = [" ".join(base), " ".join(base[300:] + [f"b{i}" for i in range(300)])]
    sets = shingle_sets(pa.array(texts))
    regs = nd.registers(sets)
    sizes = np.array([len(s) for s in sets])
    share, used = nd.estimated(regs[:1], regs[1:], sizes[:1], sizes[1:])
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs(share[0] - true) < 4 * (true * (1 - true) / used[0]) ** 0.5


def test_filled_registers_agree_for_equal_sets_and_have_no_gaps():
    sets = shingle_sets(pa.array(["a b c d e", "a b c d e f g h", "A B C D E"]))
    full = nd.filled(nd.registers(sets))
    assert (full != 0xFFFF).all() and (full[0] == full[2]).all() and (nd.band_keys(nd.registers(sets))[0] == nd.band_keys(nd.registers(sets))[2]).all()


def test_shingles_equal_brute_force():
    texts = [t for _, t in corpus(5, 4, 6)] + [None, "", "x", " É  É a\x0bb\x0cc d"]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingles_of(t)) for t in texts]


def copies_of(rng, n=60):
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    return " ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"u{rng.randrange(5000)}" for _ in range(n))


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    x, edited, unrelated = copies_of(random.Random(8))
    rows = [(3, x), (7, edited), (7, unrelated), (9, unrelated + " tail"), (5, unrelated.upper()), (5, x), (12, "one two three"), (12, "one two three")]
    got = {(r.doc_id, i): (r.component_id, r.kept) for i, r in enumerate(sorted(nd.near_duplicates(spark.createDataFrame(rows, DOCS)).collect(), key=lambda r: (r.doc_id, r.n_shingles, r.component_id)))}
    assert sorted((k[0], *v) for k, v in got.items()) == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 3, False), (7, 5, False), (9, 5, False), (12, 12, True), (12, 12, True)]
    alone = spark.createDataFrame([(3, x), (7, edited), (7, unrelated)], DOCS)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(alone).collect()) == [(3, 3, True), (7, 3, False), (7, 7, True)]


def test_one_row_of_each_group_stays(spark):
    x, edited, unrelated = copies_of(random.Random(9))
    rows = [(3, x, "a"), (7, edited, "b"), (7, unrelated, "c"), (8, "alone here", "d"), (8, "alone here", "d"), (None, x, "e"), (None, x, "e"), (9, None, "f"), (9, "", "g"), (4, unrelated + " end", "h"), (3, edited, "i"), (20, x + " y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t1 string").withColumnRenamed("t1", "_t1")
    out = nd.without_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r["_t1"]) for r in out.collect())
    # of the two rows of id 3 that are linked, one stays, that of the least text by hash
    assert len([k for k in got if k[0] == "3"]) == 1
    assert [k for k in got if k[0] != "3"] == sorted([("4", "h"), ("8", "d"), ("None", "e"), ("None", "e"), ("9", "f"), ("9", "g")])
    assert nd.without_near_duplicates(df.where("false")).count() == 0
    single = spark.createDataFrame([r[:2] for r in rows if r[0] not in (3, 7, 8, 9)] + [(3, x)], DOCS)
    assert sorted(str(r.doc_id) for r in nd.without_near_duplicates(single).collect()) == ["3", "4", "None", "None"]


def test_copies_of_one_text_are_confirmed_about_once_each(spark, monkeypatch):
    # every band has a leader of its own, and all of a group's members share most bands: one meeting joins them
    rng, words = random.Random(9), [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in rng.sample(range(300), 200)]
    rows, asked, confirmed = list(enumerate(texts)), [], nd._confirmed
    monkeypatch.setattr(nd, "_confirmed", lambda pairs, *a: asked.append(pairs.count()) or confirmed(pairs, *a))
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, DOCS), percent=85).collect()}
    assert got == dict.fromkeys(range(200), 0) and sum(asked) < 2 * len(rows)
