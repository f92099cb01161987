"""Contamination against a brute-force version that lays every item along every place of every document."""

from __future__ import annotations

import math
import random
import re
import time

import pyarrow as pa
import pytest

from farness.llm import decontamination
from farness.llm.decontamination import Overlap, SeedIndex, contaminated, decontaminated, text_words

DOCS = "doc_id long, text string"


def words_of(text):
    return [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


def brute(texts, items, rule=Overlap()):
    """{(text, item): (matched words, first word)}: runs of matching words, no two more than four apart, half of the words at least;
    items of fewer than 12 words match in full at one place."""
    out = {}
    for d, text in enumerate(texts):
        own = words_of(text)
        for k, item in enumerate(map(words_of, items)):
            n = len(item)
            if n < rule.least_item:
                continue
            total, first = set(), math.inf
            for start in range(1 - n, len(own)):
                if n < 12 and own[max(0, start) : start + n] != item:
                    continue
                runs = []
                for j in range(n):
                    if 0 <= start + j < len(own) and own[start + j] == item[j]:
                        if runs and j - runs[-1][-1] <= 4:
                            runs[-1].append(j)
                        else:
                            runs.append([j])
                for r in runs:
                    if len(r) >= min(rule.least_run, n) and 2 * len(r) >= r[-1] - r[0] + 1:
                        total |= set(r)
                        first = min(first, start + r[0])
            if len(total) >= (n if n < 12 else max(rule.least_item, min(rule.words, math.ceil(rule.share * n)))):
                out[d, k] = (len(total), first)
    return out


def found(texts, items):
    index = SeedIndex(list(range(len(items))), items, Overlap())
    return {(d, name): (matched, first) for d, k, matched, first in index.held(*text_words(pa.array(texts))) for name in index.ids[k]}


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(monkeypatch, seed):
    rng = random.Random(seed)
    # few words, so that windows repeat within items and documents
    vocabulary = [f"w{i}" for i in range((3, 8, 40, 400)[seed])]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(draw(rng.choice((3, 5, 8, 12, 20, 33)))) for _ in range(10)] + ["0 " * 30, "0 1 " * 14, "1 0 0 " * 9, items_end := "w1 w2 w0 " * 7 + "end of it all", items_end]
    texts = [None, "", "w1", "0 " * 90, "x " + "0 1 " * 60 + "y", "0 0 1 " * 25 + "0 " * 40]
    for _ in range(25):
        body = draw(rng.randint(0, 60))
        own = rng.choice(items).split()
        own = [w if rng.random() > rng.choice((0, 0.1, 0.3)) else rng.choice(vocabulary) for w in own]
        at = rng.randint(0, len(body))
        texts.append(" ".join(body[:at] + own + body[at:]))
    want = brute(texts, items)
    assert found(texts, items) == want and len(want) > 20
    monkeypatch.setattr(decontamination, "CELLS", 50)
    assert found(texts, items) == want


def test_repetitive_texts_stay_cheap():
    began = time.perf_counter()
    assert found(["0 " * 20_000], ["0 " * 400]) == {(0, 0): (400, 0)}
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("block_words", [500_000, 30])
def test_rows_that_hold_an_item_go_whatever_their_ids_are(spark, block_words):
    item = "a passage of the benchmark that some of the documents hold in full"
    rows = [(1, f"before. {item} behind", "x"), (1, "a clean row of the same id", "y"), (None, item, "z"), (None, "clean without an id", "q"), (5, None, "n"), (6, "", "e"), (7, "clean", None), (7, "clean", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").withColumnRenamed("item_id", "share")
    items = spark.createDataFrame([(1, item), (2, "another one that no document holds, as far as anybody here knows it"), (3, None)], "item_id long, text string")
    got = decontaminated(docs, items, block_words=block_words)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [r for r in rows if item not in (r[1] or "")]))
    assert sorted((str(r.doc_id), r.item_id) for r in contaminated(docs, items, block_words=block_words).collect()) == [("1", 1), ("None", 1)]
    assert decontaminated(docs.where("false"), items).isEmpty() and decontaminated(docs, items.where("false")).count() == len(rows)
