"""Odd rows of every operator: nulls, empty tables, repeated rows and ids, long texts, clashing names; and brute-force versions."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from farness.llm import quality_model
from farness.llm.languages import SCRIPTS, Model, has_letter, predict, train, viterbi, word_scores
from farness.llm.licenses import scan_licences
from farness.llm.packing import pack_documents
from farness.llm.quality_model import Passages, features, score, scores
from farness.llm.quality_rules import line_first, mingled, repeated_in_order, whole_places, window_places
from farness.llm.token_files import token_digests, write_token_files
from tests.llm.test_documents import base_counts

DOCS = "doc_id long, text string"


# op1


def bags(seed, n, d):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 5, n)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    layers = {"E": rng.normal(0, 0.5, (d, 4)), "e": rng.normal(0, 0.3, 4), "V": rng.normal(0, 0.5, (4, 3)), "U": rng.normal(0, 0.5, (4, 3)), "w": rng.normal(0, 0.5, 3), "c": rng.normal(0, 1, 4), "b": np.array([0.2])}
    return layers, rng.normal(0, 1, (int(bounds[-1]), d)), bounds, rng.integers(0, 2, n).astype(float), rng.uniform(0.5, 2, n)


def test_the_forward_pass_equals_loops():
    p, x, bounds, _, _ = bags(1, 6, 5)
    got = quality_model._forward(p, x, bounds)["y"]
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        codes, raw = [], []
        for row in x[a:b]:
            h = [math.tanh(sum(row[k] * p["E"][k][j] for k in range(5)) + p["e"][j]) for j in range(4)]
            gate = [math.tanh(sum(h[k] * p["V"][k][j] for k in range(4))) / (1 + math.exp(-sum(h[k] * p["U"][k][j] for k in range(4)))) for j in range(3)]
            codes.append(h)
            raw.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        z = [sum(r / sum(raw) * h[j] for r, h in zip(raw, codes, strict=True)) for j in range(4)]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(a * c for a, c in zip(z, p["c"], strict=True)) - p["b"][0])))


def test_gradients_equal_differences():
    p, x, bounds, label, weight = bags(2, 5, 3)

    def loss(layers):
        y = quality_model._forward(layers, x, bounds)["y"]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum() / weight.sum()

    for name, grad in quality_model._gradients(p, x, bounds, label, weight).items():
        for at in np.ndindex(p[name].shape):
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert grad[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-7), name


def test_quality_of_odd_rows(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["river", "ABC!!", "x$$$", "stone."]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    x, bounds = features(pa.array(texts), Passages())
    model = quality_model.fit(x, bounds, np.array([float(i % 2) for i in range(60)]), Passages(), epochs=5)
    rows = [(1, texts[0], 0.5), (1, texts[0], 0.7), (1, "other", 0.1), (None, texts[0], None), (2, None, 1.0), (3, "", 1.0), (4, "word " * 300_000, 1.0)]
    df = spark.createDataFrame(rows, DOCS + ", score double")
    got = sorted((str(r.doc_id), r.score) for r in score(df, model).collect())
    assert [k for k, _ in got] == ["1", "1", "1", "2", "3", "4", "None"] and got[3][1] == got[4][1]
    same = scores(model, pa.array([texts[0]]))[0]
    assert [v for k, v in got if k == "None"] == [same] and [v for _, v in got].count(same) == 3
    assert score(df.where("false"), model).collect() == []
    # a score doesn't depend on what else is in the slice
    assert scores(model, pa.array(texts)).tolist() == [scores(model, pa.array([t]))[0] for t in texts]


# op4


def test_more_labels_than_a_byte_holds():
    n = 200
    scores_of = np.full((3, n), -5.0, np.float32)
    scores_of[[0, 1, 2], [150, 199, 128]] = 0
    assert viterbi(scores_of, np.array([0, 1, 2, 3]), 1.0).tolist() == [150, 199, 128]


def test_two_hundred_languages(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {f"l{k:03d}": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(4)] for k in range(200)}
    row = lambda lang: " ".join(rng.choice(stems[lang]) for _ in range(20))
    rows = [(i, row(lang), lang) for i, lang in enumerate([*stems] * 3)]
    model = train(spark.createDataFrame(rows, DOCS + ", lang string"))
    asked = spark.createDataFrame([(i, row(lang), lang) for i, lang in enumerate(stems)], DOCS + ", lang string")
    got = predict(asked, model, spans=False).collect()
    assert len(model.langs) == 200 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_predictions_beside_columns_of_the_same_names(spark):
    model = train(spark.createDataFrame([(i, "the river runs", "en") for i in range(5)] + [(9 + i, "der fluss läuft", "de") for i in range(5)], DOCS + ", lang string"))
    df = spark.createDataFrame([(1, "river runs", 0.25, "x"), (1, "river runs", 0.5, None), (None, None, None, "y")], DOCS + ", score double, spans string")
    out = predict(df, model)
    assert out.columns == ["doc_id", "text", "score", "spans", "lang_pred", "_score", "_spans"]
    assert sorted((str(r.doc_id), r.lang_pred, str(r.score), str(r.spans)) for r in out.collect()) == [("1", "en", "0.25", "x"), ("1", "en", "0.5", "None"), ("None", "und", "None", "y")]
    assert predict(df.where("false"), model).collect() == [] and out.select("_score").where("_score > 1").count() == 0


def test_predictions_equal_brute_force(spark):
    rng = random.Random(3)
    words = {"en": ["the", "river", "stone", "wind"], "de": ["der", "fluß", "über", "wind"], "ru": ["река", "мост", "ветер"], "el": ["ποτάμι", "πέτρα"]}
    row = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    model = train(spark.createDataFrame([(i, row(lang, 12), lang) for i, lang in enumerate([*words] * 20)], DOCS + ", lang string"))
    texts = [row(rng.choice([*words]), 3) + rng.choice([" ", ", ", "-", " 12 "]) + row(rng.choice([*words]), rng.randint(1, 4)) for _ in range(40)] + ["", "12", "中文"]
    got = predict(spark.createDataFrame(list(enumerate(texts)), DOCS), model, penalty=3.0).collect()
    scored, bounds, first, last = word_scores(model, pa.array(texts))
    script = lambda c: next((k for k, (_, ranges) in enumerate(SCRIPTS) if any(a <= ord(c) <= b for a, b in ranges)), len(SCRIPTS) - 1)
    for r in got:
        own = scored[bounds[r.doc_id] : bounds[r.doc_id + 1]]
        raw = texts[r.doc_id].encode()
        spans = [(int(a), int(b)) for a, b in zip(first, last, strict=True)][bounds[r.doc_id] : bounds[r.doc_id + 1]]
        # a script that no language uses rules none out, any other all that don't use it
        for s, (a, b) in zip(own, spans, strict=True):
            uses = model.uses[script(raw[a:b].decode()[0])]
            assert not uses.any() or ((s <= -1e5) == ~uses).all()
        best, paths = None, [((), 0.0)]
        for s in own:
            paths = [(p + (k,), v + float(s[k]) - 3.0 * bool(p and p[-1] != k)) for p, v in paths for k in range(len(model.langs))]
            # of all paths that end alike the best goes on
            paths = [max((x for x in paths if x[0][-1] == k), key=lambda x: x[1]) for k in range(len(model.langs))]
        if not has_letter(texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max(paths, key=lambda x: x[1])[0]
        weights = [sum(b - a for (a, b), k in zip(spans, best, strict=True) if k == j) for j in range(len(model.langs))]
        assert r.lang_pred == model.langs[max(range(len(weights)), key=lambda j: (weights[j], -j))], texts[r.doc_id]


def test_a_model_of_no_language_is_empty():
    assert Model([], np.zeros((1, 0)), np.zeros((1, 0), bool), np.zeros(0)).langs == []


# op6, op10


def test_null_and_repeated_ids_of_packed_and_written_documents(spark, tmp_path):
    byte, word = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    rows = [(None, "river stone", 1), (None, None, 1), (5, "wind", 1), (5, "wind", 2), (5, "other wind", 3), (-2, "", 4), (9, "long " * 50_000, 5)]
    df = spark.createDataFrame(rows, DOCS + ", n_tokens int")
    ids = lambda path, t: [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1]
    pieces = pack_documents(df, byte, with_ids=True).collect()
    # documents may be cut anywhere: all ids of an id's rows together are told apart by their counts
    of = lambda pairs: {k: sorted(x for i, own in pairs if str(i) == k for x in own) for k in ("None", "5", "-2", "9")}
    assert of((r.doc_id, r.ids) for r in pieces) == of((i, ids(byte, t)) for i, t, _ in rows)
    path = str(tmp_path / "orc")
    write_token_files(df, path, word, files=3)
    got = sorted(token_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -2, 5, 5, 5, 9]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), zlib.crc32(np.array(ids(word, t), "<u4").tobytes())) for i, t, _ in rows)


# op7


def test_repeated_words_of_texts_of_over_a_million_words(spark):
    rng = random.Random(4)
    words = [str(rng.randrange(90)) for _ in range((1 << 20) + 40_000)]
    text = " ".join(words)
    small = " ".join(words[:3000])
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_first(spark.createDataFrame([(1, text), (2, small)], DOCS)).collect()}
    assert got == {1: base_counts(text), 2: base_counts(small)}


def test_windows_that_agree_in_the_bits_kept_are_told_apart(spark):
    one, other = (7 << 31) | 1, (7 << 31) | 2
    for hashes, want, clash in (([one, other, one, 5 << 40], 5, True), ([one, 1 << 50, one], 5, False), ([other, one], 0, True)):
        df = spark.createDataFrame([(hashes,)], "hs array<long>")
        df = df.select(mingled(df["hs"], window_places(df["hs"])), repeated_in_order(df["hs"], whole_places(df["hs"])))
        assert tuple(df.first()) == (clash, want)


# op8


def test_licences_of_empty_tables_and_long_texts(spark):
    assert scan_licences(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, "plain words here. " * 60_000 + "Released under the MIT License."), (None, "All rights reserved."), (1, "All rights reserved.")]
    assert sorted((str(r.doc_id), r.licences) for r in scan_licences(spark.createDataFrame(rows, DOCS)).collect()) == [("1", "MIT"), ("1", "proprietary"), ("None", "proprietary")]


# pipeline


def test_the_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    words = ["river", "stone", "cloud", "wind", "field", "tree", "house", "road", "night", "morning"]
    prose = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() + "." for _ in range(9))
    item = " ".join(rng.choice(words) for _ in range(24))
    a, b, c, held = prose(), prose(), prose(), prose()
    rows = [(1, a), (1, b), (2, a), (2, c), (None, held + "\n" + item.capitalize() + "."), (None, prose()), (3, c + "\n" + item.capitalize() + "."), (3, held), (4, None), (5, ""), (6, prose()), (6, "again " * 200)]
    rows = [(i, t, "en", "s", len(t or ""), "own", [1]) for i, t in rows]
    schema = DOCS + ", lang string, source string, n_chars long, kept string, _row array<int>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = (stage(spark, x, str(tmp_path)) for x in (docs, empty))
        assert docs.columns == [x.split()[0] for x in schema.split(", ")], name
        docs.write.parquet(f"{tmp_path}/{name}")
        empty.write.parquet(f"{tmp_path}/empty-{name}")
        docs, empty = spark.read.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/empty-{name}")
        assert empty.count() == 0
    # c with the item goes as contaminated only where it isn't a copy of row (2, c) already; rows without an id are decontaminated
    assert sorted((str(r.doc_id), r.text[:20]) for r in docs.collect()) == sorted([("1", a[:20]), ("1", b[:20]), ("2", c[:20]), ("None", rows[5][1][:20]), ("3", held[:20]), ("6", rows[10][1][:20])])
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
