"""The row-wise operators on odd rows and against brute force: rules, licences, URLs, contamination, languages, quality, tokens."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from farness.llm.decontamination import Overlap, SeedIndex, contaminated, text_words
from farness.llm.languages import Model, predict, train, viterbi
from farness.llm.licenses import CUES, SENTENCES, scan_licences
from farness.llm.packing import LevelPacker, pack_documents
from farness.llm.quality_model import fit, features, Passages, score, scores
from farness.llm.quality_model import train as train_quality
from farness.llm.quality_rules import LineRules, line_first, near_capitals, repeated_words, window_places
from farness.llm.token_files import file_starts, read_token_files, token_digests, write_token_files
from farness.llm.tokens import PieceEncoder, with_end
from farness.llm.url_filter import boost, judge, rule_for, suffix_shares
from farness.llm.url_filter import train as train_urls

DOCS = "doc_id long, text string"
BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


# op7


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {p for places in at.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules_count_and_judge(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "é", "x", "lo")]
    prose = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(n // 9)) + "."
    texts = [None, "", " \n\t", "a b a b a b a b", prose(90), "SHOUT!! " * 60, prose(90) + "\nHome | About | News | Contact", "\n".join(f"w{i}$$$ x{i}&&&" for i in range(60)), "  lead\x0bin " * 20, "x\nx\n \nx", prose(400) + "\n" + prose(400)]
    texts += [" ".join(rng.choice(words[:6]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 7, "own") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, _w string")
    got = {r.doc_id: r for r in line_first(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["_n_words"], r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(t), i
        assert r.base_failed == (r["_n_words"] < 50 or 100 * r.n_repeat_words > 50 * r["_n_words"]) and (r.n_words, r["_w"]) == (7, "own")
    assert got[4].kept and got[4].clean_text == texts[4]
    assert got[6].kept and got[6].clean_text == texts[6].split("\n")[0] and got[6].n_lines_failed == 1
    assert not got[5].kept and not got[7].kept
    assert line_first(spark.createDataFrame([], DOCS)).count() == 0


def test_spaced_capitals_are_judged_alike_beside_a_symbol(spark):
    prose = ". ".join("the river runs under stone" for _ in range(12)) + "."
    heads = ["C O N T E N T S", "A B C D E F G", "A-B-C-D-E-F-G", "AbCdEfGhIjKl", "A b C d E F g H I"]  # the last two: half and less
    rows = [(i, f"{x}\n{prose}") for i, x in enumerate(heads)] + [(i + 100, f"{x}\n{prose}\na & b, and so on, as all of this says") for i, x in enumerate(heads)]
    got = {r.doc_id: r.n_lines_failed for r in line_first(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i] for i in range(5)] == [got[100 + i] for i in range(5)] == [1, 1, 1, 0, 0]


@pytest.mark.parametrize("max_upper", [0.02, 0.1, 0.25, 0.34, 0.5, 0.7])
def test_lines_of_too_many_capitals_have_two_near(max_upper):
    rng, rules = random.Random(9), LineRules(max_upper=max_upper)
    for n in range(12, 60):
        for k in (int(max_upper * n) + 1, min(n, int(max_upper * n) + 2)):
            even = {i * n // k for i in range(k)}
            for at in [even, {i * (n - 1) // max(1, k - 1) for i in range(k)}, *(set(rng.sample(range(n), k)) for _ in range(20))]:
                line = "".join("A" if i in at else "x" for i in range(n))
                assert line.count("A") <= max_upper * n or re.search(near_capitals(rules), line)


def test_windows_of_long_texts_are_compared_by_whole_hashes(spark):
    one, other = (7 << 31) | 1, (7 << 31) | 2
    hashes = [one, other, one] + [i << 33 for i in range(3, 1 << 20)]
    df = spark.createDataFrame([(hashes,)], "hs array<long>")
    df = df.select("hs", window_places(df["hs"]).alias("ws"))
    assert [r[0] for r in df.select(repeated_words(df["hs"], df["ws"])).collect()] == [5]


# op8


def test_licence_sentences_hold_a_cue():
    assert all(any(c in s for c in CUES) and re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", s) for s in SENTENCES)


def test_licences(spark):
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"]
    bsd += ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."]
    bsd += ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions\nand the following disclaimer in the documentation."]
    texts = {1: None, 2: "", 3: "No licence here.", 4: "x\nLicensed under the Apache License, Version 2.0.\ny", 5: "RELEASED UNDER THE MIT LICENSE", 6: " ".join(bsd), 7: "All rights reserved.\nLicensed under CC BY-NC 4.0.", 8: "All rights reserved. All rights reserved."}
    df = spark.createDataFrame([(i, t, "own") for i, t in texts.items()], "doc_id long, text string, category string")
    got = {r.doc_id: (r.licences, r["_category"], r.line_ids) for r in scan_licences(df).collect()}
    none = ("", "none", "")
    assert got[1] == got[2] == got[3] == none
    assert got[4] == ("Apache-2.0", "permissive", "A1") and got[5][:2] == ("MIT", "permissive") and got[6][:2] == ("BSD-2-Clause", "permissive")
    assert got[7][:2] == ("CC-BY-NC-4.0,proprietary", "reserved") and got[8][2] == "R1,R1"


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def licences_of(spark, texts):
    rows = scan_licences(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    return [(r.line_ids, r.paragraph_ids, r.licences, r.category) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_licence_sentences_with_a_colon_within(spark):
    tags = ["MIT", "Apache-2.0", "GPL-3.0-only", "BSD-3-Clause"]
    got = licences_of(spark, [*(f"// SPDX-License-Identifier: {x}\nint x;" for x in tags), GPL, GPL.replace(":", ";"), "SPDX-License-Identifier: x\n\nMIT", "Terms: All rights reserved; SPDX-License-Identifier: Licensed under the MIT License"])
    assert got[:4] == [("M4", "", "MIT", "permissive"), ("A4", "", "Apache-2.0", "permissive"), ("G3", "", "GPL-3.0", "copyleft"), ("B5", "", "BSD-3-Clause", "permissive")]
    assert got[4:6] == [("", "G2", "GPL-3.0", "copyleft")] * 2 and got[6] == ("", "", "", "none") and got[7][0] == "R1,M1"


def test_a_notice_parted_by_any_blank_is_reserved(spark):
    texts = [f"(c) 2020 Acme. All rights{x}reserved." for x in ("\n", "\t", "  ", "-", " ")]
    assert [x[1:] for x in licences_of(spark, texts)] == [("R1", "proprietary", "reserved")] * 5


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_2 = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""


def test_verbatim_licence_texts(spark):
    got = licences_of(spark, [MIT, BSD_2 + BSD_END, BSD_2 + BSD_3 + BSD_END, APACHE])
    assert [x[1:] for x in got] == [
        ("M2,M3,W1", "MIT", "permissive"),
        ("B0,B1,B2", "BSD-2-Clause", "permissive"),
        ("B0,B1,B2,B3", "BSD-3-Clause", "permissive"),
        ("A1,A2,A3", "Apache-2.0", "permissive"),
    ]


# op2


def test_urls(spark):
    urls = ["http://A.example.ORG/es/1?x", "https://example.org/en/12", "ftp://b.com/fr", "http://b.com/fr/", "http://b.com/de/x#y", "http://org", "http://org/", "notorg/", None, "", "x://", "http://deep.example.org?q=/es/", "http://a.example.org/en/2"]
    rows = {r.page_id: r for r in judge(spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string"), None).collect()}
    assert [rows[i].host for i in range(len(urls))] == ["a.example.org", "example.org", "b.com", "b.com", "b.com", "org", "org", "", "", "", "", "deep.example.org", "a.example.org"]
    assert [rows[i].path for i in range(len(urls))] == ["/es/1", "/en/12", "/fr", "/fr/", "/de/x", "", "/", "", "", "", "", "", "/en/2"]
    assert [rows[i].rule for i in range(len(urls))] == ["example.org/es/", "example.org/en/1", None, "com/fr/", "com/de/", None, "org/", None, None, None, None, None, "org/"]
    assert [rows[i].verdict for i in range(len(urls))] == ["block", "block", "allow", "allow", "block", *["allow"] * 8]


def test_trees_learn_marked_hosts(spark):
    rng = random.Random(2)
    bad = [f"http://{rng.choice(['', 'www.'])}{w}-{x}.example.net/{rng.randint(1, 999)}" for w in ("casino", "cheap", "free") for x in ("win", "pills", "bets", "spam") for _ in range(20)]
    good = [f"http://{rng.choice(['', 'www.', 'm.'])}{w}.example.{s}/en/{rng.randint(1, 999)}" for w in ("thing", "river", "stone", "cloud") for s in ("org", "net") for _ in range(30)]
    rows = [(i, u, int(u in set(bad))) for i, u in enumerate(bad + good)]
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = {r.page_id: r.verdict for r in judge(df, train_urls(df.where("page_id % 3 <> 0"), label="label"), rules=()).collect()}
    assert np.mean([(got[i] == "block") == bool(y) for i, _, y in rows if i % 3 == 0]) > 0.97
    assert train_urls(df.where("label = 0"), label="label") is None and train_urls(spark.createDataFrame([], "url string")) is None


def test_a_bounded_sample_keeps_the_share_of_bad_urls(spark):
    rows = [(i, f"http://www.a{i:04d}.example.net/{i:04d}", int(i % 20 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    model = train_urls(df, label="label", sample=80)
    assert model.base == pytest.approx(np.log(0.05 / 0.95)) and model.suffixes["net"] == pytest.approx(0.05)


def test_boosting_splits_where_labels_change():
    x = np.arange(200, dtype=float)[:, None]
    model = boost(x, (x[:, 0] > 70).astype(float), suffix_shares(["a.b"] * 200, np.ones(200)))
    assert ((model.margin(x) > 0) == (x[:, 0] > 70)).mean() > 0.95


# op3


def test_contamination_with_substitutions(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, draw(n)) for k, n in enumerate((40, 25, 15, 8, 5, 3))]
    docs, want = [], set()
    for k, words in items:
        for change in (0, 0.12):
            own = [rng.choice(vocabulary) if len(words) > 20 and rng.random() < change else w for w in words]
            docs.append((len(docs), " ".join(draw(100) + ["Start."] + [f"{own[0].upper()},", *own[1:]] + draw(100))))
            if len(words) >= 5:
                want.add((len(docs) - 1, k))
    docs += [(100 + i, " ".join(draw(300))) for i in range(50)] + [(900, None), (901, ""), (None, " ".join(items[0][1]))]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(70, None), (71, ""), (72, " ".join(items[1][1]))], "item_id long, text string")
    df = spark.createDataFrame([(*d, "q") for d in docs], DOCS + ", share string")
    for block_words in (500_000, 40):
        got = {(r.doc_id, r.item_id) for r in contaminated(df, table, block_words=block_words).collect()}
        assert got == want | {(None, 0)} | {(d, 72) for d, k in want if k == 1}
    assert contaminated(df, table.where("false")).count() == 0 and contaminated(df.where("false"), table).count() == 0


def test_seeds_find_all_that_is_accepted():
    rng, rule = random.Random(11), Overlap()
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (12, 16, 20, 32, 64) for _ in range(4)]
    index, texts = SeedIndex(list(range(len(items))), [" ".join(x) for x in items], rule), []
    for x in items:
        texts += [[w if i % k else "other" for i, w in enumerate(x)] for k in (2, 3, 4)]
        texts += [[w if rng.random() > share else "other" for w in x] for share in (0.2, 0.3, 0.4, 0.5) for _ in range(10)]
    hashes, bounds = text_words(pa.array([" ".join(["before", *x, "behind"]) for x in texts]))
    want = set()
    for d, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        for k, own in enumerate(index.items):
            total = np.zeros(own.size, bool)
            for start in range(-own.size + 1, b - a):
                total |= index.matches(hashes[a:b], own, start)[0]
            if total.sum() >= max(rule.least_item, min(rule.words, -(-6 * own.size // 10))):
                want.add((d, k, int(total.sum())))
    assert {x[:3] for x in index.held(hashes, bounds)} == want and len(want) > 300


# op4


def test_languages_and_spans(spark):
    texts = {"en": "the river runs under the old stone bridge and the wind turns", "de": "der fluss und die alte brücke schön über den häusern", "ru": "река течет под старым мостом и ветер"}
    rng = random.Random(4)
    row = lambda lang: " ".join(rng.choice(texts[lang].split()) for _ in range(12))
    rows = [(i, row(lang), lang) for i, lang in enumerate(["en", "de", "ru"] * 40)] + [(500, None, "en"), (501, "text", None)]
    model = train(spark.createDataFrame(rows, DOCS + ", lang string"))
    mixed = f"{texts['en']}. {texts['de']}. {texts['ru']}"
    asked = [(1, row("en")), (2, row("de")), (3, row("ru")), (4, None), (5, ""), (6, "12 34 ...!"), (7, mixed), (8, texts["de"].upper() + " " + texts["de"])]
    got = {r.doc_id: r for r in predict(spark.createDataFrame(asked, DOCS), model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "ru", "und", "und", "und"] and got[8].lang_pred == "de"
    assert [s.lang for s in got[7].spans] == ["en", "de", "ru"] and got[4].spans == [] and all(0 <= r.score <= 1 for r in got.values())
    raw = mixed.encode()
    assert raw[got[7].spans[1].start : got[7].spans[1].stop].decode() == texts["de"]
    assert train(spark.createDataFrame([], DOCS + ", lang string")) is None
    assert predict(spark.createDataFrame(asked, DOCS), None).where("lang_pred <> 'und'").isEmpty()


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(0, 6, 4)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        values = rng.normal(0, 2, (int(bounds[-1]), 3)).astype(np.float32)
        got = viterbi(values, bounds, 1.5)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            worth = lambda path: sum(values[a + i, k] for i, k in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            paths = [[]]
            for _ in range(b - a):
                paths = [[*p, k] for p in paths for k in range(3)]
            assert worth(got[a:b].tolist()) == pytest.approx(max(map(worth, paths)), abs=1e-4)


# op1


def test_quality_model_learns_from_bags(spark):
    rng = random.Random(6)
    clean = lambda n: " ".join(rng.choice(["river", "stone", "cloud", "wind"]) for _ in range(n)) + "."
    junk = lambda n: " ".join(rng.choice(["ABC!!", "x$$$", "| y |", "&&&"]) for _ in range(n))
    rows = [(i, clean(150) + "\n" + (junk(300) if i % 3 == 0 else clean(200)), int(i % 3 != 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "x")], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(901, None), (None, 1), (5, 9)], "doc_id long, quality int")
    model = train_quality(docs, labels)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 2 == 0]) > 0.97
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    alone = scores(model, pa.array([rows[7][1]]))[0]
    assert alone == pytest.approx(got[7], abs=1e-6)
    assert train_quality(docs, labels.where("false")) is None and scores(None, pa.array(["x"])).tolist() == [0.5]


def test_passages_cover_the_whole_text():
    x, bounds = features(pa.array([None, "", "a" * 599, "b " * 400, "c " * 100_000]), Passages())
    assert np.diff(bounds).tolist() == [1, 1, 1, 2, 64] and x.shape[0] == 69
    assert np.expm1(x[5:, -1]).sum() == pytest.approx(200_001, rel=1e-4)


def test_training_is_the_same_again():
    x, bounds = features(pa.array(["abc def", "ABC!! DEF!!"] * 20), Passages())
    label = np.array([1.0, 0.0] * 20)
    one, two = (fit(x, bounds, label, Passages(), epochs=3) for _ in range(2))
    assert all((one.layers[k] == two.layers[k]).all() for k in one.layers)


# tokens, op6, op10


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_the_whole_tokenizer(path):
    rng = random.Random(7)
    encoder = PieceEncoder(path, most=200, most_atoms=50)
    assert encoder.kind and encoder.plain
    fixed = [None, "", " ", "   ", "\n", "a\n\nb", " a  b ", "a   b", "a \n b\n", "x\n\n  y", "don't we'LL", "<|endoftext|> a<|endoftext|>b", "é ́x", "İΣ ς", "\u00a0 x \u3000 y", "ÀÉ.,\nÿ 12", "日本 語"]
    for _ in range(20):
        texts = fixed + [" ".join("".join(rng.choice("abÉßüÑ'1.,!\n;-") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 25))) for _ in range(40)]
        ids, at = encoder.encode(pa.array(texts))
        want = [x.ids for x in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def true_ids(path, texts):
    return {i: np.array([*x.ids, 1], "<u4") for i, x in zip(texts, Tokenizer.from_file(path).encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}


def words_of(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["river", "stone.", "Ünder", "wind,", "\nthe", "x1"]) for _ in range(n))


def test_packing_is_whole_and_tight(spark):
    texts = {i: words_of(i, n) for i, n in enumerate([0, 1, 5, 700, 900, 3000, 40, 2048, 333, 5000, 17])} | {50: None, 51: ""}
    ids = true_ids(BYTE, texts)
    df = spark.createDataFrame([(i, t, 3) for i, t in texts.items()], DOCS + ", length int").repartition(3)
    rows = pack_documents(df, BYTE, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[i][at : at + r.length]
            assert r.start == at and r.doc_tokens == ids[i].size and r.ids == part.tolist() and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == ids[i].size
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert pack_documents(df.where("false"), BYTE).count() == 0


def test_levels_follow_the_sum_of_squares():
    rng = random.Random(8)
    packer, levels = LevelPacker(16, most_open=6), []
    for _ in range(300):
        n = rng.randint(1, 15)
        counts = [int(packer.levels[k]) for k in range(16)]
        before = sum(c * c for c in counts)

        def after(level):
            new = list(counts)
            new[level] -= level > 0
            if level + n < 16:
                new[level + n] += 1
            return sum(c * c for c in new) - before

        options = [0] + [k for k in range(1, 16) if counts[k] and k + n <= 16]
        best = min(map(after, options))
        assert packer.choose(n) == max(k for k in options if after(k) == best)
        levels += packer.add(0, np.arange(n, dtype=np.uint32))
        assert packer.n_open <= 6
    levels += packer.finish()
    assert all((s := sum(p[2].size for p in w)) == 16 or s & (s - 1) == 0 for w in levels)


def test_token_files_round_trip_and_prune(spark, tmp_path):
    texts = {i * 3: words_of(i, 5 + i % 60) for i in range(400)} | {5000: None, 5001: ""}
    ids = true_ids(WORD, texts)
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], DOCS + ", ids int").repartition(5)
    path = str(tmp_path / "orc")
    write_token_files(df, path, WORD, files=4, index_rows=1000)
    got = {r.doc_id: r for r in token_digests(spark, path).collect()}
    at = 0
    for i in sorted(texts):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, ids[i].size, zlib.crc32(ids[i].tobytes()))
        at += ids[i].size
    assert len(file_starts(spark, path)) == 4
    one = read_token_files(spark, path).where("doc_id = 300").select("doc_id", "n_tokens")
    assert one.count() == 1 and "EqualTo(doc_id,300)" in one._jdf.queryExecution().toString()
    assert "struct<doc_id:bigint,n_tokens:bigint>" in one._jdf.queryExecution().toString()
    from pyarrow import orc

    footer = [orc.ORCFile(p) for p in (tmp_path / "orc").glob("*.orc")]
    assert sum(f.nrows for f in footer) == len(texts) and all(f.compression == "ZSTD" for f in footer)
    write_token_files(df.where("false"), str(tmp_path / "empty"), WORD)
    assert token_digests(spark, str(tmp_path / "empty")).count() == 0


def test_with_end():
    ids, at = with_end(np.array([5, 6, 7], np.uint32), np.array([0, 2, 2, 3]), 1)
    assert ids.tolist() == [5, 6, 1, 1, 7, 1] and at.tolist() == [0, 3, 4, 6]


def test_rules_are_by_length(spark):
    df = spark.createDataFrame([("a.b.c", "/x/y")], "h string, p string")
    rule, verdict = rule_for(df["h"], df["p"], (("allow", "c/"), ("block", "b.c/x"), ("allow", "a.b.c/x/y")))
    assert tuple(df.select(rule, verdict).first()) == ("a.b.c/x/y", "allow")


def test_models_without_a_language_allow_nothing():
    assert Model([], np.zeros((1, 0)), np.zeros((1, 0), bool), np.zeros(0)).langs == []
