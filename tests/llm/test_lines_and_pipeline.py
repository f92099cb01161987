"""Line dedup over runs, and the pipeline against a brute-force version of every stage."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from farness.llm.line_dedup import LineRuns, dedup_lines
from farness.llm.quality_rules import BOILERPLATE, NAVIGATION, STOPS, SYMBOLS, UPPER, LineRules
from farness.scratch import Scratch
from tests.llm.test_documents import base_counts
from tests.llm.test_near_duplicates import brute

BLANKS = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def hot_keys(texts, least):
    found = Counter(k for t in texts for k in {key_of(x) for x in (t or "").split("\n")} if k)
    return {k for k, n in found.items() if n >= least}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_lines_of_many_documents_go(spark, batches):
    rng = random.Random(batches)
    common = ["The footer. ", "\tÉcole", "x", "  ", "rare line"]
    texts = [None, "", "\n", "a\n\n b"] + ["\n".join(rng.choice([*common, f"own {i} {k}", "THE FOOTER."]) for k in range(rng.randint(0, 7))) for i in range(80)]
    df = spark.createDataFrame([(i, t, 5, "h") for i, t in enumerate(texts)], DOCS + ", n_lines int, h1 string")
    got = {r.doc_id: r for r in dedup_lines(df, batches=batches).collect()}
    hot = hot_keys(texts, 10)
    assert "the footer." in hot
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if key_of(x) not in hot]
        assert (got[i]["_n_lines"], got[i].n_dropped, got[i].kept_text, got[i].n_lines, got[i].h1) == (len(lines), len(lines) - len(kept), "\n".join(kept), 5, "h")


def test_first_keeps_one_copy_and_null_ids_work(spark):
    rows = [(i, f"shared line\nown {i}") for i in range(30)] + [(None, "shared line\nnobody"), (3, "shared line\nown 3")]
    got = dedup_lines(spark.createDataFrame(rows, DOCS), keep="first").collect()
    keepers = {r.doc_id for r in got if "shared line" in r.kept_text}
    assert len(got) == 32 and len(keepers) == 1
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_are_merged_by_levels(spark, tmp_path):
    scratch = Scratch(spark, "test")
    runs = LineRuns.open(spark, str(tmp_path / "runs"), min_docs=3)
    for b in range(6):
        runs.add(spark.createDataFrame([(b * 10 + j, 1, 1) for j in range(2)] + [(b, 2, b)], "row long, h1 long, h2 long"))
    assert {k: len(v) for k, v in runs.levels.items() if v} == {1: 1, 2: 1}
    merged = {(r.h1, r.h2): r.n for level in runs.levels.values() for name in level for r in runs.run(name).collect()}
    # the common key was settled by the second batch and counted no more in those after
    assert merged[1, 1] == 4 and all(merged[2, b] == 1 for b in range(6))
    assert [(r.h1, r.h2, r["first"]) for r in runs.settled(scratch).collect()] == [(1, 1, 0)]


def test_runs_outlive_the_call(spark, tmp_path):
    path, scratch = str(tmp_path / "runs"), Scratch(spark, "test")
    early = spark.createDataFrame([(i, f"Shared line\nown {i}" + "\nonly early" * (i < 6)) for i in range(100, 108)], DOCS)
    late = spark.createDataFrame([(i, f"own {i}\n shared LINE " + "\nonly early" * (i < 3)) for i in range(9)], DOCS)
    first = LineRuns.open(spark, path, min_docs=10)
    out = dedup_lines(early, keep="first", runs=first)
    assert out.where("n_dropped > 0").isEmpty()
    first.close()
    again = LineRuns.open(spark, path, min_docs=10)
    assert again.version == 4 and again.levels == first.levels
    got = {r.doc_id: (r.n_dropped, r.kept_text) for r in dedup_lines(late, keep="first", runs=again).collect()}
    # the first holder is a document of the earlier call
    assert got == {i: (1, f"own {i}" + "\nonly early" * (i < 3)) for i in range(9)}
    assert [r.n for name in sum(again.levels.values(), []) for r in again.run(name).where("n >= 10").collect()] == [17]
    # a batch that isn't committed leaves the runs as they were
    before = again.settled(scratch).collect()
    again._write(0, spark.createDataFrame([(1, 1, 99, 0)], "h1 long, h2 long, n long, first long"))
    assert LineRuns.open(spark, path).settled(scratch).collect() == before


def test_merges_and_anti_joins_use_the_order_of_the_runs(spark, tmp_path):
    runs = LineRuns.open(spark, str(tmp_path / "runs"), min_docs=2, fanout=3)
    for b in range(4):
        runs.add(spark.range(300).selectExpr(f"id + {b} AS row", "id AS h1", f"id % {b + 2} AS h2"))
    names = runs.levels[1] + runs.levels[0]
    with runs._sorted_scans():
        merge = runs._merged(names)._jdf.queryExecution().executedPlan().toString()
        settled = runs.run(names[0]).where("n >= 2").select("h1", "h2").hint("merge")
        counted = spark.range(50).selectExpr("id h1", "id h2").groupBy("h1", "h2").count()
        anti = counted.join(settled, ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in merge and "Exchange" not in merge and "Sort [" not in merge
    assert "SortMergeJoin" in anti and anti.count("Exchange") == 1


@pytest.mark.parametrize("keep", ["none", "first"])
def test_both_ways_of_dropping_are_the_same(spark, keep):
    rng = random.Random(5)
    common = ["The footer. ", "\tÉcole", "\u00a0x", "  ", "\x85", "a\x0b", "İx"]
    texts = [None, "", "\n", "\r\n"] + ["\n".join(rng.choice([*common, f"own {i} {k}", "THE FOOTER."]) for k in range(rng.randint(0, 7))) for i in range(70)]
    texts.append("\n".join(rng.choice([*common, f"long {k}"]) for k in range(60_000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (9, texts[9]), (9, "The footer.\nnew")]
    df = spark.createDataFrame([(*r, 1, [1, 2]) for r in rows], DOCS + ", _row int, _lost array<int>")
    search, join = (sorted(map(str, map(tuple, dedup_lines(df, keep=keep, most_broadcast=most).collect()))) for most in (1000, 0))
    assert search == join and len(search) == len(rows)


def fails(x, r=LineRules()):
    n = len(x)
    count = lambda marks: sum(c in marks for c in x)
    return (
        count(SYMBOLS) > r.max_symbols * n
        or (n >= r.upper_from and count(UPPER) > r.max_upper * n)
        or (count("!") >= r.shouts_from and count("!") > r.max_shouts * n)
        or sum(x.count(s) for s in NAVIGATION) >= r.nav_from
        or (count(" ") >= r.unstopped_words and not count(STOPS))
        or any(b in x.lower() for b in BOILERPLATE)
    )


def corpus():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ri", "sto", "clou", "win", "fie", "tre") for b in ("ver", "ne", "d", "ld", "es", "nt", "rra")]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(8)).capitalize() + "."
    page = lambda n: "\n".join(" ".join(sentence() for _ in range(2)) for _ in range(n))
    item = sentence() + " " + sentence() + " " + sentence()
    texts = [page(5) for _ in range(25)]
    texts += [texts[0]] * 12 + [texts[1]] * 2 + [texts[2].replace("river", "other", 1), texts[3] + " tail"]
    texts += [page(4) + "\nCommon footer line here." for _ in range(14)]
    texts += [page(3) + "\n" + item + "\n" + page(2), "BUY NOW!! " * 80, "short", None, "", "\n".join(f"a{k}$$$ b{k}%%%" for k in range(80)), page(5) + "\nHome | News | About | Shop"]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows, item


def test_every_stage_equals_brute_force(spark, tmp_path):
    rows, item = corpus()
    sf_dir = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs, now = spark.read.parquet(f"{sf_dir}/documents.parquet"), {r[0]: r[1] for r in rows}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/stage-{k}")
        docs = spark.read.parquet(f"{sf_dir}/stage-{k}")
        out[name] = docs
        if name == "quality_rules":
            want = {}
            for i, t in now.items():
                n, _, _, _, repeated = base_counts(t)
                kept = [x for x in (t or "").split("\n") if not fails(x)]
                if n >= 50 and 100 * repeated <= 50 * n and sum(map(len, kept)) >= 0.7 * sum(map(len, t.split("\n"))):
                    want[i] = "\n".join(kept)
        elif name == "line_dedup":
            hot, holders = hot_keys(now.values(), 10), defaultdict(set)
            want = {r.doc_id: r.text for r in docs.collect()}
            for i, t in now.items():
                lines = t.split("\n")
                cold = [x for x in lines if key_of(x) not in hot]
                got = want.get(i, "").split("\n") if i in want else []
                assert [x for x in got if key_of(x) not in hot] == cold
                for x in got:
                    holders[key_of(x)].add(i)
            assert hot and all(len(holders[k]) == 1 for k in hot)
            assert all(t.strip(BLANKS) for t in want.values())
        elif name == "near_dedup":
            want = {i: t for i, t in now.items() if brute(list(now.items()), 80)[i][2]}
        elif name == "decontamination":
            want = {i: t for i, t in now.items() if item not in t}
            assert len(want) == len(now) - 1
        else:
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = docs.collect()
        assert {r.doc_id: r.text for r in got} == want and len(got) == len(want) and all(r.n_chars == len(r.text) for r in got)
        now = want
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in out["packing"].collect():
        pieces[r.doc_id].append((r.start, r.ids))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in now.items()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.drop("ids", "sequence_id").collect())) == sorted(map(tuple, out["packing"].drop("ids", "sequence_id").collect()))
