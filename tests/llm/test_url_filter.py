"""URL trees: labels from pages, splits against an exhaustive search, accuracy on a fold held out, odd rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from farness.llm.url_filter import FEATURES, auc, boost, fitted, host_and_path, judge, labelled_by_page, page_text, train

PAGES = "page_id long, url string, html string"


def page(text):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/x'>a | b | c | d | e</a></nav><!-- c --><article>{text}</article><footer>&copy;</footer></body></html>"


def prose(rng, n=14):
    return "".join(f"<p>{' '.join(rng.choice(['river', 'stone', 'cloud', 'wind', 'field', 'night']) + str(rng.randrange(40)) for _ in range(9))}.</p>" for _ in range(n))


def junk(rng, n=14):
    return "".join(f"<p>{' '.join(rng.choice(['$$$', '&&& win', '*** ###', 'GO!!', '|||']) + str(rng.randrange(9)) for _ in range(9))}</p>" for _ in range(n))


def site(rng, k):
    """A URL and its page. Several traits of the URL, none of them alone, go with bad pages."""
    traits = [rng.random() < 0.5 for _ in range(6)]
    deep, digits, query, hyphen, long, dots = traits
    host = ("a.b." if dots else "") + (f"{rng.randrange(10**6):06d}" if digits else "") + rng.choice(["river", "stone", "cloud"]) + ("-x" if hyphen else "") + rng.choice([".example.net", ".example.org"])
    path = "/" + "/".join(["p"] * (5 if deep else 1)) + f"/{k}" + ("w" * 30 if long else "") + (f"?a={k % 7}&b=2&c=3" if query else "")
    bad = sum(traits) >= 4
    return f"http://{host}{path}", page((junk if bad else prose)(rng)), bad


def test_page_text_and_labels(spark):
    rng = random.Random(1)
    rows = [(1, "http://a.net/1", page(prose(rng))), (2, "http://a.net/2", page(junk(rng))), (3, "http://a.net/3", page("<p>short</p>")), (4, "http://a.net/4", None), (5, None, page(prose(rng))), (2, "http://a.net/2", page(junk(rng)))]
    df = spark.createDataFrame(rows, PAGES)
    assert {r.url: r.label for r in labelled_by_page(df).collect()} == {"http://a.net/1": 0, "http://a.net/2": 1, "http://a.net/3": 1}
    texts = spark.createDataFrame([("<P>one<br/>two &amp;&nbsp;<b>th</b>ree</p><script>x < 1</script>",), (None,), ("",)], "h string")
    assert [r[0] for r in texts.select(page_text(texts["h"])).collect()] == ["one\ntwo & three", "", ""]


def test_trees_of_page_labels_hold_on_a_fold_held_out(spark):
    rng = random.Random(2)
    rows = [(k, *site(rng, k)) for k in range(1500)]
    df = spark.createDataFrame([r[:3] for r in rows], PAGES)
    model = train(df)
    assert model.held_out_auc > 0.95 and len(model.used()) >= 6
    asked = [(5000 + k, *site(rng, k)) for k in range(400)]
    got = {r.page_id: r for r in judge(spark.createDataFrame([r[:3] for r in asked], PAGES), model, rules=()).collect()}
    assert auc(np.array([got[r[0]].score for r in asked]), np.array([float(r[3]) for r in asked])) > 0.95
    assert np.mean([(got[r[0]].verdict == "block") == r[3] for r in asked]) > 0.9
    one = judge(spark.createDataFrame([(1, "http://well-known.example.net/p/1", None)], PAGES), model, rules=()).first()
    assert one.verdict == "allow" and one.score < 0.2


def test_labels_that_urls_say_nothing_about_block_nothing(spark):
    rng = random.Random(3)
    rows = [(k, site(rng, k)[0], page((junk if rng.random() < 0.2 else prose)(rng))) for k in range(600)]
    df = spark.createDataFrame(rows, PAGES)
    model = train(df)
    assert 0.3 < model.held_out_auc < 0.7
    assert judge(df, model, rules=()).where("verdict = 'block'").count() < 6


def test_splits_equal_an_exhaustive_search():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = rng.integers(0, 6, (80, 4)).astype(float)
        label = (rng.random(80) < 0.2 + 0.1 * x[:, 1]).astype(float)
        weight = rng.uniform(0.5, 2, 80)
        model = boost(x, label, {}, rounds=1, depth=1, rate=1.0, weight=weight)
        p = 1 / (1 + np.exp(-model.base))
        g, h = weight * (label - p), weight * p * (1 - p)
        worth = lambda own: g[own].sum() ** 2 / (h[own].sum() + 1)
        gains = {}
        for j, t in itertools.product(range(4), range(5)):
            low = x[:, j] <= t
            if min(h[low].sum(), h[~low].sum()) >= 1:
                gains[j, t] = worth(low) + worth(~low) - worth(np.ones(80, bool))
        feature, threshold, value = model.trees[0]
        assert gains[feature[0], threshold[0]] == pytest.approx(max(gains.values()))
        low = x[:, feature[0]] <= threshold[0]
        assert value[1] == pytest.approx(g[low].sum() / (h[low].sum() + 1)) and value[2] == pytest.approx(g[~low].sum() / (h[~low].sum() + 1))


def test_area_under_the_curve_counts_pairs():
    rng = np.random.default_rng(5)
    margin, label = rng.integers(0, 5, 40).astype(float), (rng.random(40) < 0.4).astype(float)
    pairs = [(a > b) + 0.5 * (a == b) for a in margin[label == 1] for b in margin[label == 0]]
    assert auc(margin, label) == pytest.approx(np.mean(pairs))


def test_odd_urls(spark):
    rng = random.Random(6)
    urls = [site(rng, k)[0] for k in range(60)]
    label = np.array([float("-x" in u) for u in urls])
    model = fitted(urls, [u.split("/")[2] for u in urls], ["/" + "/".join(u.split("?")[0].split("/")[3:]) for u in urls], label)
    rows = [(1, urls[0], "own"), (1, urls[0], None), (None, None, "n"), (2, "http://a.net/" + "x/" * 200_000, "long"), (3, "", ""), (4, "HTTP://A-x.NET", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((str(r.page_id), r.host, r.verdict, r.score) for r in judge(df, model).collect())
    assert len(got) == 6 and got[0] == got[1] and got[-1] == ("None", "", "allow", 0.0) and [k[1] for k in got if k[0] == "4"] == ["a-x.net"]
    assert judge(df.where("false"), model).collect() == [] and len(FEATURES) == 13
    assert train(spark.createDataFrame([], PAGES)) is None
    host, path = host_and_path(df["url"])
    assert df.where("page_id = 2").select(host, path).first()[0] == "a.net"
