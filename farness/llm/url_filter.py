"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are learned from labelled URLs, a bounded sample of them: length, depth, digit ratio, entropy, parameter counts, marks in the host and
the smoothed share of bad URLs by the host's suffix. Labels are given, or come from the pages behind the URLs: a page is bad if its
text fails the quality rules. How many trees there are is decided on a fold that they aren't fitted on, so labels that URLs say nothing
about leave no trees but the share of bad pages. Features are whole-buffer numpy operations; rules and labels are native expressions.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farness.llm.quality_rules import line_first
from farness.llm.words import joined

#: The default rules, verdict and host with path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Elements of a page that aren't its text, and those that end a line of it.
NOT_TEXT, LINES = ("script", "style", "head", "nav", "footer"), ("p", "div", "li", "br", "h[1-6]", "article", "section", "tr", "ul", "ol", "table", "blockquote", "pre")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lowered, and the path; both empty for null or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits as 'host/path', its verdict), null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, rest = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


#: Names of the columns of features(), the suffix share last.
FEATURES = ("url_bytes", "host_bytes", "path_bytes", "depth", "digit_ratio", "host_digits", "host_hyphens", "host_dots", "parameters", "query_bytes", "host_entropy", "entropy", "suffix_share")


def _shares(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The entropy in bits of the bytes of each owner."""
    counts = np.bincount(owner * 256 + codes, minlength=n * 256).reshape(n, 256).astype(float)
    p = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)


def features(urls: pa.Array, hosts: pa.Array, paths: pa.Array, suffixes: dict[str, float]) -> np.ndarray:
    """A row of FEATURES for each URL; nulls are as empty."""
    n = len(urls)

    def counts(array: pa.Array):
        buffer, starts = joined(array)
        sizes = np.diff(starts) - 1
        owner = np.repeat(np.arange(n), sizes + 1)
        inside = np.ones(buffer.size, bool)
        inside[starts[1:] - 1] = False
        codes, owner = buffer[inside].astype(np.int64), owner[inside]
        of = lambda marks: np.bincount(owner, weights=np.isin(codes, [ord(c) for c in marks]), minlength=n)
        return sizes, of, _shares(codes, owner, n)

    size, of, entropy = counts(urls)
    host_size, of_host, host_entropy = counts(hosts)
    path_size, of_path, _ = counts(paths)
    digits = "0123456789"
    share = np.array([suffixes.get((h or "").rpartition(".")[2], suffixes.get("", 0.5)) for h in hosts.to_pylist()])
    query = np.maximum(0, size - host_size - path_size)
    return np.stack([size, host_size, path_size, of_path("/"), of(digits) / np.maximum(1, size), of_host(digits), of_host("-"), of_host("."), of("&=;"), query, host_entropy, entropy, share], axis=1).astype(np.float64).reshape(n, -1)


@dataclass
class Trees:
    """Each tree: feature, threshold (go right if greater) and value by node, children of k at 2k+1 and 2k+2."""

    base: float
    suffixes: dict[str, float]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: The area under the ROC curve on the fold held out; None where it has one label only.
    held_out_auc: float | None = None

    def used(self) -> set[str]:
        """The features that some tree splits by."""
        return {FEATURES[j] for feature, _, _ in self.trees for j in feature.tolist() if j >= 0}

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[node], 0)] > threshold[node]
                node = np.where(inner, 2 * node + 1 + go, node)
            out += value[node]
        return out


def suffix_shares(hosts: list[str], label: np.ndarray, prior: float = 20.0, weight: np.ndarray | None = None) -> dict[str, float]:
    """The smoothed share of bad URLs by last label of the host; '' has the share overall. Each counts by its weight, 1 by default."""
    weight = np.ones(len(label)) if weight is None else weight
    overall = float(np.average(label, weights=weight))
    sums: dict[str, list] = {}
    for host, y, w in zip(hosts, label, weight, strict=True):
        own = sums.setdefault((host or "").rpartition(".")[2], [0.0, 0.0])
        own[0], own[1] = own[0] + w * y, own[1] + w
    return {k: (bad + prior * overall) / (n + prior) for k, (bad, n) in sums.items()} | {"": overall}


def boost(x: np.ndarray, label: np.ndarray, suffixes: dict[str, float], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0, weight: np.ndarray | None = None) -> Trees:
    """Newton boosting of the logistic loss, of each row by its weight, on histograms of at most `bins` bins for each feature."""
    weight = np.ones(len(label)) if weight is None else weight
    share = np.clip(np.average(label, weights=weight), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(share / (1 - share))), suffixes)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (label - p), weight * p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(x), np.int64)
        for k in range(size):
            own = node == k
            if not own.any():
                continue
            g, h = grad[own].sum(), hess[own].sum()
            value[k] = rate * g / (h + 1)
            if 2 * k + 2 >= size:
                continue
            best = 1e-6
            for j, c in enumerate(cuts):
                if not c.size:
                    continue
                gs = np.bincount(binned[own, j], weights=grad[own], minlength=c.size + 1).cumsum()[:-1]
                hs = np.bincount(binned[own, j], weights=hess[own], minlength=c.size + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(hs < least) | (h - hs < least)] = 0
                if gain.max() > best:
                    best, at = float(gain.max()), int(gain.argmax())
                    feature[k], threshold[k], chosen = j, c[at], (j, at)
            if feature[k] >= 0:
                node[own] = 2 * k + 1 + (binned[own, chosen[0]] > chosen[1])
        model.trees.append((feature, threshold, value))
        margin += value[node]
    return model


def auc(margin: np.ndarray, label: np.ndarray) -> float:
    """The chance that a bad URL has a greater margin than another one, ties for a half."""
    order, inverse, counts = np.unique(margin, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    bad = label == 1
    return float((rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum()))


def page_text(html: Column) -> Column:
    """The text of a page, a line for each block; '' for null."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<({'|'.join(NOT_TEXT)})\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r\n]+", " "), rf"(?i)</?(?:{'|'.join(LINES)})(?:\s[^>]*)?/?>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return F.btrim(out, F.lit(" \n"))


def labelled_by_page(pages: DataFrame, url: str = "url", html: str = "html", sample: int = 20_000) -> DataFrame:
    """(url, label) of about `sample` pages, those of URLs with the least hashes: 1 if the page's text fails the quality rules."""
    rows = pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")).where("url IS NOT NULL AND html IS NOT NULL")
    share = min(1.0, sample / max(1, pages.where(F.col(f"`{url}`").isNotNull()).count()))
    near = rows.where(F.xxhash64("url", F.lit(5)) <= int(-(2**63) + share * (2**64 - 1025)))
    # pages are judged where they lie; of several pages of one URL the worst counts
    judged = line_first(near.select("url", page_text(F.col("html")).alias("text"))).select("url", (~F.col("kept")).cast("int").alias("label"))
    return judged.groupBy("url").agg(F.max("label").alias("label"))


def fitted(urls: list[str], hosts: list[str], paths: list[str], label: np.ndarray, weight: np.ndarray | None = None, folds: int = 5, rounds: int = 60) -> Trees:
    """Trees of all rows, as many as had the least loss on a fold (by crc32 of the URL) when fitted on the others."""
    weight = np.ones(label.size) if weight is None else weight
    out = np.array([zlib.crc32(u.encode()) % folds == 0 for u in urls])

    def trees(of: np.ndarray, n: int) -> Trees:
        own = np.flatnonzero(of)
        suffixes = suffix_shares([hosts[i] for i in own], label[of], weight=weight[of])
        return boost(table_of(own, suffixes), label[of], suffixes, rounds=n, weight=weight[of])

    def table_of(own: np.ndarray, suffixes: dict[str, float]) -> np.ndarray:
        return features(*(pa.array([x[i] for i in own], pa.string()) for x in (urls, hosts, paths)), suffixes)

    both = lambda of: of.any() and 0 < label[of].sum() < of.sum()
    if not (both(out) and both(~out)):
        return trees(np.ones(label.size, bool), rounds)
    first = trees(~out, rounds)
    x, y, w = table_of(np.flatnonzero(out), first.suffixes), label[out], weight[out]
    margins = [Trees(first.base, first.suffixes, first.trees[:k]).margin(x) for k in range(len(first.trees) + 1)]
    losses = [float((w * np.logaddexp(0, np.where(y == 1, -m, m))).sum()) for m in margins]
    best = int(np.argmin(losses))
    model = trees(np.ones(label.size, bool), best)
    model.held_out_auc = auc(margins[best], y)
    return model


def train(urls: DataFrame, url: str = "url", label: str | None = None, html: str = "html", sample: int = 20_000) -> Trees | None:
    """Trees from at most `sample` URLs with given labels, those of the least hashes; bad URLs (label 1) and others are sampled apart,
    at most half each, and weighted by their counts over all rows, so that scores mean the same at every size.

    Without a label column about `sample` URLs are labelled by their pages, with the share of bad ones as it is. None unless both
    labels occur, so also with neither labels nor pages.
    """
    if not label and html not in urls.columns:
        return None
    host, path = host_and_path(F.col("url"))
    given = urls.select(F.col(f"`{url}`").alias("url"), F.col(f"`{label}`").cast("int").alias("label")) if label else labelled_by_page(urls, url, html, sample)
    rows = given.select("url", host.alias("host"), path.alias("path"), "label").where("url IS NOT NULL AND host <> ''")
    if label:
        rows = rows.distinct()
        found, counts = [], {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        for y in (0, 1):
            found += rows.where(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(sample // 2).collect()
    else:
        found, counts = sorted(rows.collect()), None
    y = np.array([r.label for r in found], float)
    if y.size == 0 or y.min() == y.max():
        return None
    weight = None
    if counts:
        bad, share = y.mean(), counts[1] / (counts[0] + counts[1])
        weight = np.where(y == 1, share / bad, (1 - share) / (1 - bad))
    return fitted(*([r[k] for r in found] for k in range(3)), y, weight)


def judge(urls: DataFrame, model: Trees | None, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(the key as page_id, host, path, rule, verdict, score): the longest rule's verdict, else 'block' from a score of 0.5.

    score is the trees' chance that the URL is bad. Defined results: null URLs and such without '://' have an empty host and path, no
    rule, score 0 and are allowed; without a model scores are 0; rows are judged alone; an empty table gives no rows.
    """
    shared = urls.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            chance = np.zeros(n)
            if n and model is not None:
                some = np.array([bool(h) for h in batch.column(2).to_pylist()])
                chance = np.where(some, 1 / (1 + np.exp(-model.margin(features(batch.column(1), batch.column(2), batch.column(3), model.suffixes)))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(chance)], ["page_id", "host", "path", "score"])

    host, path = host_and_path(F.col(f"`{url}`"))
    scored = urls.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, score double")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
