"""Quality by attention-based multiple-instance learning.

A document is a bag of passages, all of its text cut into 1 to most_passages parts of about passage_bytes bytes. A passage is encoded by how its
character classes follow each other, how often its words repeat and how long they are, and a learned layer. Gated attention
(tanh times sigmoid) weighs the passages; the weighted sum of their codes is scored. All weights are learned from document
labels alone, on a bounded sample.

Training features are made where the texts lie; the driver fits on at most sample_docs documents of at most most_passages
passages each. Scoring is one pass without a shuffle, on slices of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.llm.common import slices
from farness.llm.words import joined, words

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!?", "#*$%&|<>{}[]=^~\\_@+/")
_OTHER, _BEYOND = len(_GROUPS), len(_GROUPS) + 1
N_CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, _OTHER, np.uint8)
for _k, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _k
_CLASS[128:] = _BEYOND
#: Class bigrams, then: share of distinct words, of words equal to the one before, mean bytes of a word, log bytes.
N_FEATURES = N_CLASSES * N_CLASSES + 4


@dataclass(frozen=True)
class Passages:
    passage_bytes: int = 600
    most_passages: int = 64


@dataclass
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]
    cut: Passages


def features(texts: pa.Array, cut: Passages) -> tuple[np.ndarray, np.ndarray]:
    """(a row of features for each passage, where each text's passages start with the end); an empty text has one passage."""
    buffer, starts = joined(texts)
    sizes = np.diff(starts)
    parts = np.clip(-(-sizes // cut.passage_bytes), 1, cut.most_passages)
    bounds = np.concatenate([[0], np.cumsum(parts)])
    part = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], parts)
    begin = np.repeat(starts[:-1], parts) + part * np.repeat(sizes, parts) // np.repeat(parts, parts)
    lengths = np.diff(np.concatenate([begin, [buffer.size]]))
    of = np.repeat(np.arange(part.size), lengths)
    classes = _CLASS[buffer].astype(np.int64)
    # a text's last byte is the line feed behind it, which nothing follows
    after = np.append(classes[1:], 0)
    after[starts[1:] - 1] = _CLASS[10]
    code = of * (N_CLASSES * N_CLASSES) + classes * N_CLASSES + after
    grams = np.bincount(code, minlength=part.size * N_CLASSES * N_CLASSES).reshape(part.size, -1)
    hashes, word_bounds = words(buffer, begin)
    counts = np.diff(np.concatenate([word_bounds, [hashes.size]]))
    owner = np.repeat(np.arange(part.size), counts)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(hashes.size, bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[1:] != owner[:-1])
    again = np.zeros(hashes.size, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    some = np.maximum(1, counts)
    out = np.empty((part.size, N_FEATURES), np.float32)
    out[:, :-4] = np.sqrt(grams / np.maximum(1, lengths)[:, None])
    out[:, -4] = np.bincount(owner, weights=fresh, minlength=part.size) / some
    out[:, -3] = np.bincount(owner, weights=again, minlength=part.size) / some
    out[:, -2] = np.minimum(lengths / some, 50) / 10
    out[:, -1] = np.log1p(lengths)
    return out, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Codes h, gates t and g, attention a, bag codes z and scores y; bags are never empty."""
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (t * g) @ p["w"]
    sizes = np.diff(bounds)
    raw = np.exp(s - np.repeat(np.maximum.reduceat(s, bounds[:-1]), sizes))
    a = raw / np.repeat(np.add.reduceat(raw, bounds[:-1]), sizes)
    z = np.add.reduceat(a[:, None] * h, bounds[:-1])
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}


def _gradients(p: dict, x: np.ndarray, bounds: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f, sizes = _forward(p, x, bounds), np.diff(bounds)
    dy = (f["y"] - label) * weight / weight.sum()
    dz = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
    dh, da = f["a"][:, None] * dz, (dz * f["h"]).sum(axis=1)
    ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, bounds[:-1]), sizes))
    dtg = ds[:, None] * p["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh += dt @ p["V"].T + dg @ p["U"].T
    dx = dh * (1 - f["h"] ** 2)
    return {"E": x.T @ dx, "e": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dy, "b": dy.sum(keepdims=True)}


def fit(x: np.ndarray, bounds: np.ndarray, label: np.ndarray, cut: Passages, width: int = 24, gate: int = 12, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> MilModel:
    """Adam on the cross-entropy, rare labels weighted up (by the root of the odds); the same for the same input."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    d = x.shape[1]
    p = {"E": rng.normal(0, d**-0.5, (d, width)), "e": np.zeros(width), "V": rng.normal(0, width**-0.5, (width, gate)), "U": rng.normal(0, width**-0.5, (width, gate)), "w": rng.normal(0, 0.1, gate), "c": np.zeros(width), "b": np.zeros(1)}
    share = np.clip(label.mean(), 0.01, 0.99)
    weight = np.where(label == 1, (1 - share) ** 0.5, share**0.5)
    first, second, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    n = label.size
    for epoch in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            own = np.sort(order[a : a + batch])
            sizes = np.diff(bounds)[own]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.repeat(bounds[own] - ends[:-1], sizes) + np.arange(int(ends[-1]))
            step += 1
            pace = rate * (1 - epoch / epochs) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, grad in _gradients(p, x[rows], ends, label[own], weight[own]).items():
                grad = grad + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] = p[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)
    return MilModel(mean, scale, p, cut)


def scores(model: MilModel | None, texts: pa.Array) -> np.ndarray:
    """Scores to six digits: sums in double precision, whose last bits depend on which texts share a product, don't reach them."""
    if model is None:
        return np.full(len(texts), 0.5)
    x, bounds = features(texts, model.cut)
    return np.round(_forward(model.layers, np.clip((x - model.mean) / model.scale, -8, 8).astype(np.float64), bounds)["y"], 6)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = 4000, cut: Passages = Passages()) -> MilModel | None:
    """Fits on the sample_docs labelled documents of the least hashed keys; None unless both labels occur among them.

    Labels other than 0 and 1, null keys and null texts teach nothing; a key with several labels counts with the greatest.
    """
    known = labels.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    some = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(sample_docs)
    rows = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text")).where("_text IS NOT NULL")
    # at most sample_docs rows of two numbers
    rows = rows.join(F.broadcast(some), "_id").select("_id", "_text", "_label")

    def run(batches):
        for batch in slices(batches, 1, 2 << 20):
            x, bounds = features(batch.column(1), cut)
            packed = [x[a:b].astype(np.float16).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(packed, pa.binary())], ["id", "label", "x"])

    found = sorted((r.id, bytes(r.x), r.label) for r in rows.mapInArrow(run, "id long, label int, x binary").collect())
    label_of = np.array([r[2] for r in found], float)
    if label_of.size == 0 or label_of.min() == label_of.max():
        return None
    parts = [np.frombuffer(r[1], np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in found]
    return fit(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), label_of, cut)


def score(docs: DataFrame, model: MilModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row: 0 to 1, higher for likelier label 1.

    Defined results: null and empty texts are scored as one passage without content; without a model all scores are 0.5;
    repeated rows and null keys are scored as any; an empty table gives no rows. Only the two columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, 1, 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(shared.value, batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, score double")
