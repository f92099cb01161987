"""Language of whole texts: script ranges narrow candidates, then Viterbi over per-word scores with a switching penalty.

Training counts, over a bounded sample of labelled texts, how often each hashed byte n-gram (1 to 4 bytes within a word, word ends marked) falls
in words of each language, and which scripts a language's words are written in. A word's score for a language is the sum of its
n-grams' log probabilities; languages that don't use the word's script are ruled out. Viterbi with one penalty for any switch
labels each word, for all texts of a slice at once, and runs of one label are the spans.

Training and prediction each are one pass of whole-buffer numpy operations per task; counts are summed by hash before the shuffle
and the model that the driver holds has a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.llm.common import slices, spare
from farness.llm.words import joined, mix

BUCKET_BITS, ORDERS = 16, (1, 2, 3, 4)
#: Scripts and their ranges of code points; letters elsewhere are 'other'.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))), ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))), ("cyrillic", ((0x400, 0x52F),)), ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))), ("devanagari", ((0x900, 0x97F),)), ("thai", ((0xE00, 0xE7F),)), ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))), ("hangul", ((0xAC00, 0xD7AF), (0x1100, 0x11FF))), ("other", ()),
)
#: Bytes of words: ASCII letters and everything beyond ASCII; A-Z and the two-byte Latin capitals are lowered.
_WORD = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_SCRIPT_OF = np.full(0x2000, len(SCRIPTS) - 1, np.uint8)
for _k, (_, _ranges) in enumerate(SCRIPTS):
    for _a, _b in _ranges:
        _SCRIPT_OF[_a >> 4 : (_b >> 4) + 1] = _k


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (1 << BUCKET_BITS, languages): log probabilities
    uses: np.ndarray  # (scripts, languages): whether the language is written in the script
    prior: np.ndarray


def _lowered(buffer: np.ndarray) -> np.ndarray:
    out = buffer + ((buffer >= 65) & (buffer <= 90)) * np.uint8(32)
    after = np.zeros(buffer.size, bool)
    after[1:] = buffer[:-1] == 0xC3
    return out + (after & (buffer >= 0x80) & (buffer <= 0x9E) & (buffer != 0x97)) * np.uint8(32)


def _word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(buffer.size + 2, np.int8)
    inside[1:-1] = _WORD[buffer]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scripts(buffer: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The script of each word, by its first character's code point."""
    padded = np.concatenate([buffer, np.zeros(3, np.uint8)]).astype(np.int32)
    a, b, c = padded[first], padded[first + 1] & 63, padded[first + 2] & 63
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, 0x1FFFF)))
    return _SCRIPT_OF[np.minimum(point >> 4, _SCRIPT_OF.size - 1)]


def _grams(low: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Yields (bucket of the n-gram that ends at each byte, whether it counts) for each order; a byte in front marks a word's start."""
    bytes_in = np.zeros(low.size + 1, bool)
    inside = np.zeros(low.size + 2, np.int8)
    inside[first] += 1
    inside[last + 1] -= 1
    # each word and the byte behind it, which marks its end
    bytes_in = np.cumsum(inside)[: low.size + 1] > 0
    marked = np.where(_WORD[low], low, 0).astype(np.uint64)
    length = np.arange(low.size) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [low.size]]))) if first.size else np.zeros(low.size, np.int64)
    key = np.zeros(low.size, np.uint64)
    shifted = marked
    for k, n in enumerate(ORDERS):
        key = key * np.uint64(257) + shifted + np.uint64(1) if k == 0 else key + (shifted + np.uint64(1)) * np.uint64(pow(257, k, 1 << 64))
        yield (mix(key + np.uint64(n << 56)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), bytes_in[: low.size] & (length >= n - 2)
        shifted = np.concatenate([np.zeros(1, np.uint64), shifted[:-1]])


def count_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram counts by bucket, words by script) of some texts together."""
    buffer, _ = joined(texts)
    first, last = _word_spans(buffer)
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, valid in _grams(_lowered(buffer), first, last):
        counts += np.bincount(bucket[valid], minlength=1 << BUCKET_BITS)
    return counts, np.bincount(_scripts(buffer, first), minlength=len(SCRIPTS))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts_per_language: int = 3000, least_share: float = 0.01) -> Model | None:
    """The model from at most texts_per_language texts of each language, those of the least hashed keys.

    Texts are counted where they lie; summed counts (a row for each language and bucket at most) reach the driver.
    None if no text has a label.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{key}`"), F.lit(11)).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return None
    # a hash bound for each language that about texts_per_language rows are below
    bound = F.lit(False)
    for r in sizes:
        share = min(1.0, texts_per_language / r.n)
        bound = bound | ((F.col("lang") == r.lang) & (F.col("h") <= int(-(2**63) + share * (2**64 - 1025))))

    def run(batches):
        totals: dict[str, list] = {}
        for batch in batches:
            names = batch.column(1)
            for name in pc.unique(names).to_pylist():
                own = batch.filter(pc.equal(names, name))
                for part in slices([own], 0, 2 << 20):
                    counts, scripts = count_grams(part.column(0))
                    old = totals.setdefault(name, [0, 0])
                    old[0], old[1] = old[0] + counts, old[1] + scripts
        for name, (counts, scripts) in totals.items():
            some = np.flatnonzero(counts)
            used = np.flatnonzero(scripts)
            bucket = np.concatenate([some, -1 - used])
            yield pa.RecordBatch.from_arrays([pa.array([name] * bucket.size), pa.array(bucket, pa.int64()), pa.array(np.concatenate([counts[some], scripts[used]]), pa.int64())], ["lang", "bucket", "n"])

    summed = rows.where(bound).select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(r.lang for r in sizes)
    counts, scripts = np.zeros((1 << BUCKET_BITS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    column = summed["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    bucket, n = summed["bucket"].to_numpy(dtype=np.int64), summed["n"].to_numpy(dtype=np.float64)
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    scripts[-1 - bucket[bucket < 0], column[bucket < 0]] = n[bucket < 0]
    smooth = counts + 0.5
    scores = np.log(smooth / smooth.sum(axis=0))
    shares = scripts / np.maximum(1, scripts.sum(axis=0))
    return Model(langs, (scores - scores.max(axis=1, keepdims=True)).astype(np.float32), shares >= least_share, np.zeros(len(langs)))


def word_scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores of words by language, where each text's words start with the end, first and last byte of words)."""
    buffer, starts = joined(texts)
    first, last = _word_spans(buffer)
    bounds = np.searchsorted(first, starts)
    out = np.zeros((first.size, len(model.langs)), np.float32)
    if first.size:
        cells = np.stack([first, np.minimum(last + 1, buffer.size)], axis=1).reshape(-1)[:-1]
        for bucket, valid in _grams(_lowered(buffer), first, last):
            at = np.where(valid, bucket, 1 << BUCKET_BITS)
            for j in range(len(model.langs)):
                column = np.concatenate([model.scores[:, j], np.zeros(1, np.float32)])
                out[:, j] += np.add.reduceat(column[at], cells)[::2]
        allowed = model.uses[_scripts(buffer, first)]
        none = ~allowed.any(axis=1)
        out[~allowed & ~none[:, None]] = -1e6
    return out, bounds, first - np.repeat(starts[:-1], np.diff(bounds)), last - np.repeat(starts[:-1], np.diff(bounds))


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word of every text: sum of scores less the penalty for every change of label within a text."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, n = bounds[:-1][order], sizes[order]
    steps = int(n[0]) if n.size else 0
    switched = np.zeros(scores.shape, bool)
    best_at = np.zeros(scores.shape[0], np.int32)
    active = np.searchsorted(-n, -np.arange(steps), side="left") if steps else np.zeros(0, int)
    value = np.zeros((n.size, scores.shape[1]), np.float64)
    last_value = np.zeros_like(value)
    for t in range(steps):
        live = active[t]
        at = begin[:live] + t
        if t == 0:
            value[:live] = scores[at]
        else:
            own = value[:live]
            top = own.argmax(axis=1)
            best_at[at] = top
            moved = own[np.arange(live), top][:, None] - penalty
            switched[at] = moved > own
            value[:live] = np.maximum(own, moved) + scores[at]
        last_value[:live] = value[:live]
    labels = np.zeros(scores.shape[0], np.int32)
    state = last_value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        live = active[t]
        at = begin[:live] + t
        labels[at] = state[:live]
        if t:
            state[:live] = np.where(switched[at, state[:live]], best_at[at], state[:live])
    return labels


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


#: Types of the columns that predict() adds.
PREDICTED = ("string", "double", "array<struct<start:int,stop:int,lang:string>>")


def predict(docs: DataFrame, model: Model | None, text: str = "text", penalty: float = 12.0, spans: bool = True) -> DataFrame:
    """docs with lang_pred, score and spans behind its columns, in this order (spare names on a clash).

    lang_pred is the label of most letters' bytes; score their share of all labelled bytes, shaded towards even odds where the words
    hardly tell languages apart. spans are runs of words of one label, as byte places in the text's UTF-8 form.

    Defined results: 'und', 0.0 and no spans for null texts, texts without a letter and an untrained model; of equal
    labels the first by name wins; every row is judged alone.
    """
    names = docs.columns
    where = names.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    added = spare(docs, "lang_pred", "score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches, where, 2 << 20):
            texts = batch.column(where).to_pylist()
            known = np.array([model is not None and has_letter(t) for t in texts])
            langs, shares, runs = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if known.any():
                scores, bounds, first, last = word_scores(model, batch.column(where))
                labels = viterbi(scores, bounds, penalty)
                n = len(model.langs)
                doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
                weights = np.bincount(doc * n + labels, weights=last - first, minlength=len(texts) * n).reshape(-1, n)
                top = weights.argmax(axis=1)
                sums = np.stack([np.bincount(doc, weights=scores[:, j], minlength=len(texts)) for j in range(n)], axis=1)
                others = sums - np.take_along_axis(sums, top[:, None], axis=1)
                odds = 1 / np.exp(np.clip(others, -50, 50)).sum(axis=1)
                part = weights.max(axis=1) / np.maximum(1, weights.sum(axis=1))
                for i in np.flatnonzero(known):
                    langs[i], shares[i] = model.langs[top[i]], float(min(1.0, max(0.0, part[i] * max(odds[i], 1 / n))))
                if spans:
                    change = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])])) if labels.size else np.zeros(0, int)
                    for a, b in zip(change, [*change[1:], labels.size], strict=True):
                        if known[doc[a]]:
                            runs[doc[a]].append({"start": int(first[a]), "stop": int(last[b - 1]), "lang": model.langs[labels[a]]})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(shares), pa.array(runs, kind)], [*names, *added])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in zip(added, PREDICTED, strict=True))
    return docs.mapInArrow(run, f"{schema}, {kinds}")
