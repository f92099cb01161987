"""Hashes of words and pieces: structured texts that collide modulo powers of two stay apart in every operator that hashes."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from farness.llm.decontamination import contaminated
from farness.llm.near_duplicates import near_duplicates
from farness.llm.packing import pack_documents
from farness.llm.token_files import token_digests, write_token_files
from farness.llm.tokens import PieceEncoder
from farness.llm.words import PRIMES, SpanHasher, joined, words

DOCS = "doc_id long, text string"
BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def twins(n):
    """The word of Thue and Morse over a and b, n letters of it, and its complement."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_moduli_are_the_greatest_primes():
    prime = lambda n: all(n % k for k in range(2, int(n**0.5) + 1))
    assert PRIMES == tuple(p for p in range(2**31 - 1, PRIMES[-1] - 1, -2) if prime(p))


def test_spans_hash_as_their_bytes_and_apart_from_others():
    rng = np.random.default_rng(3)
    spans = [bytes(rng.integers(97, 100, rng.integers(0, 12)).astype(np.uint8)) for _ in range(4000)] + [b"a" * n for n in (4095, 4096, 4097, 9000)] + [b"b" * 4097]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
    hasher = SpanHasher(b"test", PRIMES)
    data = np.frombuffer(b"".join(spans), np.uint8)
    for hashes in (hasher(data, offsets), *hasher.pair(data, offsets)):
        named = {}
        for s, h in zip(spans, hashes.tolist(), strict=True):
            assert named.setdefault(s, h) == h
        assert len(set(named.values())) == len(named)


def test_words_hash_as_words():
    text = "The river THE\x0bRiver étÉ été  x\n\n" + " ".join(twins(1024)) + " " + " ".join(twins(8192))
    hashes, bounds = words(*joined(pa.array([text, None, "the"])))
    low = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) + ["the"]
    assert bounds.tolist() == [0, len(low) - 1, len(low) - 1, len(low)]
    named = {}
    assert all(named.setdefault(w, h) == h for w, h in zip(low, hashes.tolist(), strict=True)) and len(set(named.values())) == len(named)


@pytest.mark.parametrize("n", [1024, 2048])
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_of_structured_words_have_their_own_ids(path, n):
    texts = [x for w in twins(n) for x in (w, f"x {w}", f"{w} {w}\n{w}")]
    for long in (256, 1 << 16):
        encoder = PieceEncoder(path, long=long)
        for _ in range(2):
            ids, at = encoder.encode(pa.array(texts))
            want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_texts_without_spaces_take_bounded_memory(path):
    encoder = PieceEncoder(path, most=500, most_ids=2000)
    rng = np.random.default_rng(5)
    for _ in range(12):
        texts = ["".join(chr(0x4E00 + k) for k in rng.integers(0, 3000, 400)) + " " + " ".join("".join(chr(97 + k) for k in rng.integers(0, 26, 8)) for _ in range(300)) for _ in range(3)]
        ids, at = encoder.encode(pa.array(texts))
        want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
        # what a slice adds goes beyond the bounds until the next one begins
        assert encoder.known.size < 500 + 2000 and encoder.used < 2000 + 12_000


@pytest.mark.parametrize("n", [1024, 2048])
def test_structured_words_stay_apart_in_every_operator(spark, tmp_path, n):
    one, other = twins(n)
    texts = {1: " ".join([one] * 3), 2: " ".join([other] * 3), 3: f"{one} {other} {one} {one} {other} {one}", 4: f"{other} {one} {other} {other} {one} {other}"}
    df = spark.createDataFrame(list(texts.items()), DOCS)
    near = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert near == {i: (i, True) for i in texts}
    items = spark.createDataFrame([(9, f"{one} {other} {one} {one} {other} {one}")], "item_id long, text string")
    assert [r.doc_id for r in contaminated(df, items).collect()] == [3]
    for path in (BYTE, WORD):
        ids = {i: np.array([*x.ids, 1], "<u4") for i, x in zip(texts, Tokenizer.from_file(path).encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
        if path == BYTE:
            pieces = sorted((r.doc_id, r.start, r.ids) for r in pack_documents(df, path, with_ids=True).collect())
            assert {i: [x for d, _, own in pieces if d == i for x in own] for i in texts} == {i: x.tolist() for i, x in ids.items()}
        else:
            write_token_files(df, str(tmp_path / "orc"), path)
            assert {r.doc_id: r.ids_crc32 for r in token_digests(spark, str(tmp_path / "orc")).collect()} == {i: zlib.crc32(x.tobytes()) for i, x in ids.items()}
