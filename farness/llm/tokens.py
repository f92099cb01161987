"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once per worker.

A text is cut before every space. Where the tokenizer's own pre-tokenizer never joins across such a cut, the ids of the pieces
in order are the ids of the text; pieces repeat a great deal more than texts do. A piece of Latin letters, plain marks and line feeds
is made of atoms in turn, since the pre-tokenizer parts letters from marks; an atom of letters goes straight to the
library's model. Texts for which that doesn't hold (a space within a run of white space), other pieces and tokenizers of another kind
are encoded by the whole tokenizer. Tests hold both ways against each other.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from farness.llm.words import PRIMES, SpanHasher

#: Runs of white space in which a space that isn't the first is followed by white space or the end.
SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
JOINED = rf"{SPACES} (?:{SPACES}|$)"


#: Letters that lower-case one to one and don't combine, and marks that stand in no contraction.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,!?;:"
_SIMPLE = re.compile(rf" ?[{LETTERS}{MARKS}]+(?:\n[{LETTERS}{MARKS}]+)*").fullmatch
_ATOMS = re.compile(rf" ?[{LETTERS}]+| ?[{MARKS}]+|\n").findall


def _byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_WRITTEN = _byte_characters()


def _parts(spec: dict | None, key: str) -> list[dict]:
    return [] if spec is None else spec.get(key, [spec])


class PieceEncoder:
    """encode(texts) for Arrow string arrays; remembers pieces up to `most` of them and `most_ids` ids, then only the half that was used last.

    What is remembered of a piece are 128 bits of its hash, whose base each process draws for itself, and where its ids lie: some
    50 bytes. Pieces of over `long` bytes aren't remembered, so memory has a bound whatever the texts are.
    """

    def __init__(self, path: str, most: int = 2_000_000, most_atoms: int = 100_000, most_ids: int = 8_000_000, long: int = 256):
        self.most_ids, self.long = most_ids, long
        self.hasher = SpanHasher(os.urandom(32), PRIMES, long)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.most_atoms = Tokenizer.from_file(path), most, most_atoms
        with open(path) as f:
            spec = json.load(f)
        steps = _parts(spec.get("pre_tokenizer"), "pretokenizers")
        byte_level = next((s for s in steps if s["type"] == "ByteLevel"), None)
        #: 'spaced': a space belongs to the word behind it; 'bare': white space vanishes; else pieces don't hold.
        self.kind = ""
        if len(steps) == 1 and byte_level and byte_level["use_regex"] and not byte_level["add_prefix_space"] and spec.get("normalizer") is None:
            self.kind = "spaced"
        elif steps and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and self._drops_spaces():
            self.kind = "bare"
        self.model = self.tokenizer.model
        #: Atoms of letters go to the model if it finds for a sample what the whole tokenizer finds.
        sample = ["a", "Zebra", " Zebra", "\u00c9t\u00e9", " gr\u00fc\u00dfe", "\u00d1o\u00ffs"]
        self.plain = bool(self.kind) and all(self._letters(x) == self.tokenizer.encode(x, add_special_tokens=False).ids for x in sample)
        self._forget()

    def _letters(self, atom: str) -> list[int]:
        if self.kind == "bare":
            atom = atom.strip().lower()
        written = atom.replace(" ", _WRITTEN[32]) if atom.isascii() else atom.encode().decode("latin-1").translate(_WRITTEN)
        return [t.id for t in self.model.tokenize(written)]

    def _composed(self, key: str) -> list[int]:
        """The ids of a simple piece from those of its atoms."""
        out: list[int] = []
        for atom in _ATOMS(key):
            ids = self.atoms.get(atom)
            if ids is None:
                ids = self._letters(atom) if atom[-1].isalpha() else self.tokenizer.encode(atom, add_special_tokens=False).ids
                if len(self.atoms) >= self.most_atoms:
                    self.atoms.clear()
                self.atoms[atom] = ids
            out += ids
        return out

    def _drops_spaces(self) -> bool:
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        return ids(" ") == [] and ids("a b") == ids("a") + ids("b") == ids(" a  b ")

    def _forget(self) -> None:
        self.atoms: dict[str, list[int]] = {}
        #: Sorted by `known`, the first half of the hash; `check` is the second.
        self.known, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.used_in = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.store, self.used, self.slice = np.zeros(1 << 16, np.uint32), 0, 0

    def _thin(self) -> None:
        """Keeps the half of the pieces that was used last."""
        keep = np.flatnonzero(self.used_in > np.partition(self.used_in, self.known.size // 2)[self.known.size // 2])
        ends = np.cumsum(self.sizes[keep], dtype=np.int64)
        begin = ends - self.sizes[keep]
        total = int(ends[-1]) if keep.size else 0
        self.store = self.store[np.repeat(self.starts[keep] - begin, self.sizes[keep]) + np.arange(total)]
        self.known, self.check, self.sizes, self.used_in, self.starts, self.used = self.known[keep], self.check[keep], self.sizes[keep], self.used_in[keep], begin, total

    def _ids(self, keys: list[str]) -> list[list[int]]:
        if self.plain:
            lists = [self._composed(k) if _SIMPLE(k) else None for k in keys]
            other = [i for i, ids in enumerate(lists) if ids is None]
        else:
            lists, other = [None] * len(keys), range(len(keys))
        for i, x in zip(other, self.tokenizer.encode_batch_fast([keys[i] for i in other], add_special_tokens=False), strict=True):
            lists[i] = x.ids
        return lists

    def _places(self, hashes: tuple[np.ndarray, np.ndarray], long: np.ndarray, keys) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) in the store for pieces by their hashes; keys(at) gives pieces themselves, asked for those that aren't known.

        Long pieces are encoded anew and lie beside the store: their start is -1 less their place in self.beside.
        """
        starts, sizes = np.zeros(long.size, np.int64), np.zeros(long.size, np.int64)
        if (far := np.flatnonzero(long)).size:
            lists = self._ids(keys(far))
            sizes[far] = np.fromiter(map(len, lists), np.int64, len(lists))
            starts[far] = -1 - self.n_beside - (np.cumsum(sizes[far]) - sizes[far])
            self.beside += [np.array(x, np.uint32) for x in lists]
            self.n_beside += int(sizes[far].sum())
        near = np.flatnonzero(~long)
        one, two = (h[near] for h in hashes)
        at = np.searchsorted(self.known, one)
        inside = np.minimum(at, max(0, self.known.size - 1))
        new = np.flatnonzero((self.known[inside] != one) | (self.check[inside] != two)) if self.known.size else np.arange(one.size)
        if new.size:
            new = new[np.argsort(one[new], kind="stable")]
            lists = self._ids(keys(near[new]))
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            end = self.used + int(n.sum())
            if self.store.size < end:
                self.store = np.concatenate([self.store, np.zeros(max(end - self.store.size, self.store.size // 2), np.uint32)])
            self.store[self.used : end] = np.fromiter((i for x in lists for i in x), np.uint32, end - self.used)
            rows = {"known": one[new], "check": two[new], "starts": self.used + np.cumsum(n) - n, "sizes": n, "used_in": np.zeros(new.size, np.int32)}
            where = np.searchsorted(self.known, one[new])
            for name, values in rows.items():
                setattr(self, name, np.insert(getattr(self, name), where, values))
            self.used = end
            at = np.searchsorted(self.known, one)
        self.used_in[at] = self.slice
        starts[near], sizes[near] = self.starts[at], self.sizes[at]
        return starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text in them); null is as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if not self.kind:
            return self._whole(texts)
        if self.kind == "spaced" and pc.any(odd := pc.match_substring_regex(texts, JOINED)).as_py():
            odd = odd.to_numpy(zero_copy_only=False)
            ids, ends = self._pieces(pc.if_else(pa.array(odd), "", texts))
            other, others = self._whole(texts.filter(pa.array(odd)))
            parts, k = [], 0
            for i, whole in enumerate(odd):
                parts.append(other[others[k] : others[k + 1]] if whole else ids[ends[i] : ends[i + 1]])
                k += bool(whole)
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([x.size for x in parts])])
        return self._pieces(texts)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        return np.fromiter((i for x in lists for i in x), np.uint32, int(offsets[-1])), offsets

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.known.size > self.most or self.used > self.most_ids:
            self._thin()
        self.slice += 1
        self.beside, self.n_beside = [], 0
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        codes, pieces, bounds = coded.indices.to_numpy(), coded.dictionary, bounds - bounds[0]
        _, offsets, raw = pieces.buffers()
        offsets = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        one, two = self.hasher.pair(np.frombuffer(raw or b"", np.uint8)[: offsets[-1]], offsets)
        long = np.diff(offsets) > self.long
        if self.kind == "spaced":
            # long pieces that only begin texts aren't wanted behind a space
            behind = np.ones(codes.size, bool)
            behind[bounds[:-1]] = False
            wanted = np.zeros(len(pieces), bool)
            wanted[codes[behind]] = True
            at = np.flatnonzero(wanted)
            starts, sizes = np.zeros(codes.size, np.int64), np.zeros(codes.size, np.int64)
            place = np.cumsum(wanted) - 1
            found = self._places((one[at], two[at]), long[at], lambda k: [f" {x}" for x in pieces.take(pa.array(at[k])).to_pylist()])
            starts[behind], sizes[behind] = (x[place[codes[behind]]] for x in found)
            firsts, back = np.unique(codes[bounds[:-1]], return_inverse=True)
            bare = self._places((~one[firsts], two[firsts]), long[firsts], lambda k: pieces.take(pa.array(firsts[k])).to_pylist())
            starts[bounds[:-1]], sizes[bounds[:-1]] = bare[0][back], bare[1][back]
        else:
            starts, sizes = (x[codes] for x in self._places((one, two), long, lambda k: pieces.take(pa.array(k)).to_pylist()))
        store = self.store
        if self.beside:
            store = np.concatenate([store[: self.used], *self.beside])
            starts = np.where(starts < 0, self.used - 1 - starts, starts)
            self.beside = []
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        return store[at], np.concatenate([[0], ends])[bounds]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each worker process and vocabulary."""
    return PieceEncoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id behind the ids of every text."""
    n = offsets.size - 1
    out = np.full(ids.size + n, end_id, np.uint32)
    out[np.arange(ids.size) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)
