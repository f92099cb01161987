"""Hashes of words and shingles over Arrow batches, by whole-buffer numpy operations."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words, and the lower case of A-Z.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The four greatest primes below 2**31.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, a line feed behind each, and where each starts (with the end as the last); null is as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    raw = [x.as_buffer() if x.is_valid else b"" for x in texts]
    sizes = np.fromiter((len(x) for x in raw), np.int64, len(raw)) + 1
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


class SpanHasher:
    """Hashes of spans of bytes: polynomials of their bytes in bases that the seed draws, modulo several primes near 2**31.

    Modulo a prime no structure of the spans makes them collide in a base drawn at random: two spans of n bytes agree modulo one prime with
    a chance of n / 2**31 at most. Spans of over `long` bytes are hashed by blake2b. (A power of two as the modulus
    wouldn't do: there words such as Thue and Morse's collide in every base.)
    """

    def __init__(self, seed: bytes, primes: tuple[int, ...], long: int = 4096):
        self.seed, self.primes, self.long = seed, primes, long
        self.powers = []
        for k, p in enumerate(primes):
            base = int.from_bytes(hashlib.blake2b(seed, digest_size=16, salt=bytes([k])).digest(), "big") % (p - 1000) + 500
            table = np.ones(1, np.uint64)
            while table.size < long:
                # a product of two residues stays below 2**62
                table = np.concatenate([table, table * np.uint64(pow(base, table.size, p)) % np.uint64(p)])
            self.powers.append(table[:long])

    def residues(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(a residue of every span for each prime, which spans are too long to have one)."""
        sizes = np.diff(offsets)
        far = sizes > self.long
        if far.any():
            # only the short spans' bytes
            take = np.repeat(~far, sizes)
            data, sizes = data[offsets[0] : offsets[-1]][take], np.where(far, 0, sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        some = np.flatnonzero(sizes)
        out = [np.zeros(sizes.size, np.uint64) for _ in self.primes]
        if some.size:
            begin, end = int(offsets[0]), int(offsets[-1])
            back = np.repeat(offsets[1:] - 1, sizes) - np.arange(begin, end)
            values = data[begin:end].astype(np.uint64) + np.uint64(1)
            starts = offsets[:-1][some] - begin
            for column, table, p in zip(out, self.powers, self.primes, strict=True):
                # at most `long` products below 2**40 are added
                column[some] = np.add.reduceat(values * table[back], starts) % np.uint64(p)
        return out, far

    def _digests(self, data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Two numbers for each of the given spans, by blake2b."""
        raw = b"".join(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16, key=self.seed[:64]).digest() for i in which.tolist())
        return np.frombuffer(raw, "<u8").reshape(-1, 2)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One 64-bit hash of each span."""
        found, far = self.residues(data, offsets)
        high = np.uint64(32)
        out = mix(found[0] << high | found[1])
        for k, r in enumerate(found[2:]):
            out = mix(out + (r << high | np.uint64(k + 1)))
        out = mix(out + np.diff(offsets).astype(np.uint64))
        if far.any():
            out[far] = self._digests(data, offsets, np.flatnonzero(far))[:, 0]
        return out

    def pair(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each span, from two primes each; for four primes."""
        found, far = self.residues(data, offsets)
        sizes, high = np.diff(offsets).astype(np.uint64), np.uint64(32)
        one, two = (mix((found[k] << high | found[k + 1]) ^ mix(sizes + np.uint64(k + 1))) for k in (0, 2))
        if far.any():
            own = self._digests(data, offsets, np.flatnonzero(far))
            one[far], two[far] = own[:, 0], own[:, 1]
        return one, two


#: The same in every worker, since words meet across them.
_WORDS = SpanHasher(b"words of all documents", PRIMES[:3])


def words(buffer: np.ndarray, starts: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word with A-Z lowered, where each text's words start in it, with the end).

    keep: the bytes that count as letters of a word; all but the six blanks by default. It tells words apart and is what is hashed.
    """
    letters = ~_BLANK if keep is None else keep
    inside = np.zeros(buffer.size + 2, bool)
    inside[1:-1] = letters[buffer]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    data = _LOWER[buffer[inside[1:-1]]]
    return _WORDS(data, np.concatenate([[0], np.cumsum(last - first)])), np.searchsorted(first, starts)


_PLACES = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of every n words in a row, where each text's start); a text of fewer words, but one at least, has one of all its words."""
    counts = np.diff(bounds)
    out = np.zeros(max(0, hashes.size - n + 1), np.uint64)
    for k in range(n):
        out += hashes[k : k + out.size] * _PLACES[k]
    out = mix(out)
    sizes = np.where(counts >= n, counts - n + 1, counts > 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(bounds[:-1] - ends[:-1], sizes) + np.arange(int(ends[-1]))
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not short.size:
        return out[at], ends
    result = np.zeros(at.size, np.uint64)
    fits = np.ones(at.size, bool)
    fits[ends[short]] = False
    result[fits] = out[at[fits]]
    for i in short:
        own = hashes[bounds[i] : bounds[i + 1]]
        result[ends[i]] = mix((own * _PLACES[: own.size]).sum(dtype=np.uint64, keepdims=True) + np.uint64(own.size))[0]
    return result, ends


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = words(*joined(texts))
    all_of, ends = shingles(hashes, bounds, n)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = np.sort(all_of[a:b])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if own.size else own)
    return out
