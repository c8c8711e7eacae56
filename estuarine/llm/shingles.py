"""Hashes of words and word shingles of many texts at once, in flat numpy arrays."""

from __future__ import annotations

import numpy as np

from estuarine.llm.common import starts

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class WordHasher:
    """64-bit hashes of lower-cased words: random letters in a polynomial with a random odd base."""

    def __init__(self, seed: int = 20_240_229):
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
        for c in range(65, 91):
            self.letters[c] = self.letters[c + 32]
        self.base = int(rng.integers(1 << 62)) * 2 + 1
        self.space = np.zeros(256, bool)
        self.space[[*range(9, 14), 32]] = True
        self.pair = U(int(rng.integers(1 << 62)) * 2 + 1)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word in order, and the number of words of each text."""
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        gap = self.space[joined]
        edge = np.diff(gap.view(np.int8), prepend=1)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        powers = np.full(len(joined), self.base, U)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        terms = self.letters[joined] * powers
        total = np.concatenate([np.zeros(1, U), np.cumsum(terms, dtype=U)])
        back = np.full(len(joined), pow(self.base, -1, 1 << 64), U)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        hashes = mix((total[last] - total[first]) * back[first] + (last - first).astype(U))
        bounds = starts(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return hashes, np.diff(np.searchsorted(first, bounds))

    def shingle_sets(self, texts: list[str], length: int = 2) -> list[np.ndarray]:
        """The sorted distinct shingles of `length` words of each text; fewer words are one shingle."""
        words, counts = self.words([t.encode() for t in texts])
        # runs[k]: hashes of k + 1 words from each word on
        runs = [words]
        for k in range(1, length):
            runs.append(mix(runs[-1][:-1] * self.pair + words[k:]) if len(words) > k else words[:0])
        alone = mix(words * self.pair + U(1))
        at = starts(counts).tolist()
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= length:
                out.append(np.unique(runs[length - 1][a : b - length + 1]))
            else:
                out.append(runs[b - a - 1][a : a + 1] if b - a > 1 else alone[a:b])
        return out


class Signatures:
    """MinHash signatures of 32 bits per coordinate."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(0, 1 << 63, size, dtype=np.int64).astype(U)
        self.factor = rng.integers(0, 1 << 62, size, dtype=np.int64).astype(U) * U(2) + U(1)

    def of(self, values: np.ndarray, step: int = 4096) -> np.ndarray:
        low = np.full(len(self.salt), np.iinfo(np.uint64).max, U)
        for i in range(0, len(values), step):
            part = (values[i : i + step, None] ^ self.salt) * self.factor
            low = np.minimum(low, part.min(0))
        return (low >> U(32)).astype(np.uint32).view(np.int32)
