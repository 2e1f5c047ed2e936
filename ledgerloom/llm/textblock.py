"""Words and hashes of many texts at once, by numpy: texts lie in one byte array, with a newline after each."""

from __future__ import annotations

import random
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Key of hashes that are features or orders only. Where equal hashes stand for equal texts, a run draws its own with new_key().
FIXED_KEY = 0x9E3779B97F4A7C15

#: Word characters by byte: all but ASCII white space; and letters, digits and all bytes of non-ASCII characters.
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER_ASCII = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: A prime. Modulo 2**64 alone, some texts of two letters have equal polynomials for every base.
_PRIME = U64(2**31 - 1)


def new_key() -> int:
    """A key for the hashes of one run. Drawn on the driver and sent with the work, so that tasks run again hash alike.

    Texts are written before the key is known. Of two different texts of n bytes both primes' hashes are equal with a chance of
    (n / 2**31) ** 2 at most, whatever the texts.
    """
    return secrets.randbits(64)


def _prime_powers(base: int, n: int) -> np.ndarray:
    """The base to the powers 0 to n - 1 modulo the prime, by doubling."""
    made = np.ones(1, U64)
    while len(made) < n:
        made = np.r_[made, made * U64(pow(base, len(made), int(_PRIME))) % _PRIME]
    return made[:n]


def _wide_powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[U64(1), np.full(n - 1, base, U64)])


def _bases(key: int) -> tuple[int, int, int]:
    """An odd number modulo 2**64 and two numbers modulo the prime, neither 0 nor 1."""
    if key == FIXED_KEY:
        return FIXED_KEY, 1_812_433_253, 1_103_515_245
    drawn = random.Random(key)
    return drawn.getrandbits(64) | 1, drawn.randrange(2, int(_PRIME)), drawn.randrange(2, int(_PRIME))


_powers: tuple[int, int, list[tuple[np.ndarray, np.ndarray]]] = (FIXED_KEY, 0, [])


def powers(n: int, key: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers from 0 to n - 1 at least of the key's bases and of their inverses; held for the worker's next texts."""
    global _powers
    if _powers[0] != key or _powers[1] < n:
        n += n // 4 + 1
        wide, *small = _bases(key)
        made = [(_wide_powers(wide, n), _wide_powers(pow(wide, -1, 1 << 64), n))]
        made += [(_prime_powers(x, n), _prime_powers(pow(x, -1, int(_PRIME)), n)) for x in small]
        _powers = key, n, made
    return _powers[2]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones (the finalizer of splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class TextBlock:
    """data: the bytes; starts, ends: of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False, key: int = FIXED_KEY):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = LOWER_ASCII[data] if lower else data
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self._key, self._sums = key, {}

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each run of bytes that the table marks."""
        inside = table[self.data]
        change = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = change[::2], change[1::2]
        return start, end, np.searchsorted(self.starts, start, "right") - 1

    def _polynomial(self, base: int, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """The bytes from start to end as a polynomial in the key's base of that number; the first base counts modulo 2**64."""
        up, down = powers(len(self.data) + 1, self._key)[base]
        if base not in self._sums:
            n = len(self.data)
            terms = (self.data.astype(U64) + U64(1)) * up[:n]
            self._sums[base] = np.zeros(n + 1, U64)
            np.cumsum(terms % _PRIME if base else terms, out=self._sums[base][1:])
        part = self._sums[base][end] - self._sums[base][start]
        return part % _PRIME * down[start] % _PRIME if base else part * down[start]

    def hashes(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """64-bit hashes of the bytes from start to end: equal bytes have equal hashes wherever they stand."""
        return mixed(self._polynomial(0, start, end) ^ mixed(self._polynomial(1, start, end) + U64(1)))

    def both_hashes(self, start: np.ndarray | slice, end: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes by different bases, of 64 and of 31 bits, of the bytes from start to end."""
        return self.hashes(start, end), self._polynomial(2, start, end)

    def sure_hashes(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """64-bit hashes of the bytes from start to end, made of both of both_hashes()."""
        wide, small = self.both_hashes(start, end)
        return mixed(wide ^ mixed(small + U64(1)))

    def grams(self, n: int) -> np.ndarray:
        """The hashes of the n bytes from each place on."""
        count = max(len(self.data) - n + 1, 0)
        return self.hashes(slice(0, count), slice(n, n + count))


def sequences(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of n neighbouring words of one text."""
    count = len(hashes) - n + 1
    if count <= 0:
        return hashes[:0], doc[:0]
    total = hashes[:count].copy()
    for k in range(1, n):
        total *= U64(0xD1342543DE82EF95)
        total += hashes[k : count + k]
    whole = doc[:count] == doc[n - 1 :]
    return mixed(total[whole]), doc[:count][whole]


#: Bytes of texts that lie in one block: some fifty times that is held at once, powers of the key's bases included.
TEXT_BYTES = 250_000


def text_blocks(texts: pa.Array, most: int = TEXT_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """First, past-last and bytes of consecutive texts of a binary array, about ``most`` bytes or one text at a time."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
    start = 0
    for i in range(len(texts)):
        if offsets[i + 1] - offsets[start] >= most or i + 1 == len(texts):
            yield start, i + 1, texts[start : i + 1].to_pylist()
            start = i + 1
