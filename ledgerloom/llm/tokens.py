"""Whole texts to token ids by a public tokenizer, encoding each distinct word once per worker.

Texts are cut where the tokenizer always starts a new word, the tokenizers library encodes words that the worker has
not met yet, and a text's ids are its words' ids in a row. The tokenizer's added tokens are matched in the texts as they
come, as the library does by default, and what lies between them is encoded by itself. Ids are held as little-endian
unsigned 32-bit bytes.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array
from collections.abc import Iterable
from functools import cache

import numpy as np

from .textblock import NOT_WHITE, TEXT_BYTES, U64, TextBlock, new_key

#: Words that a worker's stores hold at most. Half of them are the newest, and when these are full they take the place of
#: the older half, of which words that came again are among the newest. Words are held by hashes whose key each worker draws.
CACHE_WORDS = 3_000_000
#: New words that are encoded in one call.
BATCH_WORDS = 20_000

#: ASCII marks: characters other than letters, digits and white space.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space other than ASCII's.
_WIDE_SPACE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
_RARE_SPACE = [bytes([x]) for x in b"\t\v\f\r\x1c\x1d\x1e\x1f"]


#: Runs of newlines and spaces of which byte-level BPE makes one unit, not one for each newline.
_RUNS = (b"  ", b"\n\n\n", b"\n\n ", b" \n\n", b"\n \n")


def plain_space(text: bytes) -> bool:
    """Whether the only white space is spaces and newlines, and each of them is a unit of its own or begins a word."""
    if any(x in text for x in _RARE_SPACE) or any(x in text for x in _RUNS) or text.endswith(b"\n\n"):
        return False
    return text.isascii() or not _WIDE_SPACE.search(text)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def as_bytes(ids: list[int]) -> bytes:
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


def _byte_units() -> dict[int, int]:
    """Byte-level BPE writes a byte as a printable character: itself, or one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_UNITS = _byte_units()


def _units(data: bytes) -> str:
    return data.decode("latin-1").translate(BYTE_UNITS)


class WordCoder:
    """encode() gives each text's ids as bytes, equal to the library's encoding of the whole text.

    keeps_space: whether a word's tokens take in the space before it (byte-level BPE: a new word starts at a space that
    stands beside another character) or white space is dropped (a new word starts at any white space).
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if odd := [t.content for t in added.values() if t.normalized or t.lstrip or t.rstrip or t.single_word]:
            raise ValueError(f"texts cannot be cut at the added tokens {odd}")
        self.added = {t.content.encode(): as_bytes([i]) for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_tokens = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")")
        self.keeps_space = keeps_space
        self.apart: dict[bytes, bytes] = {}  # ids of marks and of words at the start of a line
        self.lowers = self.library([b"LEDGER"]) == self.library([b"ledger"])
        self.key = new_key()
        self.known: list[Store] = []
        self.older: list[Store] = []
        self.most = CACHE_WORDS

    def library(self, texts: list[bytes], ordinary: bool = False) -> list[bytes]:
        """The library's own encoding; ordinary: names of added tokens are ordinary text, as in words that are lowered."""
        self.tokenizer.encode_special_tokens = ordinary
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [as_bytes(x.ids) for x in found]

    def encode_words(self, words: list[bytes], space: bytes) -> list[bytes]:
        """The ids of each word, after a space where one is given.

        A word of Latin letters alone is one unit of both tokenizers' own splitting, so the library's BPE model takes it
        as it is; any other word goes through the whole tokenizer.
        """
        model, before = self.tokenizer.model.tokenize, _units(space)
        ids: list[bytes | None] = []
        for w in words:
            if w.isalpha():  # ASCII letters, which byte-level BPE writes as they are
                units = before + w.decode("ascii")
                ids.append(as_bytes([t.id for t in model(units.lower() if self.lowers else units)]))
                continue
            text = w.decode("utf-8", "replace")
            text = text.lower() if self.lowers else text
            latin = text.isalpha() and max(text) < "\u0250"
            ids.append(as_bytes([t.id for t in model(before + _units(text.encode()))]) if latin else None)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.library([space + words[i] for i in rest], True), strict=True):
            ids[i] = x
        return ids

    def parts(self, word: bytes) -> list[bytes]:
        """The word, and its last marks apart where both tokenizers part them."""
        base = word.rstrip(MARKS)
        if not base or len(base) == len(word):
            return [word]
        if not base[-1:].isalnum():
            text = base.decode("utf-8", "replace")
            if not (text.lower() if self.lowers else text)[-1].isalpha():
                return [word]
        return [base, word[len(base) :]]

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new words, and of the words that some are made of; a newline stands for itself and no space follows it."""
        new = set(words)
        lines = {w: [b"\n", *self.parts(w[1:])] for w in new if w[:1] == b"\n"} if self.keeps_space else {}
        cut = {w: p for w in new.difference(lines) if len(p := self.parts(w)) > 1}
        known = self._met({p[0] for p in cut.values()})
        first = list((new.difference(cut, lines) | {p[0] for p in cut.values()}).difference(known))
        after = list(({x for p in cut.values() for x in p[1:]} | {x for p in lines.values() for x in p}).difference(self.apart))
        made: dict[bytes, bytes] = {}
        for ids, group, space in ((made, first, b" " if self.keeps_space else b""), (self.apart, after, b"")):
            for i in range(0, len(group), BATCH_WORDS):
                part = group[i : i + BATCH_WORDS]
                ids.update(zip(part, self.encode_words(part, space), strict=True))
        for w, p in cut.items():
            made[w] = (made[p[0]] if p[0] in made else known[p[0]]) + b"".join([self.apart[x] for x in p[1:]])
        for w, p in lines.items():
            made[w] = b"".join([self.apart[x] for x in p])
        return made

    def _met(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of those of the words that are in a store."""
        words = list(words)
        h = self._hashes(words)
        order = np.argsort(h)
        n, ids = _found([*self.known, *self.older], h[order])
        ends, held = np.cumsum(n), ids.tobytes()
        return {words[i]: held[4 * (e - k) : 4 * e] for i, e, k in zip(order.tolist(), ends.tolist(), n.tolist(), strict=True) if k}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        return self._hashed(np.frombuffer(b"".join(words), np.uint8), ends - lengths, ends)

    def _hashed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from start to end, some of a long text's at a time."""
        found, i = [np.zeros(0, U64)], 0
        while i < len(start):
            j = max(int(np.searchsorted(end, start[i] + 2 * TEXT_BYTES, "right")), i + 1)
            block = TextBlock([data[start[i] : end[j - 1]].tobytes()], key=self.key)
            found.append(block.sure_hashes(start[i:j] - start[i], end[i:j] - start[i]))
            i = j
        return np.concatenate(found)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Millions of short-lived objects, none in cycles, are no work for the garbage collector."""
        gc.disable()
        try:
            if any(x in t for t in texts for x in self.added):
                return self._encode_between(texts)
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode_between(self, texts: list[bytes]) -> list[bytes]:
        """Cuts the texts at added tokens, which the library does before all else."""
        cut = [self.added_tokens.split(t) for t in texts]
        ids = iter(self._encode([x for parts in cut for x in parts[::2]]))
        return [b"".join([self.added[x] if k % 2 else next(ids) for k, x in enumerate(parts)]) for parts in cut]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        return [x for own in slices(texts, TEXT_BYTES) for x in self._encode_block(texts[own])]

    def _encode_block(self, texts: list[bytes]) -> list[bytes]:
        """Words are looked up by their hashes, each distinct one of the block once."""
        heads = [b""] * len(texts)
        if self.keeps_space:  # the first word stands without a space, and a newline begins a word; other texts go whole
            plain = [t.replace(b"\n", b" \n") if plain_space(t) else None for t in texts]
            heads = self.library([t if p is None else p.partition(b" ")[0] for t, p in zip(texts, plain, strict=True)], True)
            words = np.array([1 if p is None else p.count(b" ") + 1 for p in plain])
            block = TextBlock([b" ".join([p or b"" for p in plain])])
            space = np.flatnonzero(block.data == 0x20)
            later = np.ones(len(space) + 1, bool)
            later[np.cumsum(words) - words] = False
            start, end, words = np.r_[0, space + 1][later], np.r_[space, len(block.data) - 1][later], words - 1
        else:
            block = TextBlock(texts, lower=self.lowers)
            start, end, doc = block.words(NOT_WHITE)
            words = np.bincount(doc, minlength=len(texts))
        h, place, of = np.unique(self._hashed(block.data, start, end), return_index=True, return_inverse=True)
        n, ids = _found(self.known, h)
        if len(new := np.flatnonzero(n == 0)):
            again_n, again = _found(self.older, h[new])
            fresh, data = new[again_n == 0], block.data.tobytes()
            named = [data[a:b] for a, b in zip(start[place[fresh]].tolist(), end[place[fresh]].tolist(), strict=True)]
            made = self.learn(named)
            own = [made.pop(w) for w in named]
            self._take(h[new[again_n > 0]], again_n[again_n > 0], again)
            self._take(h[fresh], np.fromiter(map(len, own), np.int64, len(own)) // 4, np.frombuffer(b"".join(own), "<u4"))
            rest = self._hashes(list(made))
            order = np.argsort(rest)
            own = [x for _, x in sorted(zip(rest.tolist(), made.values(), strict=True))]
            self._take(rest[order], np.fromiter(map(len, own), np.int64, len(own)) // 4, np.frombuffer(b"".join(own), "<u4"))
            n, ids = _found(self.known, h)
        at = np.cumsum(n) - n
        held = ids[_ranges(at[of], n[of])].astype("<u4").tobytes()
        ends = 4 * np.r_[0, np.cumsum(n[of])][np.r_[0, np.cumsum(words)]]
        if sum(len(s[0]) for s in self.known) + len(self.apart) > self.most // 2:
            self.known, self.older, self.apart = [], self.known, {}
        return [x + held[a:b] for x, a, b in zip(heads, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _take(self, h: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Adds words as a store of their own; stores of like sizes become one, so there are few."""
        if len(h):
            self.known.append((h, n.astype(np.int32), np.cumsum(n) - n, ids))
        while len(self.known) > 1 and len(self.known[-2][0]) < 2 * len(self.known[-1][0]):
            two = self.known[-2:]
            h = np.concatenate([s[0] for s in two])
            order = np.argsort(h, kind="stable")
            n, at = np.concatenate([s[1] for s in two])[order], np.r_[two[0][2], two[1][2] + len(two[0][3])][order]
            self.known[-2:] = [(h[order], n, at, np.concatenate([s[3] for s in two]))]


#: Words in the order of their hashes: hash, number of ids, place of the first one, and the ids.
Store = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each start on, one after another."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _found(stores: list[Store], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each hash has in the stores (0: none holds it), and these ids one after another. h is in order."""
    n, where, parts, before = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), [np.zeros(0, "<u4")], 0
    todo = np.arange(len(h))
    for hashes, counts, at, ids in stores:
        place = np.minimum(np.searchsorted(hashes, h[todo]), len(hashes) - 1)
        hit = hashes[place] == h[todo]
        place, own, todo = place[hit], todo[hit], todo[~hit]
        n[own] = counts[place]
        parts.append(ids[_ranges(at[place], n[own])])
        where[own] = before + np.cumsum(n[own]) - n[own]
        before += len(parts[-1])
    return n, np.concatenate(parts)[_ranges(where, n)]


@cache
def coder(path: str, keeps_space: bool) -> WordCoder:
    """One for each worker process, so that its cache lasts over tasks."""
    return WordCoder(path, keeps_space)


def slices(texts: list[bytes], most: int = 2_000_000) -> Iterable[slice]:
    """Consecutive slices of about so many bytes, a text each at least: what is held at once stays bounded."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
