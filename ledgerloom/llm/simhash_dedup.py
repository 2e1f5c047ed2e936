"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by fuzzy hashes of the Golay code.

1. A text's fingerprint is the bitwise majority of its shingles' XXH64, computed for many shingles at once by numpy.
   Equal fingerprints form one class; its smallest id stands for it.
2. The binary Golay code [23, 12, 7] is perfect: each 23-bit word is within 3 bits of one codeword. So two words that
   differ in at most 2 bits are within 4 bits of a common codeword (that of a word between them), and a word's
   codewords within 4 bits are few: 1 or 6. Their indices are its fuzzy hashes of 12 bits.
3. Pigeonhole: fingerprints have six segments. Six keys join two segments that must be equal with the fuzzy hashes of
   two others. However 3 differing bits fall, one of the six has none in its equal segments and at most 2 in the fuzzy
   ones (a test holds this for all patterns). A fingerprint has 6 to 36 keys of 32 to 34 bits.
4. Members of a key are compared; only links that connect what is not connected yet go on. A key with many members is
   not compared but parted: of the bits that its members may still differ in, four pieces are made, one of which is
   equal in linked fingerprints; members meet again by key and piece, over as many rounds as it takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, utf8
from .components import components
from .textblock import NOT_WHITE, U64, TextBlock, mixed, text_blocks

DISTANCE = 3
SEED = 42
#: Members of a key that are compared with each other; the members of a larger one are parted. At least 8: four pieces need
#: four bits, and members that differ in three bits only are 8 at most, so each round parts what it takes and the last one ends.
MEMBERS = 2_048

#: Bits of the six segments, and for each key its equal segments and its fuzzy ones.
SEGMENTS = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))
KEYS = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((1, 2), (0, 3)), ((3, 4), (0, 1)), ((3, 5), (0, 2)), ((4, 5), (1, 2)))
#: The code's generating polynomial (fixed value).
GENERATOR = 0xC75

# Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_ONES = (1 << 64) - 1
_MOST_STRIPES = 16


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def _mix(x: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(x + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of one byte array, slices with equally many bytes after their last 32 at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = U64((seed + int(_P5)) & _ONES) + length.astype(U64)
    at = start.copy()
    stripes = length >> 5
    wide = np.flatnonzero((stripes > 0) & (stripes <= _MOST_STRIPES))
    if len(wide):
        v = [np.full(len(wide), (seed + x) & _ONES, U64) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        for k in range(int(stripes[wide].max())):
            go = np.flatnonzero(stripes[wide] > k)
            for i in range(4):
                v[i][go] = _mix(v[i][go], words[start[wide[go]] + 32 * k + 8 * i])
        total = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
        for x in v:
            total = (total ^ _mix(np.zeros_like(x), x)) * _P1 + _P4
        h[wide] = total + length[wide].astype(U64)
        at[wide] += stripes[wide] << 5
    rest = (length & 31).astype(np.uint8)
    order = np.argsort(rest, kind="stable")
    bounds = np.searchsorted(rest[order], np.arange(33))
    for r in range(32):
        own = order[bounds[r] : bounds[r + 1]]
        if not len(own):
            continue
        x, p = h[own], at[own]
        for _ in range(r // 8):
            x = _turned(x ^ _mix(np.zeros_like(x), words[p]), 27) * _P1 + _P4
            p = p + 8
        if r & 4:
            x = _turned(x ^ (words[p] & U64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
            p = p + 4
        for _ in range(r & 3):
            x = _turned(x ^ padded[p].astype(U64) * _P5, 11) * _P1
            p = p + 1
        h[own] = x
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    for i in np.flatnonzero(stripes > _MOST_STRIPES).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]].tobytes(), seed)
    return h


def fingerprints(texts: list[bytes], n: int) -> np.ndarray:
    """A bit is 1 where it is in over half of the hashes of a text's n-word shingles; no words: zero."""
    block = TextBlock(texts, lower=True)
    start, end, doc = block.words(NOT_WHITE)
    keep, data = NOT_WHITE[block.data], block.data.copy()
    keep[end] = True
    data[end] = 0x20
    data, length = data[keep], end - start  # each word and one space
    start = np.cumsum(length + 1) - length - 1
    words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(words) - words
    whole = np.flatnonzero(doc[: max(len(doc) - n + 1, 0)] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
    few = np.flatnonzero((words > 0) & (words < n))
    begin, last = np.r_[whole, first[few]], np.r_[whole + n - 1, first[few] + words[few] - 1]
    of = doc[begin]
    order = np.argsort(of, kind="stable") if len(few) else slice(None)
    begin, last, of = begin[order], last[order], of[order]
    h = xxh64(data, start[begin], start[last] + length[last] - start[begin])
    counts, made = np.bincount(of, minlength=len(texts)), np.zeros((len(texts), 64), np.int64)
    for a in range(0, len(h), 65_536):
        part = of[a : a + 65_536]
        bits = np.unpackbits(h[a : a + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        runs = np.flatnonzero(np.diff(part, prepend=-1))
        made[part[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int64)
    return np.packbits(2 * made > counts[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def prints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each row of docs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(fingerprints(texts, n).view(np.int64))], ["doc_id", "print"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).mapInArrow(made, "doc_id long, print long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 12 low and the 11 high bits of a word, and by remainder the flips that lead to codewords within 4 bits (-1: no more)."""
    bit = []
    for i in range(23):
        x = 1 << i
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        bit.append(x)
    halves = []
    for bits in (bit[:12], bit[12:]):
        table = np.zeros(1, np.int64)
        for x in bits:
            table = np.r_[table, table ^ x]
        halves.append(table)
    flips: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            rest = 0
            for p in places:
                rest ^= bit[p]
            flips[rest].append(sum(1 << p for p in places))
    table = np.full((2048, max(map(len, flips))), -1, np.int64)
    for i, own in enumerate(flips):
        table[i, : len(own)] = own
    return halves[0], halves[1], table


def codewords(words: np.ndarray) -> np.ndarray:
    """The indices of the codewords within 4 bits of each 23-bit word, a row each, -1 where there are no more."""
    low, high, flips = golay()
    near = flips[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(near < 0, -1, (words[:, None] ^ near) >> 11)


def _bits(x: np.ndarray, segments: tuple[int, ...]) -> tuple[np.ndarray, int]:
    made, width = np.zeros(len(x), U64), 0
    for a, b in (SEGMENTS[s] for s in segments):
        made |= (x >> U64(a) & U64((1 << (b - a)) - 1)) << U64(width)
        width += b - a
    return made, width


def fuzzy_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key of each fingerprint: the fingerprint's place, the key, and the bits that the key holds equal."""
    places, keys, masks = [], [], []
    for k, (equal, fuzzy) in enumerate(KEYS):
        same, width = _bits(x, equal)
        index = codewords(_bits(x, fuzzy)[0].astype(np.int64))
        place, which = np.nonzero(index >= 0)
        places.append(place)
        keys.append(U64(k << 40) | same[place] << U64(12) | index[place, which].astype(U64))
        masks.append(np.full(len(place), sum(((1 << b) - (1 << a)) for a, b in (SEGMENTS[s] for s in equal)), U64))
    return np.concatenate(places), np.concatenate(keys), np.concatenate(masks)


MEMBER = "key long, held long, print long, rep long"
LINKS = f"{MEMBER}, a long, b long"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, rep = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()
        place, key, held = fuzzy_keys(x)
        columns = (key, held, x[place], rep[place])
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["key", "held", "print", "rep"])


def connecting(x: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between fingerprints of one key that connect all that are connected, one fewer than each component has."""
    links, rest = [], np.arange(len(x))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.bitwise_count(x[rest] ^ x[i]) <= distance
            links += [(i, j) for j in rest[near]]
            queue += rest[near].tolist()
            rest = rest[~near]
    return links


def parted(key: np.ndarray, held: np.ndarray, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the members of one large key for the next round, by pieces of the bits that are not held: place, key and held bits."""
    bits = [i for i in range(64) if not int(held[0]) >> i & 1]
    places, keys, masks = [], [], []
    for piece in range(distance + 1):
        mask = U64(sum(1 << i for i in bits[piece :: distance + 1]))
        places.append(np.arange(len(x)))
        keys.append(mixed(mixed(key ^ mixed(np.full(len(x), mask))) + (x & mask)))
        masks.append(held | mask)
    return np.concatenate(places), np.concatenate(keys), np.concatenate(masks)


def _compared(members: int, distance: int):
    """Of rows in the order of their keys: links (a, b) between reps; members of a large key as rows of the next round."""

    def links_of(x: np.ndarray, rep: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[list, list]:
        two = begin[size == 2]
        near = two[np.bitwise_count(x[two] ^ x[two + 1]) <= distance]
        a, b = [rep[near]], [rep[near + 1]]
        for i, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if found := connecting(x[i : i + n], distance):
                pairs = np.array(found) + i
                a.append(rep[pairs[:, 0]])
                b.append(rep[pairs[:, 1]])
        return a, b

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in LINKS.split(", ")]
        empty = np.zeros(0, np.int64)
        key, held, x, rep = (empty.view(U64),) * 3 + (empty,)
        large = None

        def batch_of(go: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            place, own, mask = parted(key[go], held[go], x[go], distance) if len(go) else (go, key[:0], held[:0])
            more = [own.view(np.int64), mask.view(np.int64), x[go][place].view(np.int64), rep[go][place]]
            columns = [pa.concat_arrays([pa.array(c), pa.nulls(len(a), pa.int64())]) for c in more]
            return pa.RecordBatch.from_arrays([*columns, *(pa.concat_arrays([pa.nulls(len(place), pa.int64()), pa.array(c)]) for c in (a, b))], names)

        def settled(final: bool) -> Iterator[pa.RecordBatch]:
            """Takes all keys but the last, which may go on, out of what is held."""
            nonlocal key, held, x, rep, large
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else empty
            size = np.diff(np.r_[begin, len(key)])
            big = size > members
            if len(begin) and large is not None:
                big[0] |= key[0] == large
            open_ = 0 if final or not len(begin) or big[-1] else int(size[-1])
            large = key[-1] if len(begin) and big[-1] else None
            if open_:
                begin, size, big = begin[:-1], size[:-1], big[:-1]
            a, b = links_of(x, rep, begin[~big], size[~big])
            pairs = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1), axis=0)
            yield batch_of(empty, pairs[:, 0].copy(), pairs[:, 1].copy())
            for i, n in zip(begin[big].tolist(), size[big].tolist(), strict=True):
                yield batch_of(np.arange(i, i + n), empty, empty)
            keep = slice(len(key) - open_, None)
            key, held, x, rep = key[keep], held[keep], x[keep], rep[keep]

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(4)]
            key, held, x = (np.concatenate([old, c.view(U64)]) for old, c in zip((key, held, x), new, strict=False))
            rep = np.concatenate([rep, new[3]])
            yield from settled(False)
        yield from settled(True)

    return made


def links(classes: DataFrame, distance: int = DISTANCE, members: int = MEMBERS) -> DataFrame:
    """Pairs (a, b) of reps of different fingerprints (print, rep) that connect all whose prints differ in so many bits at most."""
    members = max(members, 2**distance)
    rows, found = classes.select("print", "rep").mapInArrow(_members, MEMBER), None
    while True:
        met = rows.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_compared(members, distance), LINKS)
        table = cut_lineage(met, "simhash-links")
        own = table.where("a is not null").select("a", "b")
        found = own if found is None else found.unionByName(own)
        rows = table.where("key is not null").select("key", "held", "print", "rep")
        if rows.isEmpty():
            return found


def simhash_groups(docs: DataFrame, n: int = 3, members: int = MEMBERS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of docs (doc_id, text).

    Documents link when their fingerprints differ in at most 3 bits; component_id is the smallest doc_id that links reach.
    Words are runs without ASCII white space with A-Z lower-cased; a text with fewer than n words is one shingle, one
    without words (or null) has fingerprint zero. Rows that repeat an id keep their own fingerprints; rows with a null
    id have no component and link nobody. An empty table gives an empty table; other columns are ignored.
    """
    rows = cut_lineage(prints(docs, n), "fingerprints")
    classes = rows.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"))
    roots = components(links(classes, members=members))
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("print", F.coalesce("component", "rep").alias("component"))
    # A hot fingerprint is split by the skew join.
    out = rows.join(named, "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def dedup_simhash(docs: DataFrame, n: int = 5) -> DataFrame:
    """The rows of docs, but of each group of linked documents only those with its smallest doc_id."""
    groups = simhash_groups(docs, n)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
