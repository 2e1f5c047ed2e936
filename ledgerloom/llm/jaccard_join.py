"""N-gram Jaccard join: T-occurrence search with DivideSkip, over blocks that hold every possible link.

1. Each text becomes its set of hashed word shingles. Equal sets form one class; one member stands for it.
2. Blocking, without loss: linked sets differ in few shingles, so when shingles are dealt into one part more than that
   (and a few to spare) by their hash, some part is the same in both. Parts without rarer shingles are left out where
   the spare parts allow it; which shingles are common is counted over all documents. Sets that share a part are tied
   where the counts of their shingles by hash (sketches) differ by no more than a link allows, and the ties' connected
   components are the blocks: no link crosses two blocks.
3. In a block an inverted index maps shingles to sets. A set's query merges its short lists with a heap, probes the
   long ones by binary search for what the merge lets through, and keeps sets that reach the required overlap.
   Sets that are known to be connected are not compared again, and the component that grows first is not queried.
4. A block above ``SHINGLES_A_SLICE`` is sliced. Its hub joins every slice and is queried there; what is not linked to the
   hub is then queried in all slices. So large groups of near copies cost one query a slice, not all pairs.

Shingles, sets and parts are compared by 64-bit hashes, classes by 128 bits. Each run draws the key of its words' hashes, so
that no texts can be written beforehand that collide.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby
from math import exp, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, utf8
from .components import components
from .textblock import FIXED_KEY, NOT_WHITE, U64, TextBlock, mixed, new_key, sequences, text_blocks

SHINGLES_A_SLICE = 1_500_000
#: Size classes: the largest size over the smallest. Wider ones repeat fewer sets but need more parts.
CLASS = 1.5
#: Share of sets that may have too few strong parts and then use all their parts.
WEAK_SETS = 1e-3
COUNTERS = 1 << 17
#: Weight of a heap step against a probe, in the number of long lists T / (WEIGHT * log2(longest) + 1).
WEIGHT = 0.0085
HEAP_ENTRIES = 4_096


def shingle_sets(texts: list[bytes], n: int, key: int = FIXED_KEY) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; all words as one where there are fewer."""
    block = TextBlock(texts, lower=True, key=key)
    start, end, doc = block.words(NOT_WHITE)
    words = block.sure_hashes(start, end)
    h, of = sequences(words, doc, n)
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    counts = np.bincount(doc, minlength=len(texts))
    sets = [np.unique(h[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    first = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        total = U64(counts[i])
        for w in words[first[i] : first[i] + counts[i]]:
            total = mixed(np.array([total]) * U64(0xD1342543DE82EF95) + w)[0]
        sets[i] = np.array([total], U64)
    return sets


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    both = [mixed(tokens ^ U64(salt)).sum(dtype=U64).view(np.int64).item() for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
    return both[0], both[1]


def sketch(tokens: np.ndarray) -> bytes:
    """How many shingles fall into each of some bins, the more the larger the set, by the leading bits of a hash.

    Two sets differ in as many shingles at least as their counts do, also where counts end at 255 (a bin has some eight).
    """
    bits = max(6, (len(tokens) >> 3).bit_length())
    at = (mixed(tokens ^ U64(0x2545F4914F6CDD1D)) >> U64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


@cache
def size_class(n: int) -> tuple[int, int, int]:
    """Number, least and greatest size of the class of sets of n shingles."""
    k, low = 0, 1
    while int(low * CLASS) < n:
        k, low = k + 1, int(low * CLASS) + 1
    return k, low, int(low * CLASS)


def poisson(mean: float, most: int) -> float:
    """The chance of at most so many."""
    term = total = exp(-mean)
    for k in range(1, most + 1):
        term *= mean / k
        total += term
    return total


@cache
def deal(greatest: int, num: int, den: int) -> tuple[int, int, int]:
    """Parts, spare parts, and the rarer shingles that a strong part needs, for sets of up to so many shingles.

    Linked sets differ in (den - num) / (den + num) of the sum of their sizes at most, each difference in one part.
    """
    differ = (den - num) * 2 * greatest // (den + num)
    for strong in (3, 2, 1):
        for spare in range(1, differ // 4 + 3):
            parts = differ + 1 + spare
            mean = 0.85 * greatest / parts
            weak = parts * poisson(mean, strong - 1)
            if mean >= 3 * strong - 1 and 1 - poisson(weak, spare) <= WEAK_SETS:
                return parts, spare, strong
    return differ + 1, 0, 0


def signatures(tokens: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the parts of a set; linked sets share one at least. common: which of the tokens many sets have."""
    n = len(tokens)
    k, _, greatest = size_class(n)
    keys = [(k, greatest)]
    if den * n >= num * (greatest + 1):  # the next class may hold linked sets
        keys.append((k + 1, size_class(greatest + 1)[2]))
    made = []
    for k, greatest in keys:
        parts, spare, strong = deal(greatest, num, den)
        spread = mixed(tokens ^ U64(k + 1))
        part = (spread >> U64(33)).astype(np.int64) % parts
        total = np.zeros(parts, U64)
        np.add.at(total, part, spread)
        use = np.bincount(part[~common], minlength=parts) >= strong
        if parts - use.sum() > spare:
            use[:] = True
        at = np.flatnonzero(use)
        made.append(mixed(total[at] ^ mixed(at.astype(U64) + U64(k << 32))))
    return np.concatenate(made)


def _sets(batches: Iterator[pa.RecordBatch], n: int, key: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows and sets; the texts are in the last column."""
    for batch in batches:
        for first, last, texts in text_blocks(batch.column(batch.num_columns - 1)):
            yield batch.slice(first, last - first), shingle_sets(texts, n, key)


def _digests(docs: DataFrame, n: int, key: int) -> DataFrame:
    """kind 0: doc_id, size and fingerprint of each document's set. kind 1: shingles (size) by counter (doc_id), per task."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "size", "fp1", "fp2", "sketch"]
        counters = np.zeros(COUNTERS, np.int64)
        for rows, sets in _sets(batches, n, key):
            prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            seen = set()
            new = [s for s, p in zip(sets, map(tuple, prints.tolist()), strict=True) if not (p in seen or seen.add(p))]
            counters += np.bincount((np.concatenate(new) % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            sketches = pa.array([sketch(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), rows.column(0), sizes, *map(pa.array, prints.T), sketches], names)
        used = np.flatnonzero(counters)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int32)), pa.array(used), pa.array(counters[used]), none, none, pa.nulls(len(used), pa.binary())], names)

    return docs.mapInArrow(made, "kind int, doc_id long, size long, fp1 long, fp2 long, sketch binary")


def _common_counters(digests: DataFrame) -> np.ndarray:
    """Marks the counters that stand out: over them go shingles which one document in some hundreds has."""
    counts = np.zeros(COUNTERS, np.int64)
    for r in digests.where("kind = 1").groupBy("doc_id").agg(F.sum("size").alias("n")).collect():
        counts[r["doc_id"]] = r["n"]  # COUNTERS rows at most
    middle = float(np.median(counts))
    return counts > middle + 12 * np.sqrt(middle) + 12


def _near_sets(docs: DataFrame, sketches: DataFrame, n: int, key: int, common: np.ndarray, num: int, den: int) -> DataFrame:
    """Edges (a, b) between the first fingerprints of sets that share a part and whose sketches allow a link.

    sketches: node, size and sketch of each set.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, nodes, seen = [], [], set()
            for _, sets in _sets([batch], n, key):
                for tokens in sets:
                    node = fingerprint(tokens)[0]
                    if len(tokens) and node not in seen:
                        seen.add(node)
                        own = signatures(tokens, common[(tokens % U64(COUNTERS)).astype(np.int64)], num, den)
                        signs.append(own)
                        nodes.append(np.full(len(own), node, np.int64))
            if not signs:
                continue
            sign, node = np.concatenate(signs).view(np.int64), np.concatenate(nodes)
            yield pa.RecordBatch.from_arrays([pa.array(sign), pa.array(node)], ["sign", "node"])

    signs = docs.mapInArrow(made, "sign long, node long")
    part = Window.partitionBy("sign")
    before = F.lag("node").over(part.orderBy("node"))
    rows = signs.withColumns({"before": before, "least": F.min("node").over(part), "most": F.max("node").over(part)})
    # One row for each set and part, where the part has other sets too.
    rows = rows.where("least <> most and (before is null or before <> node)")
    # Near copies share most of their parts: parts with the same sets are one, and only it meets the sketches.
    rows = rows.select(F.bit_xor(F.xxhash64("node")).over(part).alias("sign"), "node").distinct()
    rows = cut_lineage(rows, "parts").join(sketches, "node")
    rows = rows.repartition("sign").sortWithinPartitions("sign", "node")
    return rows.mapInArrow(_near(num, den), "a long, b long").where("a <> b").distinct()


#: Sets of one part that are compared by their sketches; those of a larger part are all taken as near.
NEAR = 4_000


def _near(num: int, den: int):
    """Of rows in the order of their parts: ties between the sets of a part whose sketches allow a link, directly or over others.

    Of the ties that a task finds only those go on that connect what its others do not: fewer than it has sets.
    """

    def ties(nodes: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[int, int]]:
        if len(nodes) > NEAR:
            yield from ((x, nodes[0]) for x in nodes[1:])
            return
        width = min(map(len, sketches))
        bins = np.stack([np.frombuffer(x, np.uint8).astype(np.int32).reshape(width, -1).sum(axis=1) for x in sketches])

        def near(i: int) -> np.ndarray:
            apart = np.abs(bins - bins[i]).sum(axis=1)
            return (den + num) * apart <= (den - num) * (sizes + sizes[i])

        group = np.arange(len(nodes))
        for i in range(len(nodes)):
            if i and group[i] == group[0]:
                continue  # every set outside the first one's group is held against all
            others = np.unique(group[near(i)])
            for other in others[others != group[i]]:
                yield nodes[i], nodes[other]
                group[group == other] = group[i]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def connecting(pairs) -> list[tuple[int, int]]:
            found = []
            for a, b in pairs:
                a, b = root(int(a)), root(int(b))
                if a != b:
                    up[a] = b
                    found.append((a, b))
            return found

        sign, nodes, sizes, sketches = None, [], [], []
        for batch in batches:
            found = []
            for s, node, size, own in zip(*(batch[c].to_pylist() for c in ("sign", "node", "size", "sketch")), strict=True):
                if s != sign:
                    if len(nodes) > 1:
                        found += connecting(ties(np.array(nodes), np.array(sizes), sketches))
                    sign, nodes, sizes, sketches = s, [], [], []
                if len(nodes) > NEAR:  # held no further: tied to the first one
                    found += connecting([(node, nodes[0])])
                    continue
                nodes.append(node)
                sizes.append(size)
                sketches.append(own)
            yield _pairs(found)
        if len(nodes) > 1:
            yield _pairs(connecting(ties(np.array(nodes), np.array(sizes), sketches)))

    return made


def _pairs(found: list) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


class InvertedIndex:
    """Sets of one slice by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        tokens = np.concatenate(sets) if sets else np.zeros(0, U64)
        order = np.argsort(tokens, kind="stable")
        self.members = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, self.first = np.unique(tokens[order], return_index=True)
        self.first = np.r_[self.first, len(tokens)]

    def search(self, query: np.ndarray, num: int, den: int, fresh: Callable[[np.ndarray], np.ndarray]) -> list[int]:
        """Numbers of the sets that link with the query, of those that fresh marks among the ones it is given: DivideSkip.

        Costs as much as the lists of the query hold, not as the index.
        """
        at = np.searchsorted(self.tokens, query)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == query] if len(self.tokens) else at[:0]
        n, least = len(query), -(-num * len(query) // den)  # a linked set shares num / den of the query at least
        if len(at) < least:
            return []
        lengths = self.first[at + 1] - self.first[at]
        by_length = np.argsort(lengths, kind="stable")
        longest = int(lengths[by_length[-1]])
        n_long = min(least - 1, int(least / (WEIGHT * log2(longest + 1) + 1)), len(at) - 1)
        short, long = at[by_length[: len(at) - n_long]], at[by_length[len(at) - n_long :]]
        members, counts = self._merged(short, least - n_long, int(lengths[by_length[: len(short)]].sum()))
        able = (den * self.sizes[members] >= num * n) & (num * self.sizes[members] <= den * n)
        able[able] = fresh(members[able])
        found = []
        for member, count in zip(members[able].tolist(), counts[able].tolist(), strict=True):
            own = self.sets[member]
            probe = np.searchsorted(own, self.tokens[long])
            count += int((own[np.minimum(probe, len(own) - 1)] == self.tokens[long]).sum())
            if den * count >= num * (n + len(own) - count):
                found.append(member)
        return found

    def _merged(self, short: np.ndarray, least: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of at least so many of the short lists, and of how many."""
        lists = [self.members[self.first[t] : self.first[t + 1]] for t in short.tolist()]
        if entries <= HEAP_ENTRIES:
            runs = [(member, sum(1 for _ in run)) for member, run in groupby(heapq.merge(*(x.tolist() for x in lists)))]
            merged = np.array([x for x in runs if x[1] >= least], np.int64).reshape(-1, 2)
            return merged[:, 0], merged[:, 1]
        # The same merge by counting, over the members at hand.
        held = np.concatenate(lists)
        low = int(held.min())
        counts = np.bincount(held - low)
        members = np.flatnonzero(counts >= least)
        return members + low, counts[members]


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i

    def roots(self, of: np.ndarray) -> np.ndarray:
        """The root of each of these; also shortens their ways."""
        found = self.up[of]
        while ((above := self.up[found]) != found).any():
            found = above
        self.up[of] = found
        return found


LINKED = "rep long, root long, open boolean"


def _linked(num: int, den: int):
    """For the rows of one slice: the least rep linked with each, as root. open: a sliced block's set that is not linked with the hub."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["asks", "rep", "fp1", "fp2"], ascending=[False, True, True, True]).reset_index(drop=True)
        rows = rows.drop_duplicates(["fp1", "fp2"])
        sets = [np.frombuffer(x, "<u8") for x in rows["tokens"]]
        index, union, reps = InvertedIndex(sets), Union(len(sets)), rows["rep"].to_numpy(np.int64)
        asks, sliced = rows["asks"].to_numpy(bool), bool((rows["slices"] > 1).any())
        # In a sliced block only what asks is queried; else all but the first one's component.
        for i in range(int(asks.sum()) if sliced else len(sets)):
            own = union.root(i)
            if not sliced and i and own == union.root(0):
                continue
            for j in index.search(sets[i], num, den, lambda members: union.roots(members) != own):  # noqa: B023
                union.join(i, j)
        roots = union.roots(np.arange(len(sets)))
        # Roots are the first rows of their components; the least rep of a component names it.
        least = pd.Series(reps).groupby(roots).transform("min").to_numpy() if len(reps) else reps
        single = np.bincount(roots, minlength=len(roots))[roots] == 1
        return pd.DataFrame({"rep": reps, "root": least, "open": single & sliced})

    return link


def _of_members(docs: DataFrame, members: DataFrame, n: int, key: int) -> DataFrame:
    """members with the sets of their texts (tokens, as bytes)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _sets(batches, n, key):
            prints = [fingerprint(s) for s in sets]
            same = [p == q for p, q in zip(prints, zip(rows["fp1"].to_pylist(), rows["fp2"].to_pylist(), strict=True), strict=True)]
            own = [rows.column(c) for c in range(rows.num_columns - 1)]
            whole = pa.RecordBatch.from_arrays([*own, pa.array([s.astype("<u8").tobytes() for s in sets])], [*rows.schema.names[:-1], "tokens"])
            yield whole.filter(pa.array(same))  # where an id is repeated with other texts

    kept = ["block", "slices", "rep", "fp1", "fp2"]
    # The same join at every size: the members are no bounded table.
    rows = members.hint("merge").join(docs, members["rep"] == docs["doc_id"]).select(*kept, "utf8")
    return rows.mapInArrow(made, "block long, slices long, rep long, fp1 long, fp2 long, tokens binary")


def similar(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, shingles_a_slice: int = SHINGLES_A_SLICE) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text).

    Documents link when den * (shared shingles) >= num * (shingles of either); component_id is the smallest doc_id that
    links reach. Words are runs without ASCII white space with A-Z lower-cased; a text with fewer than n words is one
    shingle, and one without words (or null) has none and links with nothing. Rows that repeat an id keep their own
    sets and share its component where their sets do; rows with a null id have no component and link nobody. An empty
    table gives an empty table; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("utf8"))
    hashed = new_key()
    digests = cut_lineage(_digests(docs, n, hashed), "digests")
    rows = digests.where("kind = 0").drop("kind")
    classes = rows.where("size > 0 and doc_id is not null").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size"))
    sketches = rows.where("size > 0 and doc_id is not null").groupBy(F.col("fp1").alias("node")).agg(F.max("size").alias("size"), F.max("sketch").alias("sketch"))
    blocks = components(_near_sets(docs.where("doc_id is not null"), sketches, n, hashed, _common_counters(digests), num, den))
    blocks = blocks.unionByName(blocks.select(F.col("component").alias("node"), "component").distinct())
    members = classes.join(blocks, classes["fp1"] == blocks["node"]).select("rep", "fp1", "fp2", "size", F.col("component").alias("block"))
    sizes = members.groupBy("block").agg(F.sum("size").alias("total"), F.min(F.struct("rep", "fp1", "fp2")).alias("hub"))
    sizes = sizes.withColumn("slices", F.ceil(F.col("total") / shingles_a_slice))
    members = cut_lineage(members.join(sizes, "block"), "members")
    sets = _of_members(docs, members.select("block", "slices", "rep", "fp1", "fp2"), n, hashed)
    key, link = ["block", "slice", "turn"], _linked(num, den)
    alone = {"slice": F.lit(0), "turn": F.lit(0), "asks": F.lit(False)}
    if members.where("slices > 1").isEmpty():
        roots = sets.withColumns(alone).groupBy(key).applyInPandas(link, LINKED).select("rep", "root")
    else:
        sets = cut_lineage(sets, "sets")
        sliced = sets.where("slices > 1").withColumn("slice", F.expr("cast(pmod(xxhash64(fp1, fp2), slices) as int)"))

        def asked(asking: DataFrame) -> DataFrame:
            """Groups of one slice and so much of what asks; what asks in a block takes turns by its whole size."""
            sums = asking.groupBy("block").agg(F.expr(f"cast(ceil(sum(length(tokens)) / {8 * shingles_a_slice}) as int)").alias("turns"))
            turned = asking.join(sums, "block").withColumn("turn", F.expr("cast(pmod(xxhash64(fp2, fp1), turns) as int)"))
            turned = turned.withColumns({"slice": F.expr("explode(sequence(0, cast(slices as int) - 1))"), "asks": F.lit(True)})
            rest = sliced.join(sums, "block").withColumns({"turn": F.expr("explode(sequence(0, turns - 1))"), "asks": F.lit(False)})
            return rest.unionByName(turned).groupBy(key).applyInPandas(link, LINKED)

        hubs = sizes.where("slices > 1").select("block", F.col("hub.fp1").alias("fp1"), F.col("hub.fp2").alias("fp2"))
        first = cut_lineage(asked(sliced.join(hubs, ["block", "fp1", "fp2"], "left_semi")), "hub-links")
        opened = first.groupBy("rep").agg(F.min("open").alias("open")).where("open").select("rep")
        second = asked(sliced.join(opened, "rep", "left_semi"))
        edges = first.unionByName(second).select(F.col("rep").alias("a"), F.col("root").alias("b"))
        roots = sets.where("slices = 1").withColumns(alone).groupBy(key).applyInPandas(link, LINKED).select("rep", "root")
        roots = roots.unionByName(components(edges).select(F.col("node").alias("rep"), F.col("component").alias("root")))
    roots = roots.groupBy("rep").agg(F.min("root").alias("root"))
    named = classes.select("fp1", "fp2", "rep").join(roots, "rep", "left")
    named = named.select("fp1", "fp2", F.coalesce("root", "rep").alias("component"))
    # Only classes have a component; a hot class is split by the skew join.
    out = rows.join(named, ["fp1", "fp2"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def dedup_similar(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, but of each group of linked documents only those with its smallest doc_id."""
    groups = similar(docs, n, num, den)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
