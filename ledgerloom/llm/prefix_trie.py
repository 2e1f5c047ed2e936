"""Conversation prefix trie: the Cartesian tree over the LCP array of the sorted conversations, built block by block.

1. A turn becomes 128 bits of the SHA-256 of its role and text, a conversation the string of its turns. Equal
   conversations are counted as one from here on; the digest of their ids comes from a global sort by range.
2. Distinct conversations are sorted by range, so that a node's members are neighbours. In the array of common prefixes
   of neighbours (LCP) a node of depth d is an interval that ends on either side at the nearest smaller value.
3. Each block of the order finds its nearest smaller values with a stack; cuts of equal value meet in one node. Sums over
   an interval (conversations, leaves, code points) are differences of running sums. What reaches over a block's ends
   is its state: its first conversation with the cuts that are block minima so far, its open nodes, and its sums.
4. One pass over the states (some rows a block, however large the groups) finds the nearest smaller block minima and
   with them the nodes that cross blocks. Depths without a branch are expanded last, by Spark.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

ROWS_A_BLOCK = 20_000
#: Bytes of a turn's digest.
TOKEN = 16
#: Most turns that come from the conversation before; a conversation's share is its id's CRC32 modulo one more.
HEAD = 5

RUNS = "digest binary, least long, n_convs long, ends string, ids binary"
NODES = "conv_id long, parent long, n_convs long, n_children long, n_leaves long, base long, lo int, before array<long>, ends string"
LOCAL = f"block int, side int, {NODES}, first binary, state binary"
MERGED = f"block int, side int, {NODES}"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    fields = [f.split(" ") for f in schema.split(", ")]
    for k in range(0, len(rows), 5_000):
        columns = zip(*rows[k : k + 5_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, tokens (a digest a turn, as hexadecimal digits) and points (code points a turn) in the order of turns."""
    token = F.sha2(F.concat(F.octet_length(_text("role")).cast("string"), F.lit(":"), _text("role"), _text("text")), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"),
            F.col("turn").cast("long").alias("turn"),
            F.substring(token, 1, 2 * TOKEN).alias("token"),
            F.char_length(_text("text")).alias("points"),
        ).alias("own"),
    )
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("own")).alias("own"))
    return turns.select("conv_id", F.col("own.token").alias("tokens"), F.col("own.points").alias("points"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, digest, key and points of each conversation after its first turns were taken from its hundred's first."""
    own = sequences(conversations)
    heads = own.where("conv_id % 100 = 0").select(
        F.col("conv_id").alias("of"), *(F.slice(c, 1, HEAD).alias(f"head_{c}") for c in ("tokens", "points"))
    )
    joined = own.join(heads, F.expr("conv_id - conv_id % 100") == heads["of"], "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")

    def both(name: str) -> Column:
        none = F.array().cast("array<string>" if name == "tokens" else "array<int>")
        return F.concat(F.slice(F.coalesce(F.col(f"head_{name}"), none), F.lit(1), h), F.slice(name, h + 1, F.size(name)))

    rows = joined.select("conv_id", F.unhex(F.array_join(both("tokens"), "")).alias("key"), both("points").alias("points"))
    return rows.select("conv_id", F.unhex(F.sha2("key", 256)).alias("digest"), "key", "points")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest and conv_id: each digest's least id, rows and SHA-256 of its ids joined by commas.

    A task's first and last digest may go on in other tasks; their ids go along as text.
    """
    rows, now, least, ids = [], None, 0, []
    first = True

    def done(edge: bool) -> None:
        text = ",".join(map(str, ids)).encode()
        rows.append((now, least, len(ids), None if edge else hashlib.sha256(text).hexdigest(), text if edge else None))

    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for digest, own in groupby(pairs, key=lambda x: x[0]):
            if digest != now:
                if now is not None:
                    done(first)
                    first = False
                now, ids = digest, []
            ids += [i for _, i in own]
            least = ids[0]
        if len(rows) > 5_000:
            yield from _batches(rows, RUNS)
            rows.clear()
    if now is not None:
        done(True)
    yield from _batches(rows, RUNS)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of parts of runs sorted by digest and least: the whole runs, their texts hashed one after the other."""
    now, least, n, sha = None, 0, 0, None
    for batch in batches:
        rows = []
        for part in batch.to_pylist():
            if part["digest"] != now:
                if now is not None:
                    rows.append((now, least, n, sha.hexdigest(), None))
                now, least, n, sha = part["digest"], part["least"], 0, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(part["ids"])
            n += part["n_convs"]
        yield from _batches(rows, RUNS)
    if now is not None:
        yield from _batches([(now, least, n, sha.hexdigest(), None)], RUNS)


def classes(rows: DataFrame, rows_a_block: int) -> DataFrame:
    """digest, least, n_convs and ends of each distinct conversation; a task has so many rows, however many copies there are."""
    parts = max(1, -(-rows.count() // rows_a_block))
    pairs = rows.select("digest", "conv_id").repartitionByRange(parts, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    runs = cut_lineage(pairs.mapInArrow(_runs, RUNS), "runs")
    edges = runs.where("ids is not null").repartition("digest").sortWithinPartitions("digest", "least").mapInArrow(_whole_runs, RUNS)
    return runs.where("ids is null").unionByName(edges).drop("ids")


class Node:
    """The trie's nodes of depth lo + 1 to hi over one interval of the order, which starts at conv: (conv_id, n_convs, before, ends)."""

    __slots__ = ("conv", "lo", "hi", "at", "least", "fresh", "parent", "n", "leaves", "base")

    def __init__(self, conv: tuple, lo: int, hi: int, at: tuple, least: int, fresh: int = 0):
        self.conv, self.lo, self.hi, self.at, self.least, self.fresh, self.parent = conv, lo, hi, at, least, fresh, None

    def row(self, parent: int | None) -> tuple:
        """As in NODES. base and before: saved tokens of depth d are base - (n_convs - 1) * (code points of the d - 1 first turns)."""
        before, ends = self.conv[2], self.conv[3]
        whole = self.hi == len(before) - 1
        above = [before[max(d - 1, 0)] for d in range(self.lo + 1, self.hi + 1)]
        return (self.least, parent, self.n, self.fresh + (not whole), self.leaves, self.base, self.lo, above, ends if whole else None)


class NearestSmaller:
    """The stack of open nodes, from the root down. sums: conversations, their code points, new code points, leaves so far."""

    def __init__(self):
        self.open: list[Node] = []
        self.closed: list[Node] = []
        self.sums = (0, 0, 0, 0)

    def close(self, depth: int) -> list[Node]:
        """Ends all nodes deeper than a prefix that neighbours share; a node over depths on both sides is parted."""
        done = []
        while self.open and self.open[-1].hi > depth:
            top = self.open.pop()
            if top.lo < depth:
                self.open.append(Node(top.conv, top.lo, depth, top.at, top.least))
                top.lo = depth
            n, points, new, leaves = (a - b for a, b in zip(self.sums, top.at, strict=True))
            top.n, top.leaves, top.base = n, leaves, points - new - top.conv[2][-1]
            if self.open:
                top.parent = self.open[-1]
                top.parent.least = min(top.parent.least, top.least)
            done.append(top)
        self.closed += done
        return done

    def begin(self, conv: tuple, shared: int) -> None:
        """A conversation that shares so many turns with the one before opens a node below them."""
        if self.open:
            self.open[-1].fresh += 1
        n, points, new, leaves = self.sums
        new += conv[2][-1] - (conv[2][shared] if shared >= 0 else 0)
        self.sums = (n, points, new, leaves)
        self.open.append(Node(conv, shared, len(conv[2]) - 1, self.sums, conv[0]))

    def add(self, sums: tuple) -> None:
        self.sums = tuple(a + b for a, b in zip(self.sums, sums, strict=True))


def shared_turns(a: bytes, b: bytes) -> int:
    n, most = 0, min(len(a), len(b)) // TOKEN
    while n < most and a[TOKEN * n : TOKEN * (n + 1)] == b[TOKEN * n : TOKEN * (n + 1)]:
        n += 1
    return n


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes inside one block of the order, and the block's state.

    A node whose parent reaches over the block's ends names it by side (0: it starts at the block's first row, 1: it is
    open at its end) and depth (its own lo).
    """
    block, stack, cuts = TaskContext.get().partitionId(), NearestSmaller(), []
    first = last = None
    for batch in batches:
        for row in batch.to_pylist():
            conv = (row["least"], row["n_convs"], list(accumulate(row["points"], initial=0)), row["ends"])
            if first is None:
                first = (row["key"], conv)
                stack.open.append(Node(conv, -1, len(conv[2]) - 1, stack.sums, conv[0]))
            else:
                shared = shared_turns(last, row["key"])
                stack.add((0, 0, 0, int(shared < len(last) // TOKEN)))
                for node in stack.close(shared):
                    if node.conv is first[1]:
                        cuts.append((node.lo, node.hi, node.fresh, node.least, stack.sums))
                stack.begin(conv, shared)
            stack.add((conv[1], conv[1] * conv[2][-1], 0, 0))
            last = row["key"]
    if first is None:
        return
    bottom, *right = stack.open
    rows, ends_open = [], set(map(id, right))
    for node in stack.closed:
        if node.conv is not first[1]:
            side = 0 if node.parent.conv is first[1] else 1 if id(node.parent) in ends_open else None
            rows.append((block, side, *node.row(node.parent.least if side is None else None), None, None))
    state = (block, first, last, cuts, (bottom.hi, bottom.fresh, bottom.least), [(n.conv, n.lo, n.hi, n.at, n.least, n.fresh) for n in right], stack.sums)
    rows.append((block, None, *[None] * 9, first[0], pickle.dumps(state)))
    yield from _batches(rows, LOCAL)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the blocks' states in order: the nodes that reach over blocks, and the least id of those that blocks name (n_convs null)."""
    stack, last, named = NearestSmaller(), None, []
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            block, (key, conv), end, cuts, (hi, fresh, least), right, total = pickle.loads(packed)
            shared = -1 if last is None else shared_turns(last, key)
            if last is not None:
                stack.add((0, 0, 0, int(shared < len(last) // TOKEN)))
            stack.close(shared)
            stack.begin(conv, shared)
            base = stack.sums

            def grown(own_hi: int, own_fresh: int, own_least: int) -> None:
                top = stack.open[-1]
                top.fresh += own_fresh
                top.least = min(top.least, own_least)
                named.append((block, 0, own_hi, top))

            for own_lo, own_hi, own_fresh, own_least, sums in cuts:
                stack.sums = base
                stack.add(sums)
                grown(own_hi, own_fresh, own_least)
                stack.close(own_lo)
            grown(hi, fresh, least)
            for own, own_lo, own_hi, at, own_least, own_fresh in right:
                stack.sums = base
                stack.add(at)
                stack.open.append(Node(own, own_lo, own_hi, stack.sums, own_least, own_fresh))
                named.append((block, 1, own_hi, stack.open[-1]))
            stack.sums = base
            stack.add(total)
            last = end
    stack.add((0, 0, 0, 1))
    stack.close(-1)
    rows = [(None, None, *node.row(node.parent.least if node.parent else None)) for node in stack.closed]
    rows += [(block, side, node.least, *[None] * 5, depth, None, None) for block, side, depth, node in named]
    yield from _batches(rows, MERGED)


def prefix_trie(conversations: DataFrame, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text): conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, those of equal turn by their digest (equal rows are interchangeable); a null
    role or text is empty; rows without a conv_id belong to no conversation. Copies count once each. A conversation of
    which no turn is left is a member of the root alone. An empty table gives an empty table; other columns are ignored.
    A conversation's digests (16 bytes a turn) lie in one row.
    """
    rows = cut_lineage(rebuilt(conversations), "rebuilt")
    kinds = cut_lineage(classes(rows, rows_a_block), "classes")
    members = rows.join(kinds.withColumnRenamed("digest", "of"), (F.col("conv_id") == F.col("least")) & (F.col("digest") == F.col("of")))
    blocks = max(1, -(-kinds.count() // rows_a_block))
    ordered = members.select("key", "least", "n_convs", "ends", "points").repartitionByRange(blocks, "key").sortWithinPartitions("key")
    local = cut_lineage(ordered.mapInArrow(_block, LOCAL), "trie-blocks")
    states = local.where("state is not null").select("state", "first").repartition(1).sortWithinPartitions("first")
    merged = cut_lineage(states.select("state").mapInArrow(_merge, MERGED), "trie-merged")
    names = [f.split(" ")[0] for f in NODES.split(", ")]
    inside = local.where("state is null")
    above = merged.where("n_convs is null").select("block", "side", "lo", F.col("conv_id").alias("above"))
    crossing = inside.where("side is not null").join(above, ["block", "side", "lo"]).withColumn("parent", F.col("above"))
    nodes = inside.where("side is null").select(names).unionByName(crossing.select(names)).unionByName(merged.where("n_convs is not null").select(names))
    deep = nodes.select(*names, F.posexplode("before").alias("nth", "points"))
    whole = F.col("nth") == F.size("before") - 1
    return deep.select(
        "conv_id",
        (F.col("lo") + 1 + F.col("nth")).cast("long").alias("depth"),
        F.when(F.col("nth") == 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(whole, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("base") - (F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"),
        F.coalesce(F.when(whole, F.col("ends")), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


ORACLE_SQL = """
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
         lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS steps
), ids AS (
  SELECT conv_id, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT),
         lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), steps
), digests AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token,
         length(coalesce(text, '')) AS points
  FROM conversations
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) AS pos FROM digests
), parts AS (
  SELECT i.conv_id, 0 AS part, t.pos, t.token, t.points FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 AND t.pos <= i.h
  UNION ALL
  SELECT i.conv_id, 1, t.pos, t.token, t.points FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h
), whole AS (
  SELECT i.conv_id, coalesce(list(p.token ORDER BY p.part, p.pos) FILTER (p.token IS NOT NULL), []) AS tokens,
         coalesce(list(p.points ORDER BY p.part, p.pos) FILTER (p.token IS NOT NULL), []) AS points
  FROM ids i LEFT JOIN parts p USING (conv_id) GROUP BY i.conv_id
), prefixes AS (
  SELECT conv_id, tokens, points, unnest(range(len(tokens) + 1)) AS depth FROM whole
), nodes AS (
  SELECT tokens[1:depth] AS path, depth, any_value(CASE WHEN depth = 0 THEN [] ELSE tokens[1:depth - 1] END) AS up, min(conv_id) AS conv_id,
         count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE points[depth] END) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(tokens) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY tokens[1:depth], depth
), children AS (
  SELECT up AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up, depth
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.path AND n.depth = c.depth
), upward AS (
  SELECT path, depth, n_convs, own, n_children, unnest(range(depth + 1)) AS top FROM counted
), subtrees AS (
  SELECT path[1:top] AS path, top AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
         sum((n_convs - 1) * own)::BIGINT AS saved_tokens
  FROM upward GROUP BY path[1:top], top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees s ON n.path = s.path AND n.depth = s.depth
LEFT JOIN counted p ON n.depth > 0 AND p.path = n.up AND p.depth = n.depth - 1
"""
