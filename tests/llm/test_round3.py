"""The conversation trie, ranked search and SimHash join against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import prefix_trie, ranked_search, simhash_dedup
from tests.llm import cases

TURNS = "label int, conv_id long, turn long, role string, text string, depth string"


def talks(seed: int, n: int = 140):
    """Conversations that share beginnings; some are copies, some have null turns, roles and texts, one is long."""
    rng = random.Random(seed)
    say = [("user", f"say {i}") for i in range(4)] + [(None, "x"), ("user", None), (None, None), ("userx", "")]
    rows, kept = [], []
    for c in [*range(n), 200, 305, 399, -7, -100, 1000]:
        own = [rng.choice(say[: rng.choice([2, 3, 8])]) for _ in range(rng.choice([1, 2, 3, 5, 7, 9]))]
        if kept and rng.random() < 0.5:
            own = rng.choice(kept)[: rng.randint(1, 9)] + own[: rng.randint(0, 3)]
        kept.append(own)
        for k, (role, text) in enumerate(own):
            rows.append((7, c, None if k == 0 and rng.random() < 0.3 else k, role, text, "x"))
    rows += [(7, 77_777, k, "user", "long " * (k % 3), "x") for k in range(300)]
    rows += [(7, 77_701, k, "user", "long " * (k % 3), "x") for k in range(250)]
    rows += [(7, None, 0, "user", "nobody's", "x"), (7, 50, 1, "user", "tie a", "x"), (7, 50, 1, "user", "tie b", "x")]
    rng.shuffle(rows)
    return rows


def plain_trie(rows):
    token = lambda role, text: hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
    own = defaultdict(list)
    for _, c, turn, role, text, _ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, token(role, text), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p, who: hashlib.sha256(",".join(str(c) for c in sorted(who) if built[c] == p).encode()).hexdigest()
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p], sha(p, who)) for p, who in members.items()), key=key)


@pytest.mark.parametrize(("seed", "block"), [(1, 20_000), (2, 1), (3, 7), (4, 40)])
def test_trie_equals_one_of_all_prefixes(spark, seed, block):
    rows = talks(seed)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), block).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: tuple((x is not None, x) for x in r)) == plain_trie(rows)


def test_trie_of_copies_of_turnless_and_of_no_conversations(spark):
    rows = [(7, c, 0, "user", "hi", "x") for c in range(100, 160)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), 3).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == plain_trie(rows)
    turnless = [(7, c, 0, "user", "hi", "x") for c in range(101, 120) if zlib.crc32(str(c).encode()) % 6]
    got = prefix_trie.prefix_trie(spark.createDataFrame(turnless, TURNS), 3).collect()
    assert [tuple(r) for r in got] == plain_trie(turnless)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


ITEMS = "text string, item_id long, rank string"


def plain_search(docs, items, best):
    words = lambda t: re.findall(ranked_search.TERM, (t or "").translate(cases.LOWER))
    found = [(i, Counter(words(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    of = defaultdict(Counter)
    for item, text in set((i, t or "") for i, t in items):
        of[item].update(words(text))
    rows = []
    for item, terms in of.items():
        scores = []
        for i, c, n in found:
            m = 75 + 25 * n * n_docs // total
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in terms.items() if c[t])
            if score > 0 and i is not None:
                scores.append((-score, i))
        rows += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:best])]
    return sorted(rows, key=repr)


def searched(seed: int):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["eightlet", "eightlett", "a" * 30, "a" * 29 + "b", "b" * 100, "b" * 99 + "c", "été", "ÉTÉ", "漢字仮名交じり", "rare"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(300)]
    docs += [(i, docs[i % 7][1]) for i in range(1000, 1100)] + cases.ODD + [(None, text(40)), (5, text(9)), (5, text(9))]
    items = [(i, text(rng.choice([1, 4, 20]))) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w1 w1 w1"), (None, "w2 w3"), (34, "w4"), (34, "w5 w4"), (34, "w4")]
    return docs, items


@pytest.mark.parametrize(("seed", "best", "postings"), [(1, 20, 10**6), (2, 3, 40), (3, 1, 10**6)])
def test_search_ranks_as_a_plain_version(spark, seed, best, postings):
    docs, items = searched(seed)
    frame = spark.createDataFrame([(t, i, "x") for i, t in items], ITEMS)
    got = ranked_search.ranked_search(cases.frame(spark, docs).repartition(5), frame, best, postings).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(docs, items, best)


def test_search_takes_empty_tables(spark):
    docs, items = cases.frame(spark, [(1, "a b")]), spark.createDataFrame([("a", 1, "x")], ITEMS)
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search.ranked_search(docs, spark.createDataFrame([("?!", 1, "x")], ITEMS)).count() == 0


def test_terms_that_differ_in_any_byte_are_told_apart():
    terms = [b"abcdefgh", b"abcdefghi", b"abcdefghj", b"x" * 70, b"x" * 69 + b"y", b"a"]
    block = ranked_search.TextBlock([b"abcdefghi a abcdefghk " + b"x" * 70 + b" " + b"x" * 69 + b"z b abcdefgh abcdefg " + b"x" * 71])
    start, end, _ = block.words(ranked_search.ALPHANUMERIC)
    assert ranked_search.Vocabulary(terms).find(block.data, start, end).tolist() == [1, 5, -1, 3, -1, -1, 0, -1, -1]


def test_radix_order_sorts_wide_keys_and_keeps_ties():
    keys = np.random.default_rng(0).integers(0, 1 << 40, 5_000) // 1_000_000
    assert ranked_search.radix_order(keys, 1 << 40).tolist() == np.argsort(keys, kind="stable").tolist()


def plain_print(text, n):
    words = (text or "").translate(cases.LOWER)
    words = cases.WORD.findall(words)
    whole = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in whole]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    """(doc_id, fingerprint, component_id), comparing all."""
    marks = [(i, plain_print(t, 3)) for i, t in rows]
    up = {i: i for i, _ in marks}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, x in marks:
        for b, y in marks:
            if a < b and (x ^ y).bit_count() <= 3:
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted((i, f"{x:016x}", root(i)) for i, x in marks)


@pytest.mark.parametrize(("seed", "members"), [(1, 2_048), (2, 32)])
def test_groups_equal_those_of_all_pairs(spark, seed, members):
    rng = random.Random(seed)
    rows = [r for r in cases.near_copies(seed) if r[0] < 900] + cases.ODD + [(960, "x " * 40 + "y" * 700 + " z " * 20), (961, "y" * 33), (962, "y" * 5_000)]
    rows += [(2_000 + i, " ".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 4])))) for i in range(60)]
    got = simhash_dedup.simhash_groups(cases.frame(spark, rows).repartition(3), members=members).collect()
    assert sorted(tuple(r) for r in got) == plain_groups(rows)


@pytest.mark.parametrize(("members", "spread"), [(2_048, 5), (32, 4)])
def test_links_connect_what_all_pairs_connect(spark, members, spread):
    """Fingerprints in balls, so that keys are large and are parted over some rounds."""
    rng = random.Random(members)
    centres = [rng.getrandbits(64) for _ in range(3)]
    marks = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, spread))) for _ in range(900)}
    rows = [(i, x - (x >> 63 << 64)) for i, x in enumerate(sorted(marks))]
    edges = simhash_dedup.links(spark.createDataFrame(rows, "rep long, print long"), members=members).collect()
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for e in edges:
        assert ((rows[e.a][1] ^ rows[e.b][1]) & (1 << 64) - 1).bit_count() <= 3
        up[root(e.a)] = root(e.b)
    for a, x in rows:
        for b, y in rows[:a]:
            assert ((x ^ y) & (1 << 64) - 1).bit_count() > 3 or root(a) == root(b)


def test_fingerprints_within_three_bits_always_share_a_key():
    rng = random.Random(0)
    bits = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]
    bits += [1 << i | 1 << j | 1 << k for i in range(64) for j in range(i) for k in range(j)]
    for x in (0, rng.getrandbits(64), rng.getrandbits(64)):
        place, key, _ = simhash_dedup.fuzzy_keys(np.array([x ^ b for b in bits], np.uint64))
        own = set(key[place == 0].tolist())
        shared = np.zeros(len(bits), bool)
        shared[place[np.isin(key, list(own))]] = True
        assert shared.all()


def test_xxh64_equals_the_library():
    rng = random.Random(1)
    texts = [rng.randbytes(n) for n in [*range(130), 255, 256, 511, 512, 513, 544, 545, 4_000]]
    ends = np.cumsum([len(t) for t in texts])
    lengths = np.array([len(t) for t in texts])
    got = simhash_dedup.xxh64(np.frombuffer(b"".join(texts), np.uint8), ends - lengths, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(t, 42) for t in texts]


def test_simhash_takes_empty_tables_null_ids_and_repeated_rows(spark):
    assert simhash_dedup.simhash_groups(cases.frame(spark, [(1, "a")]).limit(0)).count() == 0
    got = simhash_dedup.simhash_groups(cases.frame(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (4, "x y z"), (7, None), (6, "")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (4, 4), (5, 5), (5, 5), (6, 6), (7, 6)]
    kept = simhash_dedup.dedup_simhash(cases.frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "q")])).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
