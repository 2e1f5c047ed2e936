"""Small corpora with every odd case, and plain versions of what the operators must return."""

from __future__ import annotations

import hashlib
import random
import re
import string

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

DOCS = "text string, doc_id long, label int, n_chars string"  # two columns whose names clash with the operators' own

ODD = [
    (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "One"), (905, "a" * 350), (906, "é漢 <|endoftext|> \x00 ½ﬁ"),
    (907, "word " * 3000), (908, "a  b\tc d  e \n \n f"), (909, "the same text"), (910, "the  same\ttext"), (911, "the same text"),
]


def frame(spark, rows):
    return spark.createDataFrame([(text, doc_id, 7, "x") for doc_id, text in rows], DOCS)


def near_copies(seed: int, groups: int = 25, hot: int = 60):
    """Texts in groups of near copies, one of the groups large."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    bases = [[rng.choice(words) for _ in range(rng.choice([2, 5, 12, 30, 80, 300]))] for _ in range(groups)]
    rows = []
    for base in bases + [[rng.choice(words) for _ in range(120)]] * hot:
        for _ in range(rng.choice([1, 1, 2, 4])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(text))
                text[k : k + rng.choice([0, 1])] = [rng.choice(words)]
            rows.append((len(rows), " ".join(text)))
    return rows + ODD


def shared_passages(seed: int):
    """Texts that repeat passages of each other and of themselves."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.choice([10, 22, 40, 120])) for _ in range(15)]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages)[rng.choice([0, 0, 7]) :] if rng.random() < 0.6 else text(rng.choice([1, 5, 40])) for _ in range(rng.choice([0, 1, 2, 3]))]
        rows.append((i, "\n".join(parts)))
    return rows + ODD + [(950, rows[3][1]), (951, "ab" * 200), (952, "a" * 99), (953, "a" * 100)]


def linked(rows, n, num, den):
    """(doc_id, shingles, component) of each row, by comparing all that share a shingle."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and shared and den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def cut(rows, length=100):
    """(doc_id, bytes, removed, spans, sha256 of what is kept) of each row, with a set of all strings seen."""
    seen, made = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for k in range(len(data) - length + 1):
            own = data[k : k + length]
            if own in seen:
                covered[k : k + length] = b"\1" * length
            seen.add(own)
        kept = bytes(x for x, c in zip(data, covered) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        made.append((i, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return made
