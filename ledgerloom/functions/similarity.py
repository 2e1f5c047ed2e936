"""Token-set similarity of two texts, in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each character of a, all updated at once for each of b."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / lengths: the share of characters that need no insertion or deletion."""
    if not a or not b:
        return float(a == b)
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best of comparing the shared words, and the shared with either text's other words, from 0 to 1."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    if both and (left <= right or right <= left):
        return 1.0
    one = " ".join(filter(None, (both, " ".join(sorted(left - right)))))
    two = " ".join(filter(None, (both, " ".join(sorted(right - left)))))
    return max(_ratio(one, two), _ratio(both, one) if both else 0.0, _ratio(both, two) if both else 0.0)


def _scores(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([token_set_ratio((x or "").upper(), (y or "").upper()) for x, y in pairs], pa.float64())


#: Called nondeterministic so that a filter on the score is not pushed below it: it would be computed anew for the rows that
#: pass, by a second Python worker of each task.
token_set_score = F.arrow_udf(_scores, T.DoubleType()).asNondeterministic()


def similarity(a: Column | str, b: Column | str) -> Column:
    """The score to four digits."""
    return F.round(token_set_score(a, b), 4)
