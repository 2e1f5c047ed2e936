"""Pairs the two sides of transfers between accounts: nearest in time, each row once.

A row that may pair takes its nearest free counterpart, and rows take their turns by date and id; what one takes the next
no longer finds. So the rows of a tenant and amount are swept in that order, and no pair of candidates is ever listed: a
task reads its rows sorted and holds only the days that are in reach. Every row costs the logarithm of the accounts of
a day, also where an amount has very many rows a day.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DIRECTIONS, PAIRING_DAYS, TRANSFER_MOVEMENTS

PAIRS = "tenant_id long, amount decimal(18,2), txn_id string, paired_with string, gap_days int"


def runs(ledger: DataFrame, days: int = PAIRING_DAYS) -> DataFrame:
    """tenant_id, amount, day and run of each day of a tenant and amount; runs lie more than so many days apart, and no pair crosses two."""
    dates = ledger.select("tenant_id", "amount", F.col("txn_date").alias("day")).distinct()
    order = Window.partitionBy("tenant_id", "amount").orderBy("day")
    apart = F.datediff("day", F.lag("day").over(order)) > days
    return dates.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).select("tenant_id", "amount", "day", F.sum("apart").over(order).alias("run"))


class FreeRows:
    """The free rows of one day and direction, by account in the order of their ids. gone: ids that are free no longer."""

    def __init__(self):
        self.accounts: dict[int, deque[str]] = {}
        self.heads: list[tuple[str, int]] = []
        self.gone: set[str] = set()

    def add(self, txn_id: str, account: int) -> None:
        own = self.accounts.setdefault(account, deque())
        own.append(txn_id)
        if len(own) == 1:
            heapq.heappush(self.heads, (txn_id, account))

    def _top(self) -> tuple[str, int] | None:
        """The smallest free id. An account has one entry in the heap, its first row, as long as it has rows."""
        while self.heads and self.heads[0][0] in self.gone:
            _, account = heapq.heappop(self.heads)
            own = self.accounts[account]
            while own and own[0] in self.gone:
                own.popleft()
            if own:
                heapq.heappush(self.heads, (own[0], account))
        return self.heads[0] if self.heads else None

    def first(self, but: int) -> str | None:
        """The smallest free id on another account than this one."""
        top = self._top()
        if top is None or top[1] != but:
            return top and top[0]
        heapq.heappop(self.heads)
        second = self._top()
        heapq.heappush(self.heads, top)
        return second and second[0]


class Sweep:
    """One run of a tenant and amount, its rows given by day and id."""

    def __init__(self, days: int):
        self.days, self.choosers = days, deque()
        self.free: dict[tuple[int, str], FreeRows] = {}

    def add(self, day: int, txn_id: str, account: int, way: str, chooses: bool) -> Iterator[tuple[str, str, int]]:
        yield from self.until(day - self.days)
        self.free.setdefault((day, way), FreeRows()).add(txn_id, account)
        if chooses:
            self.choosers.append((day, txn_id, account, way))

    def until(self, day: float) -> Iterator[tuple[str, str, int]]:
        """The pairs that rows of earlier days take, all rows in reach of them being known."""
        while self.choosers and self.choosers[0][0] < day:
            own_day, txn_id, account, way = self.choosers.popleft()
            if txn_id in self.free[own_day, way].gone:
                continue
            other = DIRECTIONS[1 - DIRECTIONS.index(way)]
            for gap in range(self.days + 1):
                near = [(d, self.free[d, other].first(account)) for d in {own_day - gap, own_day + gap} if (d, other) in self.free]
                found = min(((x, d) for d, x in near if x is not None), default=None)
                if found:
                    self.free[found[1], other].gone.add(found[0])
                    self.free[own_day, way].gone.add(txn_id)
                    yield txn_id, found[0], gap
                    break
        for key in [k for k in self.free if k[0] < day - self.days]:
            del self.free[key]


def _swept(days: int):
    """Of rows sorted by tenant, amount, run, day and id: the pairs, run by run."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sweep = None, Sweep(days)
        for batch in batches:
            made = []
            for tenant, amount, run, day, txn_id, account, way, chooses in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tenant, amount, run) != key:
                    made += [(key, p) for p in sweep.until(inf)]
                    key, sweep = (tenant, amount, run), Sweep(days)
                made += [(key, p) for p in sweep.add(day, txn_id, account, way, chooses)]
            yield _pairs(made)
        yield _pairs([(key, p) for p in sweep.until(inf)])

    return pairs


def _pairs(made: list) -> pa.RecordBatch:
    rows = [(tenant, amount, *pair) for (tenant, amount, _), pair in made]
    types = (pa.int64(), pa.decimal128(18, 2), pa.string(), pa.string(), pa.int32())
    columns = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["tenant_id", "amount", "txn_id", "paired_with", "gap_days"])


def pair_transfers(ledger: DataFrame, days: int = PAIRING_DAYS) -> DataFrame:
    """One row per pair: a transfer and the row of opposite direction and equal amount on another account that it takes, so many
    days apart at most.

    Transfers take their turns by date and id; each takes its nearest free counterpart, of equals the smaller id. Only rows of
    one run of a tenant and amount can compete. Ids are unique in a tenant; rows without a date, an amount, an account or one
    of the two directions pair with nobody.
    """
    rows = ledger.where(F.col("direction").isin(*DIRECTIONS) & F.col("txn_date").isNotNull() & F.col("amount").isNotNull() & F.col("account_id").isNotNull())
    transfer = F.col("movement_type").isin(*TRANSFER_MOVEMENTS)
    rows = rows.join(rows.where(transfer).select("tenant_id", "amount").distinct(), ["tenant_id", "amount"], "left_semi")
    rows = rows.join(runs(rows, days).withColumnRenamed("day", "txn_date"), ["tenant_id", "amount", "txn_date"])
    order = ["tenant_id", "amount", "run", "day", "txn_id"]
    rows = rows.select("tenant_id", "amount", "run", F.unix_date("txn_date").alias("day"), "txn_id", "account_id", "direction", F.coalesce(transfer, F.lit(False)).alias("chooses"))
    return rows.repartition("tenant_id", "amount", "run").sortWithinPartitions(*order).mapInArrow(_swept(days), PAIRS)


def without_paired(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ledger with both sides of each pair no longer counted as spending."""
    sides = pairs.select("tenant_id", "txn_id").unionByName(pairs.select("tenant_id", F.col("paired_with").alias("txn_id"))).distinct()
    marked = ledger.join(sides.withColumn("paired", F.lit(True)), ["tenant_id", "txn_id"], "left")
    return marked.withColumn("is_expense", F.col("is_expense") & F.col("paired").isNull()).drop("paired")
