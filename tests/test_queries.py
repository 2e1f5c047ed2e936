"""Every registered query that is not of the training-data operators can be analysed over the smallest tables."""

from __future__ import annotations

import os

import pytest

from ledgerloom.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_queries_can_be_analysed(spark):
    failed = {}
    for name, query in QUERIES.items():
        try:
            assert query(spark, SMALL).columns
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
    assert not failed
