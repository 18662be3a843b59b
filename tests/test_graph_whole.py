"""The graph queries over all edges against plain Python."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs():
    sql = f"SELECT DISTINCT 'c' || o_custkey, 's' || l_suppkey FROM '{DATA}/orders.parquet' JOIN '{DATA}/lineitem.parquet' ON o_orderkey = l_orderkey"
    return set(duckdb.connect().execute(sql).fetchall())


def test_contracted_paths_hold_every_edge(spark, pairs):
    assert catalog.queries()["g04_contract_paths"](spark, DATA).agg(F.sum("edges")).first()[0] == len(pairs)


def test_prune_whole(spark, pairs):
    left = set(pairs)
    while True:
        degree = Counter(n for e in left for n in e)
        kept = {e for e in left if degree[e[0]] > 1 and degree[e[1]] > 1}
        if kept == left:
            break
        left = kept
    assert sorted(map(tuple, catalog.queries()["g01_prune_whole"](spark, DATA).collect())) == sorted(left)


def test_components_whole(spark, pairs):
    up = {n: n for e in pairs for n in e}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in catalog.queries()["g08_connected_components_whole"](spark, DATA).collect()}
    assert got == {n: find(n) for n in up}
