"""Mixing, the registered queries and the pipeline."""

import random
import re
from collections import defaultdict

import duckdb
import pytest
from conftest_llm import make_docs, sample_rows
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import mixing, queries

DATA = "/root/testdata/sf0.001"


def targets(sizes, weights):
    """Shares of 150 % by repeated resharing of what exceeds twice a size."""
    total, out, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        level = (total - sum(out[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_) if open_ else 0
        over = {i for i in open_ if level * weights[i] > 2 * sizes[i]}
        if not over:
            return [level * weights[i] if i in open_ else out[i] for i in range(len(sizes))]
        for i in over:
            out[i] = 2.0 * sizes[i]
        open_ -= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", None, "zz"]
    rows = [(i, "w " * rng.randrange(0, 40) + "#" * rng.randrange(3), "en", rng.choices(names, [60, 5, 10, 2, 23])[0]) for i in range(600)]
    got = mixing.mix(make_docs(spark, rows)).collect()
    source = {i: s for i, _, _, s in rows}
    sizes = defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    want = dict(zip(order, targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    again = {(r.doc_id, r.taken) for r in mixing.mix(make_docs(spark, rows).repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_rows_without_ids_reach_their_target(spark):
    """All ids null, one id repeated: rows are told apart by their texts."""
    for own in (None, 7):
        rows = [(own, f"a b c d e {chr(97 + i % 26)}{chr(97 + i // 26)}", "en", "a" if i % 4 else "b") for i in range(600)] + [(own, "same row again", "en", "c")] * 300
        got = mixing.mix(make_docs(spark, rows)).collect()
        for size in (6 * 150, 6 * 450):
            source = [r for r in got if r.source_size == size and r.size == 6]
            assert source and abs(sum(r.taken for r in source) - source[0].target) <= 6
        copies = [r for r in got if r.size == 3]
        assert abs(sum(r.taken for r in copies) - copies[0].target) <= 3


def test_a_group_of_equal_rows_is_taken_in_part(spark):
    """150 equal rows, target 3500 of 3000 words: some of them once more; the rows themselves follow suit."""
    rows = [(5, "word " * 20, "en", "a")] * 150 + [(100 + i, "other words " * 10, "en", "b") for i in range(20)]
    docs = make_docs(spark, rows)
    for given in (docs, docs.repartition(9), docs.coalesce(1)):
        got = mixing.mix(given).collect()
        for source_size in (3000, 400):
            own = [r for r in got if r.source_size == source_size]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 10 and {r.copies for r in own} <= {0, 1, 2}
        out = mixing.mixed_rows(given).groupBy("doc_id").count().collect()
        assert {r.doc_id: r["count"] for r in out}[5] * 20 == sum(r.taken for r in got if r.doc_id == 5)
    target = next(r.target for r in got if r.source_size == 3000)
    assert 3000 < target < 6000


def test_mixed_rows(spark, docs, no_docs):
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    per_id = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    rows = defaultdict(int)
    for i, *_ in sample_rows():
        rows[i] += 1
    assert per_id == {i: copies[i] * n for i, n in rows.items() if copies[i]}
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


def test_quality_moves_keys(spark):
    """Of two texts of equal length the noisy one is taken less often."""
    rows = [(i, ("good words only here " if i % 2 else "#### #### #### ####  ") * 3, "en", "a" if i < 2000 else "b") for i in range(2400)]
    got = mixing.mix(make_docs(spark, rows)).where("doc_id < 2000 or doc_id >= 2000").collect()
    good = sum(r.copies for r in got if r.doc_id % 2)
    assert good > sum(r.copies for r in got if not r.doc_id % 2)


def test_every_operator_is_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.queries() if n.startswith("op")} == {str(i) for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(str, cursor.fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    frames = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frames
        frames = stage(spark, frames, DATA)
        assert frames.columns == docs.columns, name
        if name != "mixing":
            assert frames.exceptAll(before).count() == 0
    out = corpus_pipeline.run(spark, DATA)
    assert out.where("not round_trip").count() == 0 and {r.doc_id for r in out.select("doc_id").collect()} <= ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "byte_bpe"]
