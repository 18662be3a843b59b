"""What reviews found: results on tables that the others do not hold, and work that must not grow beyond its input."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("quantity", [40.0, 4000.0])
def test_distances_without_background(spark, tmp_path, quantity):
    """Where no cell is background, the SQL has no rows (the cells of the table at scale 0.1 are like that); where some
    are missing, distances still pass through the gaps."""
    folder = str(tmp_path)
    spark.range(64).select(
        F.col("id").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), (F.col("id") % 2 + 1).cast("int").alias("l_linenumber"), F.when(F.col("id") % 16 == 3, F.lit(quantity)).otherwise(4000.0).alias("l_quantity")
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["n20_distance_transform"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["n20_distance_transform"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and bool(want) == (quantity < 96)


def test_common_words_are_encoded_once(monkeypatch):
    """Each batch brings rare words enough to fill the cache; the common one must not go to the tokenizer again."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from gridloom.llm import token_files

    monkeypatch.setattr(token_files, "CACHE_BYTES", 20_000)
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    own, seen = token_files.ChunkEncoder(library), []
    encoded = own.chunks._encoded
    monkeypatch.setattr(own.chunks, "_encoded", lambda chunks: seen.extend(chunks) or encoded(chunks))
    for i in range(40):
        texts = [f"one common word {i} " + " ".join(f"rare{i}x{k}" for k in range(20)) + " common common"] * 2
        kind = own.dtype
        assert own.encode(texts) == [np.array(e.ids, kind).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert seen.count("common") == 1 and len(seen) == len(set(seen))


def test_particles_meet_a_small_field_without_a_shuffle(spark):
    """The field's source may be large: only what is left of it counts."""
    from gridloom.operators import particles

    source = spark.range(3_000_000).select((F.col("id") % 8).cast("int").alias("x"), (F.col("id") % 3).cast("int").alias("y"), F.lit(0).alias("z"), F.col("id").cast("double").alias("v"))
    source = source.withColumn("pad", F.repeat(F.lit("x"), 100)).repartition(4)
    field = source.groupBy("x", "y", "z").agg((F.sum("v") + F.sum(F.length("pad"))).alias("v"))
    points = spark.range(50).select("id", (F.col("id") % 8).cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.9).alias("h"))
    plan = particles.from_cells(points, field, ["v"], "id", "h")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_components_of_named_nodes_are_found_on_hashes(spark, monkeypatch):
    """Rounds see short rows, whose minima need no sorting, and give the smallest name of each component."""
    from gridloom.operators import components

    plans, large_star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda stars: plans.append((stars.dtypes, stars.groupBy("u").agg(F.min("v"))._jdf.queryExecution().sparkPlan().toString())) or large_star(stars))
    edges = spark.createDataFrame([(f"c{i}", f"s{i % 7 // 2}") for i in range(60)], "src string, dst string")
    got = {tuple(r) for r in components.connected_components(edges).collect()}
    least = {}
    for i in range(60):
        least[i % 7 // 2] = min(least.get(i % 7 // 2, "t"), f"c{i}")
    assert got == {(n, least[i % 7 // 2]) for i in range(60) for n in (f"c{i}", f"s{i % 7 // 2}")}
    assert plans and all(types == [("u", "bigint"), ("v", "bigint")] and "SortAggregate" not in plan for types, plan in plans)


def test_only_chains_are_grouped(spark, monkeypatch):
    """Edges that nothing joins pass as they are; chains, loops and rings keep their results."""
    from gridloom.operators import graph

    written = {}
    materialize = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name="table": written.setdefault(name, materialize(df, name)))
    pairs = [("hub", f"leaf{i}") for i in range(50)] + [("hub", "p"), ("p", "q"), ("q", "end"), ("x", "x"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    edges = spark.createDataFrame([(i, a, b, 1.0) for i, (a, b) in enumerate(pairs)], "edge_id long, src string, dst string, length double")
    got = sorted(map(tuple, graph.contract_paths(edges).collect()), key=str)
    want = [(*sorted(p), 1.0, 1) for p in pairs[:50]] + [("end", "hub", 3.0, 3), (None, None, 1.0, 1), (None, None, 3.0, 3)]
    assert got == sorted(want, key=str)
    assert written["chained"].count() == 6
