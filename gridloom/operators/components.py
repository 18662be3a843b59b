"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import discard, materialize

#: Seeds that are tried; with ten million nodes two share a hash in one of some 400,000 tries.
SEEDS = 8


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another node; root is the smallest node of its component.

    Nodes become 64-bit hashes, told apart exactly (another seed is taken if two nodes share one), so that rounds handle
    short rows whose minima are hash aggregates, and in an order without regard to the names. Rounds alternate two joins
    of the edges with each node's smallest neighbour: the large star hangs greater neighbours on the smallest one, the
    small star does so with the smaller ones. The edge count never grows, the number of rounds is logarithmic in
    practice, and the minima are partial aggregates, so a hub costs one row per map task. They are written before they
    are joined: both sides of that join are then plain tables, whose skewed side Spark splits, or of which it broadcasts
    one that it knows to be small. Each round is written to the shared folder, which cuts the lineage, and deleted when
    the next one is there. Null ends and loops are ignored.
    """
    pairs = materialize(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.col(src).alias("a"), F.col(dst).alias("b")), "pairs")
    nodes, seed = _hashed(pairs)
    u, v = F.xxhash64("a", F.lit(seed)), F.xxhash64("b", F.lit(seed))
    stars = pairs.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    for _ in range(max_rounds):
        for star in (_large_star, _small_star):
            hung, least = star(stars)
            done, stars = stars, materialize(hung, "stars")
            discard(done)
            discard(least)
        if _settled(stars):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(pairs)
    # A centre hangs on nothing: its own hash stands for its component. Of the component's nodes the smallest is the root.
    found = nodes.join(stars, F.col("id") == F.col("u"), "left").select("node", F.coalesce("v", "id").alias("part"))
    found = materialize(found, "parts")
    discard(stars)
    roots = materialize(found.groupBy("part").agg(F.min("node").alias("root")), "roots")
    return found.join(roots, "part").select("node", "root")


def _hashed(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(node, id) of every end, and the seed with which no two nodes share a hash."""
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    for seed in range(SEEDS):
        hashed = nodes.withColumn("id", F.xxhash64("node", F.lit(seed)))
        if hashed.groupBy("id").count().where("count > 1").isEmpty():
            return hashed, seed
    raise RuntimeError(f"nodes share hashes with each of {SEEDS} seeds")


def _settled(edges: DataFrame) -> bool:
    """Whether all is stars: every node hangs on one other at most, and none that others hang on does so itself.

    As edges lead to smaller nodes, the centre of a star is the smallest node of its component. This is one partial
    aggregation, where waiting for a round that changes nothing would take another round.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.hangs").alias("n"), F.min("e.hangs").alias("least"))
    return nodes.where("n > 1 or (n = 1 and least = 0)").isEmpty()


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each node, its neighbours that are greater than it are hung on the smallest of its neighbours and itself; and
    the table of those smallest ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    greater = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return greater.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each node, its smaller neighbours and itself are hung on the smallest of them; and the table of those."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least
