"""The volume hash sees every cell."""

from pyspark.sql import functions as F

from gridloom.operators import reductions


def test_hash_of_later_slices(spark):
    cells = spark.range(60).selectExpr("cast(id % 5 as int) x", "cast(id div 5 % 4 as int) y", "cast(id div 20 as int) z", "id v")
    text = F.concat_ws(":", "x", "y", "z", "v")
    hashes = [reductions.volume_hash(df, text, fanout=2).first().hash for df in (cells, cells.repartition(7), cells.withColumn("v", F.when(F.col("z") == 2, -F.col("v")).otherwise(F.col("v"))))]
    assert hashes[0] == hashes[1] != hashes[2]
