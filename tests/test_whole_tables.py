"""Queries that give back every key and every slice."""

from pyspark.sql import functions as F

from gridloom import catalog

DATA = "/root/testdata/sf0.001"


def test_merge_and_volume_are_whole(spark):
    merged = catalog.queries()["j12_plot_merge_whole"](spark, DATA)
    assert merged.agg(F.sum("n"), F.sum("n_2")).first() == (spark.read.parquet(f"{DATA}/orders.parquet").count(), spark.read.parquet(f"{DATA}/lineitem.parquet").count())
    assert catalog.queries()["s01_volume_url_whole"](spark, DATA).select("z").distinct().count() == 7
