"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document gets an exponential key, -ln(u) / weight, with u from a hash of its id and text and weight from the quality
of its text; the smallest keys of a source are a weighted sample without replacement. A source whose target is above its size
gives complete epochs first; the rest is filled in key order up to the token budget. The cut in key order is found
without sorting a source in one task: sums over 4096 key buckets, then over 4096 finer ones in the bucket that holds the
cut, leave only that finer bucket to be sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.session import materialize

from .text import SPACE

#: Weights of sources in order, tokens of the mix as a share of all, most epochs of a source, key buckets of a level.
WEIGHTS, SHARE, EPOCHS, BUCKETS = (3.0, 1.0, 2.0), 1.5, 2, 4096
#: Characters that count against a text's quality, and how much.
NOISE, PENALTY = "0123456789#*$%&|<>{}[]_=~^@", 20.0
#: Distinguishes independent samples.
SEED = 7


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int = SEED) -> dict[str, Column]:
    """Expressions over ``docs``: words of the text, key of the sample, its bucket, and the tie-break among equal keys."""
    text = F.coalesce(docs[text_col], F.lit(""))
    name = F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    noise = F.length(text) - F.length(F.translate(text, NOISE, ""))
    weight = 1 / (1 + PENALTY * noise / F.greatest(F.length(text), F.lit(1)))
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    key = -F.ln(uniform) / weight
    return {
        "_source": docs[source_col],
        "_size": F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long"),
        "_key": key,
        "_bucket": F.floor(key / (1 + key) * (BUCKETS * BUCKETS)).cast("long"),
        "_tie": name,
    }


def source_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per source of ``rows`` (the columns of ``sized``): _source, source_size, target, epochs, and where its sample ends.

    Sources are ordered by code point, null last. Targets are water-filled: with caps of EPOCHS times the size, the level
    that spends the whole budget is the largest of (budget - caps below) / (weights from here on) in order of cap/weight.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    sources = rows.groupBy("_source").agg(F.sum("_size").alias("source_size")).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("_source").asc_nulls_last())
    caps = F.coalesce(F.sum(F.col("source_size") * EPOCHS).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = ((F.sum("source_size").over(everything) * share) - caps) / left
    sources = sources.withColumn("level", level).withColumn("target", F.least((F.col("source_size") * EPOCHS).cast("double"), F.max("level").over(everything) * F.col("w")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(sources.select("_source", "source_size", "target", "epochs", "rest"), "mix-targets")

    cut = plan.where("rest > 0").select("_source", "rest", F.lit(0).cast("double").alias("start"), F.lit(0).cast("long").alias("at"))
    for width in (BUCKETS, 1):
        inside = _with_source(rows, cut).where(F.floor(F.col("_bucket") / (width * BUCKETS)) == F.col("at"))
        sums = inside.groupBy("_source", F.floor(F.col("_bucket") / width).alias("at")).agg(F.sum("_size").alias("n"), F.first("rest").alias("rest"), F.first("start").alias("start"))
        upto = F.col("start") + F.sum("n").over(Window.partitionBy("_source").orderBy("at"))
        cut = sums.withColumn("upto", upto).where("upto >= rest and upto - n < rest").select("_source", "rest", (F.col("upto") - F.col("n")).alias("start"), "at")
        cut = materialize(cut, "mix-cuts")

    # Rows that share a key are one row from here on, so an id that repeats without end does not fill a task. Of the
    # group at the cut as many are taken as come nearest to the target: the i-th one if 2 (rest - words before it) >= size.
    last = _with_source(rows, cut).where("_bucket = at").groupBy("_source", "_key", "_tie").agg(F.sum("_size").alias("together"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    in_order = Window.partitionBy("_source").orderBy("_key", "_tie")
    last = last.withColumn("left", F.col("rest") - (F.col("start") + F.sum("together").over(in_order) - F.col("together")))
    size = F.col("together") / F.col("n")
    last = last.withColumn("take", F.when(F.col("together") == 0, F.when(F.col("left") >= 0, F.col("n")).otherwise(0)).otherwise(F.least("n", F.floor(F.col("left") / size + 0.5).cast("long"))))
    ends = last.where("take > 0").groupBy("_source").agg(F.max(F.struct("_key", "_tie", "take", "n")).alias("end"))
    keyed = cut.select(F.col("_source").alias("s"), F.col("at").alias("cut"))
    out = plan.join(keyed, plan["_source"].eqNullSafe(keyed["s"]), "left").drop("s")
    ends = ends.withColumnRenamed("_source", "s")
    out = out.join(ends, out["_source"].eqNullSafe(ends["s"]), "left").select("_source", "source_size", "target", "epochs", "cut", F.col("end._key").alias("end_key"), F.col("end._tie").alias("end_tie"), F.col("end.take").alias("end_take"), F.col("end.n").alias("end_rows"))
    return materialize(out, "mix-plan")


def _with_source(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Rows with the columns of their source; the table of sources is broadcast where Spark finds it small."""
    small = small.withColumnRenamed("_source", "_s")
    return rows.join(small, rows["_source"].eqNullSafe(small["_s"])).drop("_s")


def _counted(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with the columns of their source's plan and ``copies``.

    Where a part of a group of equal rows is taken, these rows are written, numbered by their place in that table, and cut
    there: by counts of its parts first, then within one part, so that no task gets the group.
    """
    joined = _with_source(rows, plan)
    at_end = F.coalesce((F.col("_key") == F.col("end_key")) & (F.col("_tie") == F.col("end_tie")), F.lit(False))
    before = (F.col("_key") < F.col("end_key")) | ((F.col("_key") == F.col("end_key")) & (F.col("_tie") < F.col("end_tie")))
    sampled = (F.col("_bucket") < F.col("cut")) | ((F.col("_bucket") == F.col("cut")) & F.coalesce(before | at_end, F.lit(False)))
    copies = (F.col("epochs") + F.coalesce(sampled, F.lit(False)).cast("long")).alias("copies")
    if plan.where("end_take < end_rows").isEmpty():
        return joined.select("*", copies)
    parted = at_end & (F.col("end_take") < F.col("end_rows"))
    edge = materialize(joined.where(parted).withColumn("_place", F.monotonically_increasing_id()), "mix-edge").withColumn("_part", F.shiftright("_place", 33))
    sizes = edge.groupBy("_source", "_part").agg(F.count("*").alias("_n"), F.first("end_take").alias("_take"))
    upto = F.sum("_n").over(Window.partitionBy("_source").orderBy("_part"))
    parts = materialize(sizes.withColumn("_left", F.col("_take") - upto + F.col("_n")).select("_source", "_part", "_n", "_left"), "mix-parts")
    cut = parts.where("_left > 0 and _left < _n").withColumnsRenamed({"_source": "s", "_part": "p"})
    rank = F.row_number().over(Window.partitionBy("_source").orderBy("_place"))
    inside = edge.join(cut, edge["_source"].eqNullSafe(cut["s"]) & (edge["_part"] == cut["p"])).withColumn("_rank", rank).where(F.col("_rank") == F.col("_left"))
    ends = inside.select("s", "p", F.col("_place").alias("last"))
    known = parts.withColumnsRenamed({"_source": "ps", "_part": "pp"}).join(ends, F.col("ps").eqNullSafe(F.col("s")) & (F.col("pp") == F.col("p")), "left").select("ps", "pp", "_n", "_left", "last")
    taken = (F.col("_left") >= F.col("_n")) | F.coalesce(F.col("_place") <= F.col("last"), F.lit(False))
    edge = edge.join(known, edge["_source"].eqNullSafe(known["ps"]) & (edge["_part"] == known["pp"]))
    return joined.where(~parted).select("*", copies).unionByName(edge.select(*joined.columns, (F.col("epochs") + taken.cast("long")).alias("copies")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Per input row: doc_id, size, source_size, target, taken (words, repeats counted), copies.

    Size is the number of words (null text: 0); a null source is a source of its own. Documents are taken whole, 0 to
    EPOCHS times; the document at the cut is taken if that brings the source nearer to its target. Rows that repeat an
    id and text in a source share a key; at the cut as many of them are taken as come nearest, whichever. Whole texts are counted, however long. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    rows = materialize(docs.select(docs[id_col].alias("doc_id"), *[c.alias(n) for n, c in sized(docs, id_col, text_col, source_col, seed).items()]), "mix-rows")
    return _counted(rows, source_plan(rows)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as often as the mix takes it."""
    rows = materialize(docs.select(*[c.alias(n) for n, c in sized(docs, id_col, text_col, source_col, seed).items()]), "mix-rows")
    whole = docs.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in sized(docs, id_col, text_col, source_col, seed).items()])
    taken = _counted(whole, source_plan(rows)).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
