"""Exact dedup by distributed most-significant-digit radix partitioning.

Each document is the byte string (length, normalised UTF-8 text). A round splits every open group by the next digit, a
run of successive bytes, with a partial aggregation (so a group of copies costs one row per map task) and joins the
groups that still hold several documents back to their rows; Spark splits the row side of that join where one group is
hot. A group that is a singleton or has no bytes left is finished. The digits widen by a factor of eight, so the number
of rounds grows with the logarithm of the longest repeated text. Equality is that of the bytes; no digest decides it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialize

from .text import spaced

#: Bytes of the first digit, and how much wider each next digit is.
FIRST_DIGIT, WIDEN = 64, 8


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per input row: doc_id, keep_id, group_size, kept, text_sha256, and with ``carry`` the whole row as ``row``.

    Texts are equal when identical after each run of white space becomes one space; null counts as empty. The smallest
    id of a group stays (null ids sort last); of rows that repeat id and text exactly one is kept. An empty table gives
    an empty result. Texts of any length are compared whole. Columns other than the two named are ignored, whatever their
    names, or travel inside ``row``.
    """
    norm = spaced(F.col(text_col)).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("bytes"), *([F.struct("*").alias("row")] if carry else []))
    payload = ["row"] if carry else []
    base = base.select(
        "doc_id",
        *payload,
        F.length("bytes").alias("len"),
        F.substring("bytes", 1, FIRST_DIGIT).alias("digit"),
        F.expr(f"substring(bytes, {FIRST_DIGIT + 1})").alias("rest"),
        F.sha2(F.col("bytes"), 256).alias("text_sha256"),
    )
    groups = base.groupBy("len", "digit").agg(F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("len", "digit", F.monotonically_increasing_id().alias("group")), "radix-groups")
    rows = base.join(groups.hint("merge"), ["len", "digit"], "left").select(
        "doc_id",
        "text_sha256",
        *payload,
        "len",
        "group",
        F.when(F.col("group").isNotNull(), F.col("rest")).alias("rest"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = materialize(rows, "radix-rows")
    done = [_finished(rows.where("group is null"), payload, single=True)]
    offset, width = FIRST_DIGIT, FIRST_DIGIT * WIDEN
    open_rows = rows.where("group is not null")
    while True:
        digits = open_rows.withColumn("digit", F.substring("rest", 1, width))
        groups = (
            digits.groupBy("group", "digit")
            .agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("keep"), F.max("len").alias("longest"))
            .where("n > 1")
            .select("group", "digit", "n", "keep", "longest", F.monotonically_increasing_id().alias("next"))
        )
        groups = materialize(groups, "radix-groups")
        offset += width
        joined = digits.join(groups.drop("longest").hint("merge"), ["group", "digit"], "left").withColumn("rest", F.expr(f"case when next is not null then substring(rest, {width + 1}) end"))
        joined = materialize(joined.drop("digit", "group"), "radix-rows")
        done.append(_finished(joined.where("next is null"), payload, single=True))
        done.append(_finished(joined.where(F.col("next").isNotNull() & (F.col("len") <= offset)), payload, single=False))
        if groups.where(F.col("longest") > offset).isEmpty():
            break
        open_rows = joined.where(F.col("next").isNotNull() & (F.col("len") > offset)).drop("n", "keep").withColumnRenamed("next", "group")
        width *= WIDEN
    return reduce(DataFrame.unionByName, done)


def _finished(rows: DataFrame, payload: list[str], single: bool) -> DataFrame:
    """Result columns of rows whose group is decided."""
    if single:
        rest = (F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    else:
        rest = (F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("keep.uid")).alias("kept"))
    return rows.select("doc_id", *rest, "text_sha256", *payload)
