"""Exact copies: equal texts once white space is deleted.

DataFrame functions only. Texts are grouped by a 128-bit content hash; a second
pass over the texts of groups with more than one row compares bytes, and a
hash shared by different texts is replaced by the texts themselves.

Only fixed-width digests are shuffled for all rows. Texts move once, for the
byte comparison. Groups are pre-aggregated on the map side, and the way back from
groups to rows broadcasts nothing but hot keys (``skew.join_counted``), so a group
of copies may hold any share of the rows.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut
from .skew import join_counted

SPACE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def group_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                 hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size,
    kept, text_sha256.

    Of equal texts the row with the most code points stays, then the one with the
    smallest id (a null id comes last). Null text is the empty text. Rows equal in id and
    text tie completely: all of them count in group_size and all are marked as kept. Other columns
    of ``docs`` are ignored, whatever their names. An empty table gives an empty table.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    norm = normalised(F.col("text"))
    marks = cut(src.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"),
        hash128(norm).alias("key"), F.sha2(norm, 256).alias("sha"),
    ))
    several = cut(marks.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    members = join_counted(marks, several, ["key"], "rows", "left_semi").select(
        F.col("doc_id").alias("_id")).distinct()
    texts = src.join(members, src["doc_id"].eqNullSafe(members["_id"]), "left_semi").select(
        hash128(norm).alias("key"), norm.alias("norm"))
    # bytes inside a group: all texts are equal if the smallest equals the largest
    mixed = cut(texts.groupBy("key").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
                .where("lo != hi").select("key"))
    if not mixed.isEmpty():
        marks = cut(_split_collisions(src, marks, mixed, hash128, norm))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("last"),
                          F.col("doc_id").alias("id"))).alias("best")
    groups = cut(marks.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), best)
                 .where("rows > 1").select("key", "rows", "best.less", "best.id"))
    size = F.coalesce("rows", F.lit(1)).cast("long")
    out = join_counted(marks, groups, ["key"], "rows")
    keep = F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"),
        (F.col("rows").isNull() | (F.col("doc_id").eqNullSafe(F.col("id"))
                                   & (F.col("less") == -F.col("n")))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def _split_collisions(src: DataFrame, marks: DataFrame, mixed: DataFrame,
                      hash128: Callable[[Column], Column], norm: Column) -> DataFrame:
    """Rows whose hash different texts share are keyed by the text itself."""
    tag = F.concat(F.lit(b"\x01"), norm.cast("binary"))
    clean = marks.join(mixed, "key", "left_anti").withColumn(
        "key", F.concat(F.lit(b"\x00"), F.col("key").cast("binary")))
    again = src.withColumn("key", hash128(norm)).join(mixed, "key", "left_semi").select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"),
        tag.alias("key"), F.sha2(norm, 256).alias("sha"))
    return clean.unionByName(again)
