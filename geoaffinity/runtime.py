"""Helpers that keep work distributed: lineage cuts, ordered numbering,
bounded chunks of large groups and salted joins.
"""

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

CHUNK = 256  # longest list that one row of a chunked group may hold


def stable_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, from ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a temporary folder: on a
    cluster a machine-local path would be lost together with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster is a cluster
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="geoaffinity-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{stable_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    The table survives lost executors and ends the lineage. Unlike an opaque
    checkpoint it has columns to prune and a measured size, by which the planner
    decides whether a later join may broadcast it.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``cut`` into buckets by a hash of ``key``: two such tables with equally many buckets are joined on it without
    another shuffle. Rows of one task with the same key follow one another."""
    spark, path, name = df.sparkSession, scratch_path(df.sparkSession, "cut"), f"cut_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay until ``discard``
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by ``keys`` into the session's number of shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if "/cut-" in folder:
                path = hadoop.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ordered_prefix(df: DataFrame, order: Sequence[str], ascending: Sequence[bool] | None = None,
                   value: str | None = None) -> DataFrame:
    """Add ``pos`` (0-based rank in a total order) and, with ``value``, its
    running sum ``prefix`` including the row itself.

    A global window would pull everything into one task. Here the rows are
    range-partitioned, numbered inside each range, and shifted by the totals of
    the ranges before it; only one row per range meets in a single task. The
    ranges are written out before they are read twice. Adaptive execution may
    merge neighbouring small ranges, which keeps their order.
    """
    ascending = ascending or [True] * len(order)
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in zip(order, ascending)]
    ranged = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_range", F.spark_partition_id())
    )
    amount = F.col(value) if value else F.lit(0)
    totals = ranged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_s")
    )
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
    )
    inside = W.partitionBy("_range").orderBy(*keys)
    out = (
        ranged.withColumn("_rn", F.row_number().over(inside))
        .withColumn("_cum", F.sum(amount).over(
            inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .join(offsets, "_range")
        .withColumn("pos", F.col("_n0") + F.col("_rn") - 1)
    )
    if value:
        out = out.withColumn("prefix", F.col("_s0") + F.col("_cum"))
    return out.drop("_range", "_rn", "_cum", "_n0", "_s0")


def chunk_of(item: Column, chunks: Column) -> Column:
    """Which of ``chunks`` pieces of its group an item belongs to."""
    return F.pmod(F.xxhash64(item), chunks).cast("int")


def chunk_count(size: Column, chunk: int = CHUNK) -> Column:
    return F.ceil(size / F.lit(chunk)).cast("int")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str],
                hot: int = 20000) -> DataFrame:
    """Inner equi-join for keys that are heavy on both sides.

    Either side of a key with more than ``hot`` rows there is split into pieces, the left rows by a
    hash of all of their columns, the right rows by one of ``salt_by``. Each piece of one side is
    repeated for every piece of the other, so a task meets two bounded pieces and every pair is
    produced exactly once. The join is a sort-merge join on purpose: it multiplies rows, so
    its work has to be spread by key even when one side alone is small enough to broadcast.
    """
    keys = list(keys)

    def pieces(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(
            *keys, chunk_count(F.col("_n"), hot).alias(name))

    cuts = pieces(left, "_pl").join(pieces(right, "_pr"), keys, "full")

    def dealt(df: DataFrame, own: str, other: str, salts: Sequence[str], mine: str, theirs: str) -> DataFrame:
        n, m = (F.coalesce(F.col(c), F.lit(1)) for c in (own, other))
        return df.join(cuts, keys, "left").withColumn(mine, F.pmod(F.xxhash64(*salts), n).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), m - 1))).drop("_pl", "_pr")

    lefts = dealt(left, "_pl", "_pr", left.columns, "_sl", "_sr")
    rights = dealt(right, "_pr", "_pl", salt_by, "_sr", "_sl")
    return lefts.join(rights.hint("merge"), [*keys, "_sl", "_sr"]).drop("_sl", "_sr")
