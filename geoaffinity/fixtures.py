"""Views that shape the test tables into the inputs of the operators.

Every view reads whole tables; nothing is made up beside them.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoaffinity.operators.splits import train_interactions
from geoaffinity.runtime import cut, ordered_prefix, spread

DAYS = ("20240102", "20240129")      # valid days of the sighting log
TRAIN = ("19950101", "19991231")
TEST = ("20000201", "20011231")      # January 2000 belongs to neither part


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(number, width: int):
    return F.lpad(number.cast("string"), width, "0")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings: second, user, imei, cell.

    Night events sit near one cell per user, office events near another. The
    device changes twice a month, with a rarer third device in between.
    """
    ts = F.col("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    night = (F.hour(ts) < 8) | (F.hour(ts) >= 20)
    office = (F.weekday(ts) < 5) & F.hour(ts).between(9, 16)
    shift = F.when(night, 0).when(office, 140).otherwise(60)
    half = F.when(k < 88, F.floor((F.dayofmonth(ts) - 1) / 15)).otherwise(F.lit(2).cast("bigint"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.timestamp_diff("SECOND", epoch, ts).alias("second"),
        F.col("user_id").alias("user"),
        F.concat(_padded((F.col("user_id") * 31 + half) % 200, 8),
                 _padded(F.col("event_id"), 7)).alias("imei"),
        F.concat(F.lit("C"), _padded((F.col("user_id") * 13 + shift + k % 4) % 400, 6)).alias("cell"),
    )


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells. Some codes match no sighting, some positions lie
    outside the study area, and suppliers repeat codes with another position."""
    def cells(key, shift):
        code = F.when(key % 40 == 39, "X").otherwise("C")
        lat = F.when(key % 40 == 38, F.lit(33.0)).otherwise(
            F.lit(30.5) + (key % 20) * F.lit(0.002) - F.lit(shift))
        return [F.concat(code, _padded(key, 6)).alias("cell"), lat.alias("lat"),
                (F.lit(120.5) + F.floor(key / 20) * F.lit(0.002)).alias("lng")]

    first = table(spark, sf_dir, "customer").select(*cells(F.col("c_custkey"), 0.0))
    again = table(spark, sf_dir, "supplier").select(*cells(F.col("s_suppkey"), 0.001))
    return first.unionByName(again)


def raw_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 10 == 9, "FeaturePhone").otherwise("SmartPhone")
    return table(spark, sf_dir, "part").select(
        _padded(F.col("p_partkey"), 8).alias("tac"), F.col("p_brand").alias("brand"),
        F.col("p_name").alias("model"), kind.alias("kind"))


def item_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as usage: date, u (customer), item (brand and type of the part)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("u"),
        F.replace(F.col("o_orderdate").cast("date").cast("string"), F.lit("-"), F.lit("")).alias("date"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("#", "p_brand", "p_type").alias("item"))
    return (
        lines.join(parts, F.col("p_partkey") == F.col("l_partkey"))
        .join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .select("date", "u", "item")
    )


def item_catalog(counts: DataFrame) -> DataFrame:
    """item, cnt and d, the 0-based rank by (count descending, item)."""
    totals = counts.groupBy("item").agg(F.sum("cnt").alias("cnt"))
    ranked = ordered_prefix(totals, ["cnt", "item"], [False, True])
    return ranked.select("item", "cnt", F.col("pos").cast("bigint").alias("d"))


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, u, d of every order line."""
    usage = item_usage(spark, sf_dir)
    catalog = item_catalog(usage.groupBy("item").agg(F.count(F.lit(1)).alias("cnt")))
    return usage.join(catalog, "item").select("date", "u", "d")


def interactions(spark: SparkSession, sf_dir: str, folds: int = 1) -> DataFrame:
    """Distinct (fold, u, d) with x = 1, once per fold.

    The order lines are read once: they shrink to (u, item) counts first, and
    both the item numbers and the pairs come from those. The pairs of a user lie together,
    before they are repeated for each fold.
    """
    counts = cut(item_usage(spark, sf_dir).groupBy("u", "item").agg(
        F.count(F.lit(1)).alias("cnt")))
    pairs = train_interactions(spread(counts.join(item_catalog(counts), "item").select("u", "d"), "u"))
    ids = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    return pairs.select(ids, "u", "d", "x")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users with a home and a work position."""
    key = F.col("c_custkey")

    def degrees(base, factor, modulus, name):
        return (F.lit(base) + ((key * factor) % modulus) * F.lit(0.0001)).alias(name)

    return table(spark, sf_dir, "customer").select(
        key.alias("u"),
        degrees(30.5, 7919, 997, "hlat"), degrees(120.5, 104729, 1009, "hlng"),
        degrees(30.5, 1299709, 1013, "wlat"), degrees(120.5, 15485863, 1019, "wlng"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as (id, label, f) with doubles."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("f"))
