"""Hand-made borders of the log operators."""

import pytest
from pyspark.sql import functions as F

from geoaffinity import functions as fn
from geoaffinity import sources
from geoaffinity.operators import catalog, splits, usage
from geoaffinity.runtime import ordered_prefix, salted_join

HOUR, DAY = 3600, 86400
MONDAY = 1704067200  # 2024-01-01 00:00 UTC


def context(spark, rows):
    df = spark.createDataFrame(rows, "second long")
    return df.select("second", fn.hour_of(F.col("second")).alias("hour"),
                     fn.weekday_of(F.col("second")).alias("wday"))


def test_home_and_work_hours(spark):
    seconds = [(MONDAY + d * DAY + h * HOUR + 1800,) for d in (0, 5) for h in range(24)]
    ctx = context(spark, seconds)
    home = {(r.wday, r.hour) for r in usage.home_sightings(ctx).collect()}
    work = {(r.wday, r.hour) for r in usage.work_sightings(ctx).collect()}
    night = {*range(8), *range(20, 24)}
    assert home == {(d, h) for d in (0, 5) for h in night}
    assert work == {(0, h) for h in range(9, 17)}
    both = usage.place_sightings(ctx).groupBy("place_type").count().collect()
    assert {r.place_type: r["count"] for r in both} == {"home": 24, "work": 8}


def test_zone_shifts_hour_and_day(spark):
    row = spark.createDataFrame([(MONDAY + 20 * HOUR,)], "s long").select(
        fn.hour_of(F.col("s"), "Asia/Shanghai").alias("h"),
        fn.day_of(F.col("s"), "Asia/Shanghai").alias("d"),
        fn.weekday_of(F.col("s"), "Asia/Shanghai").alias("w"),
        fn.in_days(F.col("s"), "20240102", "20240102", "Asia/Shanghai").alias("i")).first()
    assert (row.h, row.d, row.w, row.i) == (4, "20240102", 1, True)


def days_of(spark, text):
    rows = [("u", i, d) for i, d in enumerate(text)]
    return spark.createDataFrame(rows, "user string, btime long, device string")


@pytest.mark.parametrize("days,expected", [
    ("ABAB", "AB"), ("ABA", "A"), ("AABB", "AB"), ("ABCBA", "ABA"), ("A", "A"), ("AB", "AB"),
    ("ABBA", "ABA"), ("ABCABC", "ABCABC"),
])
def test_history_fold(spark, days, expected):
    def plain(text):
        kept = []
        for x in text:
            if len(kept) > 1 and kept[-2] == x and kept[-1] != x:
                kept.pop()
            kept.append(x)
        return [x for i, x in enumerate(kept) if i == 0 or kept[i - 1] != x]

    rows = usage.device_history(days_of(spark, days)).orderBy("seq").collect()
    got = "".join(r.device for r in rows)
    assert got == "".join(plain(days)) == expected
    assert {r.runs for r in rows} == {len(expected)}


def test_usage_runs_keeps_blips(spark):
    rows = usage.usage_runs(days_of(spark, "AABAAC")).orderBy("btime").collect()
    assert "".join(r.device for r in rows) == "ABAC"


def test_daily_device_ties(spark):
    rows = [("u", "d1", "B", 5), ("u", "d1", "A", 9), ("u", "d2", "B", 7), ("u", "d2", "A", 7),
            ("u", "d3", "B", 1), ("u", "d3", "A", 2), ("u", "d3", "A", 3)]
    df = spark.createDataFrame(rows, "user string, day string, device string, second long")
    got = {r.day: (r.device, r.btime, r.n) for r in usage.device_days(df).collect()}
    assert got == {"d1": ("B", 5, 1), "d2": ("A", 7, 1), "d3": ("A", 2, 2)}


def test_runs_limit(spark):
    rows = [(u, i, d, n) for u, n in (("four", 4), ("five", 5)) for i, d in enumerate("ABABA"[:n])]
    df = spark.createDataFrame(rows, "user string, btime long, device string, runs int")
    assert {r.user for r in catalog.normal_usage(df).collect()} == {"four"}
    assert [r.user for r in catalog.abnormal_users(df).collect()] == ["five"]


@pytest.mark.parametrize("rate,expected", [(0.5, ["a"]), (0.85, ["a", "b"]), (1.0, ["a", "b", "c"]),
                                           (0.4, [])])
def test_coverage_cut(spark, rate, expected):
    rows = [("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2
    df = spark.createDataFrame(rows, "device string")
    got = catalog.coverage_devices(df, rate).orderBy("d").collect()
    assert [r.device for r in got] == expected
    assert [r.d for r in got] == list(range(len(expected)))


def test_gap_rows_belong_nowhere(spark):
    rows = [("20161023",), ("20170124",), ("20170125",), ("20170131",), ("20170201",), ("20170216",)]
    got = splits.time_split(spark.createDataFrame(rows, "date string")).collect()
    assert {r.date: r.part for r in got} == {
        "20161023": "train", "20170124": "train", "20170201": "test"}


def test_ordered_prefix_is_a_global_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"),
                                  (F.col("id") % 5).alias("v"))
    rows = ordered_prefix(df, ["k"], [False], value="v").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1000))
    assert [r.k for r in rows] == list(range(999, -1, -1))
    total = 0
    for r in rows:
        total += r.v
        assert r.prefix == total


def test_salted_join_keeps_every_pair(spark):
    left = spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") < 290, 0).otherwise(1).alias("k"),
                                    F.col("id").alias("b"))
    got = salted_join(left, right, ["k"], ["b"], hot=50)
    want = left.join(right, "k")
    assert got.count() == want.count() == got.distinct().count()
    assert got.exceptAll(want.select(*got.columns)).isEmpty()


def test_text_round_trip_and_quarantine(spark, tmp_path):
    path = str(tmp_path / "log")
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part-0").write_text("5|u1|123456789|c1\nnonsense\nx|u2|1|c\n6|u2|9|c2\n")
    scan = sources.read_text(spark, "sightings", path)
    assert {(r.second, r.user) for r in sources.well_formed(scan).collect()} == {(5, "u1"), (6, "u2")}
    assert {r._corrupt_record for r in sources.quarantined(scan).collect()} == {"nonsense", "x|u2|1|c"}
    assert {r.shard for r in sources.read_sightings(spark, path).collect()} == {"part-0"}
    edges = spark.createDataFrame([("a", "b", 0.25)], "src string, dst string, score double")
    out = str(tmp_path / "edges")
    sources.write_text(edges, "scored_edges", out)
    back = sources.well_formed(sources.read_text(spark, "scored_edges", out)).drop("shard")
    assert back.collect() == edges.collect()


def test_position_text(spark):
    df = spark.createDataFrame([(30.5, 120.25)], "lat double, lng double")
    text = df.select(sources.position_text("lat", "lng").alias("t"))
    assert text.first().t == "30.500000#120.250000"
    assert tuple(text.select(*sources.parse_position("t", ["a", "b"])).first()) == (30.5, 120.25)


def test_dimension_readers(spark, tmp_path):
    (tmp_path / "cells").write_text("c1,30.0,120.0,x\nc1,31.0,119.0,y\nc2,1.5,2.5,z\n")
    (tmp_path / "devices").write_text("0|t1|b|m|x|y|SmartPhone\n0|t2|b|n|x|y|Modem\n")
    cells = {r.cell: (r.lat, r.lng) for r in sources.read_cells(spark, str(tmp_path / "cells")).collect()}
    assert cells == {"c1": (31.0, 119.0), "c2": (1.5, 2.5)}
    assert [tuple(r) for r in sources.read_devices(spark, str(tmp_path / "devices")).collect()] == [
        ("t1", "b#m")]


def test_dimension_readers_quarantine(spark, tmp_path):
    """A malformed latitude is no cell; extra columns are ignored."""
    (tmp_path / "cells.csv").write_text("C1,30.5,120.5,extra,more\nC2,north,120.5\nC3,30.6\nC1,30.4,120.4\n,30.1,120.1\n")
    got = {r.cell: (r.lat, r.lng) for r in sources.read_cells(spark, str(tmp_path / "cells.csv")).collect()}
    assert got == {"C1": (30.5, 120.5)}
    (tmp_path / "devices.csv").write_text("0|11111111|B|M|x|y|SmartPhone|z\n0|22222222|B|N|x|y|Phone\n0|3333\n")
    assert [tuple(r) for r in sources.read_devices(spark, str(tmp_path / "devices.csv")).collect()] == [("11111111", "B#M")]


def test_hours_reach_the_places(spark):
    context = spark.createDataFrame([(1, h, 2) for h in range(24)], "user long, hour long, wday long")
    kinds = usage.place_sightings(context, night=(10, 22), office=(9, 11)).groupBy("place_type").count()
    assert {r.place_type: r["count"] for r in kinds.collect()} == {"home": 12, "work": 3}


def test_pruned_scan_lists_only_its_days(spark, tmp_path):
    days = spark.range(20).select("id", (F.col("id") % 5).cast("string").alias("day"))
    sources.write_partitioned(days, str(tmp_path / "v"), "day")
    part = spark.read.schema(days.schema).parquet(str(tmp_path / "v")).where("day between '1' and '2'")
    assert part.count() == 8
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
