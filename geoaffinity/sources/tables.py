"""Fixed schemas, delimited-text scans with a quarantine column, and sinks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BAD = "_corrupt_record"

# Delimiter and columns of each text table.
TEXT_TABLES = {
    "sightings": ("|", "second BIGINT, user STRING, imei STRING, cell STRING"),
    "valid_sightings": ("|", "second BIGINT, user STRING, tac STRING, cell STRING"),
    "cells": (",", "cell STRING, lat DOUBLE, lng DOUBLE"),
    "devices": ("|", "_0 STRING, tac STRING, brand STRING, model STRING, _4 STRING, _5 STRING, kind STRING"),
    "position_counts": (",", "user STRING, position STRING, cnt BIGINT"),
    "device_history": ("|", "user STRING, btime BIGINT, device STRING"),
    "numbered_devices": (",", "device STRING, d INT"),
    "numbered_users": (",", "user STRING, u INT"),
    "numbered_usage": ("|", "date STRING, u INT, d INT"),
    "semantic_places": ("|", "user STRING, position STRING"),
    "numbered_places": ("|", "u INT, positions STRING"),
    "scored_edges": (",", "src STRING, dst STRING, score DOUBLE"),
    "distance_edges": ("|", "src INT, dst INT, dist_km DOUBLE"),
    "histogram": (",", "value BIGINT, cnt BIGINT"),
}


def read_text(spark: SparkSession, table: str, path: str | Sequence[str]) -> DataFrame:
    """Scan one of ``TEXT_TABLES``. ``path`` may be a glob or several paths.

    A row that does not parse keeps its text in ``_corrupt_record`` instead of
    failing the job; ``shard`` names the file it came from.
    """
    return parse_lines(read_lines(spark, path), table, F.col("line"))


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path if isinstance(path, str) else list(path)).select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("shard"))


def parse_lines(lines: DataFrame, table: str, text: Column) -> DataFrame:
    """Parsed line by line, so that a row is judged by all of its columns even when a query
    reads only some of them."""
    sep, schema = TEXT_TABLES[table]
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return lines.select(
        F.from_csv(text, f"{schema}, {BAD} STRING", options).alias("row"), "shard"
    ).select("row.*", "shard")


def well_formed(scan: DataFrame) -> DataFrame:
    return scan.where(F.col(BAD).isNull()).drop(BAD)


def quarantined(scan: DataFrame) -> DataFrame:
    return scan.where(F.col(BAD).isNotNull()).select("shard", BAD)


def read_sightings(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Well-formed raw sightings of all shards: second, user, imei, cell, shard."""
    return well_formed(read_text(spark, "sightings", path))


def cell_dimension(raw: DataFrame) -> DataFrame:
    """One position per cell; of several entries the largest (lat, lng) is kept."""
    best = F.max(F.struct("lat", "lng")).alias("p")
    return raw.groupBy("cell").agg(best).select("cell", "p.lat", "p.lng")


def device_dimension(raw: DataFrame, kind: str = "smartphone") -> DataFrame:
    """Device code to ``brand#model`` for one kind of device, any letter case."""
    return (
        raw.where(F.lower("kind") == kind.lower())
        .groupBy("tac")
        .agg(F.max(F.concat_ws("#", "brand", "model")).alias("device"))
    )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Comma text whose first three columns are cell, lat, lng; more columns are ignored. Rows that do not
    parse, or lack a cell or a position, stay out of the dimension (``quarantined(read_text(...))`` shows them)."""
    first = F.array_join(F.slice(F.split("line", ","), 1, 3), ",")
    rows = parse_lines(read_lines(spark, path), "cells", first)
    return cell_dimension(well_formed(rows).dropna(subset=["cell", "lat", "lng"]))


def read_devices(spark: SparkSession, path: str, kind: str = "smartphone") -> DataFrame:
    """Pipe text: columns 1, 2, 3 are code, brand, model and column 6 the kind."""
    rows = parse_lines(read_lines(spark, path), "devices", F.array_join(F.slice(F.split("line", r"\|"), 1, 7), "|"))
    raw = well_formed(rows).dropna(subset=["tac", "kind"])
    return device_dimension(raw.select("tac", "brand", "model", "kind"), kind)


def position_text(*degrees: Column | str) -> Column:
    """``lat#lng`` (or a longer list) with six decimals, for text sinks."""
    columns = [F.col(c) if isinstance(c, str) else c for c in degrees]
    return F.format_string("#".join(["%f"] * len(columns)), *columns)


def parse_position(text: Column | str, names: Sequence[str]) -> list[Column]:
    """The numbers of a ``#``-joined position, as columns called ``names``."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, "#")
    return [F.get(parts, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Parquet sink; partition columns become folders that later scans can skip."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_text(df: DataFrame, table: str, path: str, mode: str = "errorifexists") -> None:
    """Delimited sink in the column order of ``TEXT_TABLES``, written by the tasks."""
    sep, schema = TEXT_TABLES[table]
    columns = [part.split()[0] for part in schema.split(", ")]
    df.select(*columns).write.mode(mode).option("sep", sep).csv(path)
