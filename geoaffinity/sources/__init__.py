"""Readers and writers of the delimited and columnar tables."""

from geoaffinity.sources.tables import (
    TEXT_TABLES,
    device_dimension,
    cell_dimension,
    parse_position,
    position_text,
    quarantined,
    read_cells,
    read_devices,
    read_sightings,
    read_text,
    well_formed,
    write_partitioned,
    write_text,
)

__all__ = [
    "TEXT_TABLES", "device_dimension", "cell_dimension", "parse_position", "position_text",
    "quarantined", "read_cells", "read_devices", "read_sightings", "read_text",
    "well_formed", "write_partitioned", "write_text",
]
