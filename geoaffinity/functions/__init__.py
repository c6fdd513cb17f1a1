"""Column expressions shared by the operators (all JVM-side, no Python UDFs)."""

from geoaffinity.functions.geo import (
    EARTH_KM,
    EARTH_M,
    block_size,
    cell_index,
    haversine,
    rms_distance,
)
from geoaffinity.functions.hashing import hash_bits, hash_uniform
from geoaffinity.functions.losses import f1_score, log_loss, logistic, softplus
from geoaffinity.functions.timecols import (
    day_bounds,
    day_of,
    hour_of,
    in_days,
    weekday_of,
)
from geoaffinity.functions.vectors import (
    axpy,
    div_safe,
    dot,
    norm,
    norm2,
    normalise,
    random_unit_vector,
    scale,
    sum_vectors,
)

__all__ = [
    "EARTH_KM", "EARTH_M", "block_size", "cell_index", "haversine", "rms_distance",
    "hash_bits", "hash_uniform", "f1_score", "log_loss", "logistic", "softplus",
    "day_bounds", "day_of", "hour_of", "in_days", "weekday_of",
    "axpy", "div_safe", "dot", "norm", "norm2", "normalise", "random_unit_vector",
    "scale", "sum_vectors",
]
