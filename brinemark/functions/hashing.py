"""Short names of depth grids and horizontal domains for staged data."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_depths(depths: Sequence[float]) -> np.ndarray:
    values = np.asarray(depths, np.float64)
    if values.ndim != 1 or not values.size or not np.isfinite(values).all():
        raise ValueError("Depths must be a non-empty list of finite numbers")
    return np.round(values, 3)


def depth_grid_hash(depths: Sequence[float]) -> str:
    """Twelve digits of a hash of the depths in millimetres' precision."""
    return hashlib.sha256(",".join(f"{d:.3f}" for d in rounded_depths(depths)).encode()).hexdigest()[:12]


def depth_grid_variant(depths: Sequence[float]) -> str:
    return f"depths-{len(depths)}-{depth_grid_hash(depths)}"


def depth_grid_hash_column(depths: Column) -> Column:
    """depth_grid_hash of an array column."""
    told = F.transform(depths, lambda d: F.format_string("%.3f", F.round(d, 3)))
    return F.substring(F.sha2(F.concat_ws(",", told), 256), 1, 12)


def domain_variant(latitude: Sequence[float], longitude: Sequence[float]) -> str:
    """A name of a horizontal grid from its coordinates to six decimals."""
    digest = hashlib.sha256()
    sizes = []
    for name, axis in (("latitude", latitude), ("longitude", longitude)):
        values = np.asarray(axis, np.float64).ravel()
        if not values.size or not np.isfinite(values).all():
            raise ValueError(f"The {name} axis must hold finite numbers")
        for part in (name.encode(), str((values.size,)).encode(), np.round(values, 6).astype("<f8").tobytes()):
            digest.update(part)
        sizes.append(values.size)
    return f"domain-{sizes[0]}x{sizes[1]}-{digest.hexdigest()[:12]}"
