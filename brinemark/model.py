"""Names, constants and small value types of the verification model."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame

# Standard names of the variables with display name and unit, in the order of grid score tables.
SSH, TEMPERATURE, SALINITY = "sea_surface_height_above_geoid", "sea_water_potential_temperature", "sea_water_salinity"
NORTHWARD, EASTWARD = "northward_sea_water_velocity", "eastward_sea_water_velocity"
MLD = "ocean_mixed_layer_thickness"
GEO_NORTHWARD, GEO_EASTWARD = "geostrophic_northward_sea_water_velocity", "geostrophic_eastward_sea_water_velocity"
DISPLAY = {
    SSH: ("sea surface height", "m"),
    TEMPERATURE: ("temperature", "°C"),
    SALINITY: ("salinity", "PSU"),
    NORTHWARD: ("meridional current", "m/s"),
    EASTWARD: ("zonal current", "m/s"),
    MLD: ("mixed layer depth", "m"),
    GEO_NORTHWARD: ("meridional geostrophic current", "m/s"),
    GEO_EASTWARD: ("zonal geostrophic current", "m/s"),
}
SURFACE_VARIABLES = (SSH, MLD, GEO_NORTHWARD, GEO_EASTWARD)
GRID_VARIABLES = (SSH, TEMPERATURE, SALINITY, NORTHWARD, EASTWARD)
# The short names of variables in files.
NATIVE_NAMES = {"zos": SSH, "thetao": TEMPERATURE, "so": SALINITY, "vo": NORTHWARD, "uo": EASTWARD}

# Score depths in metres with their labels.
SCORE_DEPTHS = {"surface": 0.494025, "50m": 47.37369, "100m": 92.32607, "200m": 222.4752, "300m": 318.1274, "500m": 541.0889}

# Bins of point observations, half open, and the order of bins and variables in their tables.
DEPTH_BINS = {"0-5m": (0, 5), "5-100m": (5, 100), "100-300m": (100, 300), "300-600m": (300, 600)}
BIN_ORDER = ("surface", "0-5m", "5-100m", "100-300m", "300-600m", "15m")
POINT_ORDER = (TEMPERATURE, SALINITY, SSH, EASTWARD, NORTHWARD)

# Scales of the methods.
LEAD_DAYS = 10
SSH_SHIFT = -0.1148
VELOCITY_DEPTH = 15.0
SPLINE_POINTS = 4
MLD_CAP, MLD_THRESHOLD = 600.0, 0.03
OMEGA, EARTH_RADIUS, GRAVITY, CORIOLIS_MIN, EQUATOR = 7.2921e-5, 6371000.0, 9.81, 1e-10, 0.5
PARTICLES, REGIONAL_PARTICLES, PARTICLE_SEED, STEP_HOURS, KM_PER_DEGREE = 10_000, 2_000, 123, 1, 111.0
METRES_PER_DEGREE = 1852.0 * 60.0
FIRST_OBSERVATION = "2024-01-01"


class Resolution(Enum):
    ONE_DEGREE = "one_degree"
    QUARTER_DEGREE = "quarter_degree"
    TWELFTH_DEGREE = "twelfth_degree"


# The steps of the grids in degrees.
SPACING = {Resolution.ONE_DEGREE: 1.0, Resolution.QUARTER_DEGREE: 0.25, Resolution.TWELFTH_DEGREE: 1.0 / 12.0}


@dataclass(frozen=True)
class Axes:
    """Coordinates of a cube; a cell's *_idx counts from 0 along them. They are short, so they live on the driver."""

    latitude: tuple[float, ...]
    longitude: tuple[float, ...]
    depth: tuple[float, ...] = ()

    def resolution(self) -> Resolution:
        """The spacing class of the first steps, within a tenth."""
        steps = abs(self.latitude[1] - self.latitude[0]), abs(self.longitude[1] - self.longitude[0])
        for kind, spacing in SPACING.items():
            if all(abs(s - spacing) <= 1e-8 + 0.1 * spacing for s in steps):
                return kind
        raise ValueError(f"Unknown resolution: steps {steps[0]:.4f} and {steps[1]:.4f} degrees")


@dataclass(frozen=True)
class Source:
    """Where a cube comes from."""

    kind: str
    name: str
    resolution: str | None = None
    variant: str | None = None

    def key(self, lead_days: int) -> str:
        """The name under which it is staged."""
        parts = [self.kind, self.name, *(x for x in (self.resolution, self.variant) if x)]
        return "-".join(parts) + f"-{lead_days}d"


@dataclass(frozen=True)
class Cube:
    """A forecast cube in rows: levels (first_day, lead_day, depth_idx, lat_idx, lon_idx, variables) and
    surface (the same without depth_idx). A missing value is null, or the row is absent."""

    axes: Axes
    levels: DataFrame | None = None
    surface: DataFrame | None = None
    lead_days: int = LEAD_DAYS
    source: Source | None = None
    attributes: dict = field(default_factory=dict)
