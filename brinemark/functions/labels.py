"""Row and column labels of score tables, and their way back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinemark.model import DISPLAY, SSH

# Fixed value: the format of a row label, "Name (unit) [standard name]{depth}".
LABEL = r"^(.*?) \(([^)]+)\) \[([^\]]*)\](?:\{([^}]+)\})?$"
# Old display names and what they are called now.
RENAMES = {
    "height": "sea surface height",
    "surface height": "sea surface height",
    "northward velocity": "meridional current",
    "eastward velocity": "zonal current",
    "northward geostrophic velocity": "meridional geostrophic current",
    "eastward geostrophic velocity": "zonal geostrophic current",
}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def capitalised(c: Column) -> Column:
    """First letter in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def row_label(variable: Column, depth: Column, points: bool = False) -> Column:
    """'Name (unit) [standard name]{depth}'; point tables call the surface height an anomaly."""
    names = {k: ("sea level anomaly" if points and k == SSH else n).capitalize() for k, (n, _) in DISPLAY.items()}
    units = {k: u for k, (_, u) in DISPLAY.items()}
    return F.format_string("%s (%s) [%s]{%s}", literal_map(names)[variable], literal_map(units)[variable], variable, depth)


def lead_day_label(index: int) -> str:
    return f"Lead day {index + 1}"


def lead_day_labels(start: int, stop: int) -> list[str]:
    return [f"Lead day {i}" for i in range(start, stop + 1)]


def lead_day_number(header: Column) -> Column:
    """The digits at a header's end, else the header."""
    digits = F.regexp_extract(header, r"(\d+)$", 1)
    return F.when(digits != "", digits).otherwise(header)


def parsed_label(label: Column) -> dict[str, Column]:
    """display_name, unit, standard_name, depth; a label of another form is a name of unknown standard name."""
    fits = F.regexp_like(label, F.lit(LABEL))
    part = lambda i, other: F.when(fits, F.regexp_extract(label, LABEL, i)).otherwise(other)
    return {"display_name": part(1, label), "unit": part(2, F.lit("")), "standard_name": part(3, F.lit("unknown")), "depth": part(4, F.lit(""))}


def current_display_name(name: Column) -> Column:
    return F.coalesce(literal_map(RENAMES)[F.lower(name)], F.lower(name))


def number_or_null(text: Column) -> Column:
    return text.try_cast("double")
