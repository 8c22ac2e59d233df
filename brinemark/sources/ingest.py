"""From stored tables to the rows of a cube: names, missing values, lead days, duplicate coordinates, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinemark.model import NATIVE_NAMES

CELL = ("first_day", "lead_day", "depth_idx", "lat_idx", "lon_idx")


def standard_names(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Variables under their standard names: by names, by the columns' stored attribute, then by the usual short ones."""
    stored = {f.name: f.metadata["standard_name"] for f in df.schema.fields if "standard_name" in (f.metadata or {})}
    mapping = {k: v for k, v in (NATIVE_NAMES | stored | (names or {})).items() if k in df.columns}
    return df.withColumnsRenamed(mapping)


def standard_column(df: DataFrame, standard_name: str) -> str:
    """The column of a standard name: by name, else the only one with the attribute."""
    if standard_name in df.columns:
        return standard_name
    found = [f.name for f in df.schema.fields if (f.metadata or {}).get("standard_name") == standard_name]
    if len(found) != 1:
        raise ValueError(f"No unique column with the standard name {standard_name!r}")
    return found[0]


def nulls_for_nans(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Doubles with null in place of NaN, so that every later mean and comparison leaves them out."""
    kinds = dict(df.dtypes)
    chosen = columns or [c for c, k in kinds.items() if k in ("float", "double")]
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in chosen})


def renumbered(df: DataFrame, days: int | None = None, time: str = "time", keys: tuple[str, ...] = ("first_day",)) -> DataFrame:
    """time as lead_day, 0, 1, … in the order of times within each forecast, at most so many days.

    The distinct times of a forecast are few; they are numbered on their own and joined back, so cells aren't sorted.
    """
    times = df.select(*keys, time).distinct()
    numbered = times.withColumn("lead_day", (F.row_number().over(W.partitionBy(*keys).orderBy(time)) - 1).cast("int"))
    if days is not None:
        numbered = numbered.where(F.col("lead_day") < days)
    return df.join(numbered, [*keys, time]).drop(time)


def weeks_of_series(series: DataFrame, starts: DataFrame, days: int, time: str = "time") -> DataFrame:
    """A reference series cut into forecasts: for each start the next days times from it on, as first_day and lead_day."""
    listed = starts.select("first_day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("lead_day")).withColumn("_day", F.expr("date_add(first_day, lead_day)"))
    return series.withColumn("_day", F.to_date(time)).join(listed, "_day").drop("_day", time)


def with_time(df: DataFrame, time: str = "time") -> DataFrame:
    """df with the day that a forecast's lead day is about."""
    return df.withColumn(time, F.date_add("first_day", F.col("lead_day")))


def without_duplicates(df: DataFrame, coordinate: str, position: str) -> DataFrame:
    """The first entry of each coordinate by position."""
    best = df.groupBy(coordinate).agg(F.min_by(F.struct(*[c for c in df.columns if c != coordinate]), position).alias("r"))
    return best.select(*[F.col(c) if c == coordinate else F.col(f"r.{c}").alias(c) for c in df.columns])


def merged(parts: list[DataFrame], keys: tuple[str, ...] = CELL, how: str = "full", override: bool = False) -> DataFrame:
    """Tables of one variable each as one table, by the keys they have. how: full keeps cells of any, inner those of all.

    A variable of two tables is an error, or with override the first one's.
    """
    out = parts[0]
    for part in parts[1:]:
        on = [k for k in keys if k in out.columns and k in part.columns]
        shared = [c for c in part.columns if c in out.columns and c not in on]
        if shared and not override:
            raise ValueError(f"Two tables have {', '.join(shared)}")
        out = out.join(part.drop(*shared), on, how)
    return out


def concatenated(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def require_columns(df: DataFrame, columns: list[str], operation: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{operation}: missing {', '.join(missing)}")
    return df
