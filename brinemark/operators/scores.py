"""Scores after their computation: parsing, nesting, comparison with a baseline, display rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinemark.functions.labels import capitalised, current_display_name, lead_day_number, parsed_label

# Lead days on display, each with the one that stands in for it.
DISPLAY_DAYS = (("1", "2"), ("3", None), ("5", None), ("7", None), ("10", "9"))
# Baselines in order of preference for both tracks.
PREFERRED = ("glo12", "glo12_1_degree")
COLOUR_SCALE, COLOUR_STEPS = 80.0, 5


def parse_rows(rows: DataFrame, label: str = "label", header: str = "header", value: str = "value") -> DataFrame:
    """Rows of a printed table as depth, variable, standard_name, unit, lead_day, value (null if it is no number).

    The depth has a capital first letter; a variable's name that begins with the depth loses it, and old names are renewed.
    """
    part = parsed_label(F.col(label))
    out = rows.withColumns({"_name": part["display_name"], "unit": part["unit"], "standard_name": part["standard_name"], "depth": capitalised(part["depth"])})
    prefix = F.concat("depth", F.lit(" "))
    bare = F.when((F.col("depth") != "") & F.startswith("_name", prefix), F.expr("substring(_name, length(depth) + 2)")).otherwise(F.col("_name"))
    number = F.col(value) if dict(rows.dtypes)[value] == "double" else F.nanvl(F.col(value).try_cast("double"), F.lit(None))
    kept = [c for c in rows.columns if c not in (label, header, value)]
    return out.select(*kept, "depth", current_display_name(bare).alias("variable"), "standard_name", "unit", lead_day_number(F.col(header)).alias("lead_day"), number.alias("value"))


def _by_key(entries: Column, key: str) -> Column:
    """Entries sorted by their key; maps inside them have no order of their own."""
    return F.array_sort(entries, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))


def nested(scores: DataFrame, keys: tuple[str, ...] = ("challenger",)) -> DataFrame:
    """keys and depths: map of depth to map of variable to (standard_name, unit, data by lead day). A score document is a few hundred numbers."""
    data = scores.groupBy(*keys, "depth", "variable", "standard_name", "unit").agg(F.map_from_entries(_by_key(F.collect_list(F.struct("lead_day", "value")), "lead_day")).alias("data"))
    variables = data.groupBy(*keys, "depth").agg(F.map_from_entries(_by_key(F.collect_list(F.struct("variable", F.struct("standard_name", "unit", "data"))), "variable")).alias("variables"))
    return variables.groupBy(*keys).agg(F.map_from_entries(_by_key(F.collect_list(F.struct("depth", F.struct("variables"))), "depth")).alias("depths"))


def as_json(documents: DataFrame, name: str = "challenger") -> DataFrame:
    return documents.select(name, F.to_json(F.struct(F.col(name).alias("name"), "depths"), {"ignoreNullFields": "false"}).alias("document"))


def percent(value: Column, base: Column) -> Column:
    """Difference from the base in percent of its size; null if the base is 0."""
    return F.when(base != 0, (value - base) / F.abs(base) * 100)


def percent_text(value: Column, base: Column) -> Column:
    """'+5%', '0%' or 'N/A'; halves round up."""
    p = F.floor(percent(value, base) + 0.5).cast("long")
    sign = F.when(percent(value, base) > 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(base == 0, F.when(value == 0, F.lit("0%")).otherwise(F.lit("N/A"))).otherwise(F.concat(sign, p.cast("string"), F.lit("%")))


def colour_edges(scale: float = COLOUR_SCALE, steps: int = COLOUR_STEPS) -> list[float]:
    """The finite edges of the colour bins: 0 and the scale halved again and again, both ways."""
    up = sorted(scale / 2**i for i in range(steps))
    return [-x for x in reversed(up)] + [0.0] + up


def colour_bin(p: Column, scale: float = COLOUR_SCALE) -> Column:
    """The bin of a percentage, each with its upper edge; a base of 0 counts as no difference."""
    edges, p = colour_edges(scale), F.coalesce(p, F.lit(0.0))
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(p <= edges[i], F.lit(i)).otherwise(out)
    return out


def against_baseline(scores: DataFrame, baseline: str, keys: tuple[str, ...] = ("metric", "depth", "variable", "lead_day"), name: str = "challenger", value: str = "value") -> DataFrame:
    """scores with the baseline's value, the percentage and the colour bin. Score tables are small; one window pass, no join."""
    base = F.first(F.when(F.col(name) == baseline, F.col(value)), ignorenulls=True).over(W.partitionBy(*keys))
    out = scores.withColumn("base", base)
    p = percent(F.col(value), F.col("base"))
    known = F.col(value).isNotNull() & F.col("base").isNotNull()
    return out.withColumns({"percent": p, "text": F.when(known, percent_text(F.col(value), F.col("base"))), "bin": F.when(known, colour_bin(p))})


def display_days(scores: DataFrame, keys: tuple[str, ...] = ("challenger", "depth", "variable")) -> DataFrame:
    """Rows of the lead days on display, by day of display: the preferred day, else its stand-in."""
    has = F.collect_set("lead_day").over(W.partitionBy(*keys))
    slot = F.lit(None).cast("string")
    for preferred, other in DISPLAY_DAYS:
        slot = F.when(F.col("lead_day") == preferred, F.lit(preferred)).otherwise(slot)
        if other:
            slot = F.when((F.col("lead_day") == other) & ~F.array_contains("_has", preferred), F.lit(preferred)).otherwise(slot)
    return scores.withColumn("_has", has).withColumn("slot", slot).where("slot IS NOT NULL").drop("_has")


def track(name: Column) -> Column:
    return F.when(F.endswith(name, F.lit("_1_degree")), F.lit("one_degree")).otherwise(F.lit("high_resolution"))


def baseline_of(names: list[str], chosen: str | None = None) -> str | None:
    """The baseline of a track: the chosen one, else a preferred one, else the first."""
    return chosen if chosen in names else next((p for p in PREFERRED if p in names), names[0] if names else None)


def baseline_first(scores: DataFrame, baseline: str, position: str, name: str = "challenger") -> DataFrame:
    return scores.orderBy(F.col(name) != baseline, position)


def version_order(versions: DataFrame, version: str = "version") -> DataFrame:
    """Versions by their numbers, newest first; a part that is no number counts as -1."""
    return versions.orderBy(version_key(F.col(version)).desc())


def version_key(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda x: F.when(F.regexp_like(x, F.lit("^[0-9]+$")), x.try_cast("int")).otherwise(F.lit(-1)))


def depth_variables(scores: DataFrame) -> DataFrame:
    """shared: variables at every depth; partial: those at some only. One row for each challenger."""
    sets = scores.groupBy("challenger", "depth").agg(F.sort_array(F.collect_set("variable")).alias("v")).groupBy("challenger").agg(F.collect_list("v").alias("l"))
    shared = F.aggregate("l", F.get("l", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return sets.select("challenger", F.sort_array(shared).alias("shared"), F.sort_array(F.array_except(F.array_distinct(F.flatten("l")), shared)).alias("partial"))


def with_metadata(names: DataFrame, metadata: DataFrame, key: str, columns: tuple[str, ...], default_to_key: str) -> DataFrame:
    """names with metadata by key; without it, default_to_key is the key itself and the others are empty."""
    joined = names.join(metadata.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.col(key) if c == default_to_key else F.lit("")) for c in columns})


def report_coverage(regions: DataFrame, challengers: DataFrame, reports: DataFrame) -> DataFrame:
    """The region and challenger pairs that have a report: the reports themselves, cut to known regions and challengers."""
    return reports.select("region", "challenger").distinct().join(regions.select("region"), "region", "left_semi").join(challengers.select("challenger"), "challenger", "left_semi")


def ordered_distinct(df: DataFrame, column: str, position: str) -> DataFrame:
    """column and position: each value of a column once, by where it stands first."""
    return df.groupBy(column).agg(F.min(position).alias(position)).orderBy(position)


def report_name(stem: str, region: str, custom: bool = False) -> str:
    return f"{stem}.{region}.report"
