"""Regions: the public names."""

from brinemark.operators.regions import Bounds, Region, available_regions, custom, from_dict, load_region_file, resolve, subset_cube, subset_points, to_dict

subset = subset_cube

__all__ = ["Bounds", "Region", "available_regions", "custom", "from_dict", "load_region_file", "resolve", "subset", "subset_points", "to_dict"]
