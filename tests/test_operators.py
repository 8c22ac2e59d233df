"""The operators on small fixtures with known results, and on closed forms."""

import math
import os
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinemark import metrics
from brinemark.cli import Configuration
from brinemark.evaluate import evaluate_challenger, summary
from brinemark.functions import hashing, labels
from brinemark.functions.seawater import conservative_temperature, density_of, potential_temperature, with_potential_density
from brinemark.model import EASTWARD, GEO_EASTWARD, GEO_NORTHWARD, MLD, NORTHWARD, SALINITY, SSH, TEMPERATURE, Axes, Cube, Resolution, Source
from brinemark.operators import class4, lagrangian, regions, regrid, rmsd, scores, stencil
from brinemark.operators.axes import bracket, nearest_levels, select_levels
from brinemark.sources import catalog, ingest, reports, stage
from brinemark.streaming.windows import counts_by_forecast, matched_stream

D1, D2 = date(2024, 1, 3), date(2024, 1, 10)


def test_bilinear_fixture(spark):
    cells = [(d, lead, a, o, 100.0 * i + 10 * lead + a + 2 * o) for i, d in enumerate((D1, D2)) for lead in range(3) for a in range(2) for o in range(2)]
    cells = spark.createDataFrame(cells, "first_day date, lead_day int, lat_idx int, lon_idx int, v double")
    points = [(1, D1, 0, 0.0, 10.0), (2, D1, 1, 0.5, 10.5), (3, D1, 2, 1.0, 11.0), (4, D2, 0, 0.25, 10.25), (5, D2, 2, 0.75, 10.75), (6, D2, 2, 1.5, 10.5)]
    points = spark.createDataFrame(points, "id int, first_day date, lead_day int, latitude double, longitude double")
    out = class4.bilinear(points, cells, "v", (0.0, 1.0), (10.0, 11.0), ["id"]).orderBy("id").collect()
    assert [r.model_value for r in out] == pytest.approx([0, 11.5, 23, 100.75, 122.25])


def test_range_match_fixture(spark):
    obs = [(1, 1, datetime(2024, 1, 3)), (2, 2, datetime(2024, 1, 10)), (3, 3, datetime(2024, 1, 12)), (4, 4, datetime(2024, 1, 14))]
    obs = spark.createDataFrame(obs, "id int, v int, time timestamp_ntz")
    starts = spark.createDataFrame([(D1,), (D2,)], "first_day date")
    for out in (class4.match_forecasts(obs, starts, 10), class4.match_any_start(obs, starts, 10), matched_stream(obs, "2024-01-03").where("first_day <= DATE '2024-01-10'")):
        got = sorted((r.first_day, r.v, r.lead_day) for r in out.collect())
        assert [(v, lead) for _, v, lead in got] == [(1, 0), (2, 7), (3, 9), (2, 0), (3, 2), (4, 4)]


DEPTHS = (0.5, 47.0, 600.0, 700.0)


@pytest.mark.parametrize(
    ("t", "rho", "want"),
    [
        ([10, 10, 10, 10], [1000, 1000.04, 1000.05, 1000.06], 47),
        ([10, 10, 10, 10], [1000, 1000.01, 1000.02, 1000.05], 600),
        ([10, 10, None, None], [1000, 1000.01, None, None], 47),
        ([10, 10, math.nan, math.nan], [1000, 1000.01, math.nan, math.nan], 47),
        ([None] * 4, [None] * 4, None),
    ],
)
def test_mixed_layer_fixture(spark, t, rho, want):
    rows = [(D1, 0, 0, 0, i, d, None if a is None else float(a), None if b is None else float(b)) for i, (d, a, b) in enumerate(zip(DEPTHS, t, rho, strict=True))]
    df = spark.createDataFrame(rows, f"first_day date, lead_day int, lat_idx int, lon_idx int, depth_idx int, depth double, {TEMPERATURE} double, density double")
    assert [r[MLD] for r in stencil.mixed_layer(df).collect()] == [want]


def test_particle_counts():
    assert lagrangian.particle_count(40000, 40000) == 10000
    assert lagrangian.particle_count(2250, 40000) == 2000
    assert lagrangian.particle_count(1000, 40000) == 1000
    with pytest.raises(ValueError):
        lagrangian.particle_count(0, 10)


def test_depth_grids_and_domains(spark):
    a, b, c = (0.494, 2.6457, 5.0782, 7.9296), (0.494025, 2.645669, 5.078224, 7.92956), (0.494025, 47.37369, 92.32607, 155.8507)
    assert hashing.depth_grid_hash(a) == hashing.depth_grid_hash(b) != hashing.depth_grid_hash(c)
    assert hashing.rounded_depths(a)[:2].tolist() == [0.494, 2.646] and hashing.depth_grid_variant(a).startswith("depths-4-")
    df = spark.createDataFrame([(list(a),)], "d array<double>")
    assert df.select(hashing.depth_grid_hash_column(F.col("d"))).first()[0] == hashing.depth_grid_hash(a)
    assert hashing.domain_variant([0, 1], [2.0000001]) == hashing.domain_variant([0, 1], [2]) != hashing.domain_variant([0, 1], [2.1])
    for bad in ([], [math.nan]):
        with pytest.raises(ValueError):
            hashing.depth_grid_hash(bad)


def small_cube(spark, axis=(0.0, 10.0, 20.0)):
    rows = [(D1, 0, i, j, float(10 * i + j)) for i in range(3) for j in range(3)]
    return Cube(Axes(axis, axis), surface=spark.createDataFrame(rows, f"first_day date, lead_day int, lat_idx int, lon_idx int, {SSH} double"))


def test_regions(spark, tmp_path):
    box = regions.custom("Box", "Box", 5, 15, 5, 15)
    cut = regions.subset_cube(small_cube(spark), box)
    assert cut.axes == Axes((10.0,), (10.0,)) and [tuple(r)[2:] for r in cut.surface.collect()] == [(0, 0, 11.0)]
    west = Cube(Axes((0.0, 10.0, 20.0), (0.0, 180.0, 350.0)), surface=small_cube(spark).surface)
    got = regions.subset_cube(west, regions.custom("w", "W", -5, 5, -15, 5))
    assert got.axes.longitude == (0.0, 350.0) and sorted(r[SSH] for r in got.surface.collect()) == [0.0, 2.0]
    points = spark.createDataFrame([(float(x), float(y)) for x in (0, 10, 20) for y in (0, 10, 20)], "latitude double, longitude double")
    assert [tuple(r) for r in regions.subset_points(points, box).collect()] == [(10.0, 10.0)]
    assert regions.resolve(None) is regions.GLOBAL and regions.resolve("IBI ") is regions.IBI
    assert regions.from_dict(regions.to_dict(box)) == box and regions.from_dict(regions.to_dict("ibi")) is regions.IBI
    path = tmp_path / "r.json"
    path.write_text('{"id": "western_med", "display_name": "West", "bounds": {"minimum_latitude": 34, "maximum_latitude": 44.5, "minimum_longitude": -1, "maximum_longitude": 18}}')
    assert regions.load_region_file(path).bounds.maximum_latitude == 44.5
    path.write_text("{")
    for bad in (lambda: regions.load_region_file(path), lambda: regions.load_region_file(tmp_path / "none"), lambda: regions.custom("ibi", "x", 0, 1, 0, 1), lambda: regions.custom("a", " ", 0, 1, 0, 1), lambda: regions.custom("a", "a", 1, 0, 0, 1), lambda: regions.resolve("atlantis"), lambda: regions.from_dict({"id": "ibi", "bounds": {}}), lambda: regions.from_dict({"id": "x"}), lambda: regions.subset_cube(small_cube(spark), regions.custom("far", "Far", 60, 70, 0, 1))):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(
    "bounds",
    [(1, 0, 0, 1), (0, 0, 0, 1), (0, 91, 0, 1), (-91, 0, 0, 1), (0, 1, 5, 5), (0, 1, -361, 0), (0, 1, 0, 361), (0, math.nan, 0, 1), (0, 1, 0, math.inf)],
)
def test_rules_of_regions(bounds):
    with pytest.raises(ValueError):
        regions.custom("a", "A", *bounds)
    names = [f.name for f in regions.fields(regions.Bounds)]
    with pytest.raises(ValueError):
        regions.from_dict({"id": "a", "bounds": dict(zip(names, bounds, strict=True))})


def test_descriptions_of_regions():
    names = [f.name for f in regions.fields(regions.Bounds)]
    box = dict(zip(names, (0, 1, 350, -10), strict=True))
    assert regions.from_dict({"id": "west_med", "bounds": box}) == regions.custom("west_med", "West Med", 0, 1, 350, -10)
    assert regions.resolve("") is regions.GLOBAL and regions.resolve(regions.IBI) is regions.IBI and regions.from_dict({"id": "IBI"}) is regions.IBI
    assert regions.to_dict(None) == {"id": "global", "display_name": "Global", "bounds": None, "official": True}
    bad = ({"bounds": box}, {"id": "a b", "bounds": box}, {"id": "-a", "bounds": box}, {"id": "a", "official": True, "bounds": box}, {"id": "a", "bounds": {k: box[k] for k in names[:3]}}, {"id": "a", "bounds": [1, 2, 3, 4]}, {"id": "ibi", "display_name": "x"}, [], 3, regions.Region("ibi", "IBI"), regions.Region("x", "X"))
    for told in bad:
        with pytest.raises(ValueError):
            regions.resolve(told)


def test_grid_deviation_averages_roots_over_forecasts(spark):
    schema = "first_day date, lead_day int, depth string, latitude_key int, longitude_key int, x double"
    c = spark.createDataFrame([(D1, 0, "surface", 0, 0, 3.0), (D1, 0, "surface", 0, 1, None), (D1, 0, "surface", 1, 1, math.nan), (D2, 0, "surface", 0, 0, 5.0), (D2, 0, "surface", 9, 9, 99.0)], schema)
    r = spark.createDataFrame([(d, 0, "surface", a, b, 0.0) for d in (D1, D2) for a in (0, 1) for b in (0, 1)], schema)
    assert [tuple(x) for x in rmsd.deviations(c, r, ["x"]).collect()] == [("x", "surface", 0, 4.0)]


def test_pooled_point_deviation(spark):
    df = spark.createDataFrame([("a", 0, 3.0, 0.0), ("a", 0, 4.0, 0.0), ("a", 0, None, 0.0), ("a", 1, 1.0, None)], "depth_bin string, lead_day int, model_value double, observation_value double")
    assert [(r.depth_bin, r.lead_day, r.n) for r in class4.point_deviations(df).collect()] == [("a", 0, 2)]
    assert class4.point_deviations(df).first().rmsd == pytest.approx(math.sqrt(12.5))


def test_nearest_levels_and_labels(spark):
    assert nearest_levels((0.0, 2.0), {"a": 1.0, "b": 0.9}) == {"a": 1, "b": 0}
    df = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "depth_idx int, v string")
    assert sorted(tuple(r) for r in select_levels(df, {"a": 1, "b": 1}).collect()) == [(1, "y", "a"), (1, "y", "b")]


@pytest.mark.parametrize("axis", [tuple(np.linspace(-80, 90, 2041).astype(np.float32).astype(float)), (0.0, 1.0, 5.0, 5.5, 30.0)])
def test_bracket_equals_search(spark, axis):
    q = [float(x) for x in np.random.default_rng(1).uniform(axis[0] - 1, axis[-1] + 1, 300)] + [float(axis[k]) for k in (0, -1, 2)]
    i, w = bracket(F.col("q"), axis)
    for r in spark.createDataFrame([(x,) for x in q], "q double").select("q", i.alias("i"), w.alias("w")).collect():
        if not axis[0] <= r.q <= axis[-1]:
            assert r.i is None and r.w is None
        else:
            k = min(int(np.searchsorted(axis, r.q, side="right")) - 1, len(axis) - 2)
            assert r.i == k and r.w == pytest.approx((r.q - axis[k]) / (axis[k + 1] - axis[k]), abs=1e-9)


def test_vertical_bracket_clamps_and_needs_both_levels(spark):
    levels = [(D1, 0, k, a, o, v) for k, v in enumerate((10.0, 20.0, None)) for a in (0, 1) for o in (0, 1)]
    levels = spark.createDataFrame(levels, "first_day date, lead_day int, depth_idx int, lat_idx int, lon_idx int, v double")
    points = spark.createDataFrame([(i, D1, 0, 0.5, 0.5, q) for i, q in enumerate((-3.0, 0.0, 2.5, 10.0, 12.0, 40.0))], "id int, first_day date, lead_day int, latitude double, longitude double, depth double")
    out = {r.id: r.model_value for r in class4.sample_bracket(points, levels, "v", (0.0, 1.0), (0.0, 1.0), (0.0, 10.0, 20.0), ["id"]).collect()}
    assert out == pytest.approx({0: 10.0, 1: 10.0, 2: 12.5, 3: 20.0})


def test_natural_spline():
    x = np.array([0.0, 1.0, 2.5, 4.0, 7.0])
    assert class4.natural_spline(x, 3 * x - 2, 3.3) == pytest.approx(7.9)
    y = np.array([1.0, -2.0, 0.5, 4.0, 1.0])
    fine = np.linspace(0, 7, 701)
    s = np.array([class4.natural_spline(x, y, q) for q in fine])
    assert [class4.natural_spline(x, y, q) for q in x] == pytest.approx(list(y))
    second = np.diff(s, 2) / 0.01**2
    assert abs(second[0]) < 0.2 and abs(second[-1]) < 0.2 and np.abs(np.diff(second)).max() < 0.5
    gap = np.array([1.0, math.nan, 0.5, 4.0, 1.0])
    assert class4.natural_spline(x, gap, 2.0) == pytest.approx(class4.natural_spline(np.delete(x, 1), np.delete(gap, 1), 2.0))
    assert math.isnan(class4.natural_spline(x, y, 7.1)) and math.isnan(class4.natural_spline(x[:3], y[:3], 1.0))


def test_salinity_spline_of_a_linear_profile(spark):
    depth = (0.0, 5.0, 12.0, 30.0, 50.0)
    levels = [(D1, 0, k, a, o, 2 * d + a) for k, d in enumerate(depth) for a in (0, 1) for o in (0, 1)]
    levels = spark.createDataFrame(levels, "first_day date, lead_day int, depth_idx int, lat_idx int, lon_idx int, v double")
    points = spark.createDataFrame([(1, D1, 0, 0.25, 0.5, 20.0), (2, D1, 0, 0.25, 0.5, 60.0)], "id int, first_day date, lead_day int, latitude double, longitude double, depth double")
    assert {r.id: r.model_value for r in class4.sample_spline(points, levels, "v", (0.0, 1.0), (0.0, 1.0), depth, ["id"]).collect()} == pytest.approx({1: 40.25})


def test_velocity_at_15_metres(spark):
    t = datetime(2024, 1, 4)
    rows = [(t, 1.0, 1.0, D1, 1, d, v) for d, v in ((5.0, 1.0), (10.0, 2.0), (10.0, 4.0), (20.0, 5.0), (90.0, 9.0))] + [(t, 2.0, 1.0, D1, 1, 5.0, 1.0)] + [(t, 3.0, 1.0, D1, 1, 15.0, 7.0)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, first_day date, lead_day int, depth double, observation_value double")
    assert {r.latitude: r.observation_value for r in class4.at_target_depth(df).collect()} == {1.0: 4.0, 3.0: 7.0}


def test_geostrophic_slope_and_land(spark):
    lat, lon = tuple(-2.0 + 0.5 * i for i in range(9)), tuple(10.0 + 0.5 * i for i in range(6))
    land = {(2, 3)}
    rows = [(D1, 0, i, j, 0.1 * lat[i] + 0.2 * lon[j]) for i in range(9) for j in range(6) if (i, j) not in land]
    out = stencil.geostrophic(spark.createDataFrame(rows, f"first_day date, lead_day int, lat_idx int, lon_idx int, {SSH} double"), lat, lon).collect()
    got = {(r.lat_idx, r.lon_idx): (r[GEO_EASTWARD], r[GEO_NORTHWARD]) for r in out}
    assert not {i for i, _ in got} & {i for i, x in enumerate(lat) if -0.5 <= x <= 0.5}
    metre = math.pi / 180 * 6371000
    for (i, j), (u, v) in got.items():
        f = 2 * 7.2921e-5 * math.sin(math.radians(lat[i]))
        beside, above = (i, j) in {(2, 2), (2, 4)}, (i, j) in {(1, 3), (3, 3)}
        assert v is None if beside else v == pytest.approx(9.81 / f * 0.2 / (metre * math.cos(math.radians(lat[i]))))
        assert u is None if above else u == pytest.approx(-9.81 / f * 0.1 / metre)
    assert (2, 3) in got  # central differences don't need the cell itself


def test_regridding_a_linear_field(spark):
    lat, lon = tuple(0.1 + 0.4 * i for i in range(8)), tuple(-3.0 + 0.5 * i for i in range(8))
    df = spark.createDataFrame([(D1, 0, i, j, 3 * lat[i] - lon[j]) for i in range(8) for j in range(8)], "first_day date, lead_day int, lat_idx int, lon_idx int, x double")
    to = regrid.degree_axis(lat), regrid.degree_axis(lon)
    assert to == ([0.5, 1.5, 2.5], [-2.5, -1.5, -0.5, 0.5][:4])
    out = {(r.lat_idx, r.lon_idx): r.x for r in regrid.interpolate(df, ["x"], lat, lon, ["first_day", "lead_day"]).collect()}
    assert out == pytest.approx({(a, b): 3 * p - q for a, p in enumerate(to[0]) for b, q in enumerate(to[1]) if q <= lon[-1]})
    assert regrid.interpolate(df.where("lat_idx <> 1"), ["x"], lat, lon, ["lead_day"]).where("x IS NULL").count() > 0


def test_drift_in_analytic_flows():
    lat, lon = np.linspace(-10, 10, 41), np.linspace(0, 20, 41)
    shape = (4, 41, 41)
    still = lagrangian.Field(np.full(shape, np.nan), np.full(shape, np.nan), lat, lon).drift(np.array([0.0]), np.array([5.0]), 3)
    assert still[0].tolist() == [[0.0]] * 4
    north = lagrangian.Field(np.zeros(shape), np.full(shape, 0.5), lat, lon).drift(np.array([0.0, 9.9]), np.array([5.0, 5.0]), 3)
    assert north[0][:, 0] == pytest.approx(np.arange(4) * 0.5 * 86400 / (1852 * 60)) and np.isnan(north[0][1:, 1]).all()
    x, y = np.meshgrid(lon - 10, lat)
    omega = 2 * math.pi / (3 * 86400) / 4  # a quarter turn in three days
    u, v = -omega * y * 1852 * 60 * np.cos(np.radians(y)), omega * x * 1852 * 60
    turn = lagrangian.Field(np.broadcast_to(u, shape), np.broadcast_to(v, shape), lat, lon).drift(np.array([0.0]), np.array([12.0]), 3)
    assert turn[0][-1, 0] == pytest.approx(2.0, abs=5e-3) and turn[1][-1, 0] == pytest.approx(10.0, abs=5e-3)


def test_seeds_follow_the_row_major_order(spark):
    points = [(i, j) for i in range(12) for j in range(9) if (i + 2 * j) % 5]
    out = lagrangian.seeds(spark.createDataFrame(points, "lat_idx int, lon_idx int").repartition(5), 20).orderBy("pid").collect()
    drawn = np.random.RandomState(123).choice(len(points), 20, replace=False)
    assert [(r.lat_idx, r.lon_idx) for r in out] == [points[k] for k in drawn]


def test_sea_water(spark):
    ev = lambda sql, **k: spark.sql("SELECT " + sql.format(**{n: f"{v}D" for n, v in k.items()})).first()[0]
    assert ev(density_of("{s}", "{t}", "{p}"), s=34.7118, t=28.8099, p=10) == pytest.approx(1021.8395, abs=1e-3)
    assert ev(density_of("{s}", "{t}", "{p}"), s=34.7324, t=4.3236, p=1000) == pytest.approx(1032.0024, abs=1e-3)
    assert ev(conservative_temperature("{s}", "{t}"), s=34.7118, t=28.7832) == pytest.approx(28.8099, abs=1e-4)
    assert ev(potential_temperature("{s}", "{t}", "{p}"), s=35.0256, t=22.8103, p=125) == pytest.approx(22.7849, abs=1e-3)
    df = spark.createDataFrame([(35.0, 10.0, 100.0), (None, 10.0, 1.0), (-1.0, 10.0, 1.0)], "s double, t double, d double")
    out = [r.density for r in with_potential_density(df, "s", "t", "d").collect()]
    assert 1026 < out[0] < 1028 and out[1] is None and 999 < out[2] < 1001


def test_labels_and_scores(spark):
    rows = spark.createDataFrame([(labels_row, "Lead day 2", "1.5") for labels_row in ("Surface height (m) [ssh]{surface}", "50m Temperature (°C) [t]{50m}")] + [("plain", "Lead day 1", "nan?")], "label string, header string, value string")
    got = {tuple(r) for r in scores.parse_rows(rows).collect()}
    assert got == {("Surface", "sea surface height", "ssh", "m", "2", 1.5), ("50m", "temperature", "t", "°C", "2", 1.5), ("", "plain", "unknown", "", "1", None)}
    assert labels.lead_day_label(0) == "Lead day 1"
    assert scores.colour_edges() == [-80.0, -40.0, -20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0, 40.0, 80.0]
    df = spark.createDataFrame([("b", 0.0), ("a", 0.0), ("c", 2.0)], "challenger string, value double").withColumns({k: F.lit("x") for k in ("metric", "depth", "variable", "lead_day")})
    assert {r.challenger: r.text for r in scores.against_baseline(df, "b").collect()} == {"a": "0%", "b": "0%", "c": "N/A"}
    assert scores.baseline_of(["x", "glo12"]) == "glo12" and scores.baseline_of(["x"], "y") == "x" and scores.baseline_of([]) is None
    v = spark.createDataFrame([("1.10.0",), ("1.9.0",), ("dev",), ("1.9",)], "version string")
    assert [r.version for r in scores.version_order(v).collect()] == ["1.10.0", "1.9.0", "1.9", "dev"]


def test_ingest(spark):
    df = spark.createDataFrame([(1.0, math.nan)], "thetao double, zos double")
    named = ingest.nulls_for_nans(ingest.standard_names(df))
    assert named.columns == [TEMPERATURE, SSH] and named.first()[1] is None
    t = spark.createDataFrame([(D1, datetime(2024, 1, d), d) for d in (9, 4, 7)] + [(D2, datetime(2024, 1, 12), 1)], "first_day date, time timestamp_ntz, v int")
    assert sorted((r.v, r.lead_day) for r in ingest.renumbered(t, 2).collect()) == [(1, 0), (4, 0), (7, 1)]
    with pytest.raises(ValueError):
        ingest.require_columns(df, ["time"], "read")


def test_resolution():
    for step, kind in ((1.0, Resolution.ONE_DEGREE), (0.25, Resolution.QUARTER_DEGREE), (1 / 12, Resolution.TWELFTH_DEGREE)):
        assert Axes((0.0, step * 1.05), (5.0, 5.0 + step)).resolution() is kind
    with pytest.raises(ValueError):
        Axes((0.0, 4.0), (0.0, 4.0)).resolution()
    assert Source("reference", "x", "one_degree", "v").key(10) == "reference-x-one_degree-v-10d"


def test_configuration(monkeypatch):
    monkeypatch.setenv("BRINEMARK_WORKERS", "7")
    monkeypatch.setenv("BRINEMARK_KEEP_STAGE", "true")
    c = Configuration.resolved({"retries": 2})
    assert (c.workers, c.retries, c.keep_stage) == (7, 2, True) and Configuration.resolved({"workers": 3}).workers == 3
    with pytest.raises(ValueError):
        Configuration.resolved({"workers": 0})


def stored(spark, root):
    """A challenger, both references, points and topography at one degree; the references differ by known amounts."""
    axes = Axes(tuple(20.5 + i for i in range(6)), tuple(-5.5 + i for i in range(6)), (0.494025, 15.0, 47.0, 92.0, 222.0))
    level = [(d, lead, k, i, j) for d in (D1, D2) for lead in range(10) for k in range(5) for i in range(6) for j in range(6)]
    levels = spark.createDataFrame(level, "first_day date, lead_day int, depth_idx int, lat_idx int, lon_idx int")
    surface = levels.where("depth_idx = 0").drop("depth_idx")
    for kind, name, off in (("challenger", "glonet", 0.0), ("reference", "glorys_reanalysis", 1.0), ("reference", "glo12_analysis", 2.0)):
        lv = levels.withColumns({TEMPERATURE: 20 - F.col("depth_idx") + off, SALINITY: F.lit(35.0) + 0.1 * F.col("depth_idx"), EASTWARD: F.lit(0.1) + 0.1 * off, NORTHWARD: F.lit(0.0)})
        sf = surface.withColumn(SSH, 0.1 * F.col("lat_idx") + 0.01 * off * F.col("lon_idx"))
        cube = Cube(axes, lv, sf)
        catalog.write_cube(cube, f"{root}/{kind}/{name}/{'native' if kind == 'challenger' else 'one_degree'}")
    obs = [(datetime(2024, 1, 5, 6), date(2024, 1, 5), 22.0, -3.0, 10.0, 19.0, 35.0, 0.1, 0.3, None)] + [(datetime(2024, 1, 5, 7), date(2024, 1, 5), 22.0, -3.0, z, None, None, None, None, 0.2) for z in (10.0, 20.0)]
    names = f"time timestamp_ntz, day date, latitude double, longitude double, depth double, {TEMPERATURE} double, {SALINITY} double, {NORTHWARD} double, {SSH} double, {EASTWARD} double"
    spark.createDataFrame(obs, names).write.partitionBy("day").parquet(f"{root}/observations")
    spark.createDataFrame([(i, j, 0.0) for i in range(6) for j in range(6)], "lat_idx int, lon_idx int, mdt double").write.parquet(f"{root}/mean_dynamic_topography/one_degree")
    return axes


def test_evaluation_end_to_end(spark, tmp_path):
    root = str(tmp_path / "data")
    stored(spark, root)
    report = evaluate_challenger(spark, lambda s: catalog.open_cube(s, catalog.CHALLENGERS["glonet"], root), "glonet", str(tmp_path / "out"), None, root)
    assert not report.failed and report.done == list(metrics.ALL) and summary([report]) == (1, 0)
    read = lambda m: {r.label: r.asDict() for r in spark.read.json(f"{report.path}/{m}").collect()}
    table = read("rmsd_of_variables_compared_to_glorys_reanalysis")
    assert table[f"Temperature (°C) [{TEMPERATURE}]{{surface}}"]["Lead day 10"] == pytest.approx(1.0)
    assert read("rmsd_of_variables_compared_to_glo12_analysis")[f"Temperature (°C) [{TEMPERATURE}]{{50m}}"]["Lead day 1"] == pytest.approx(2.0)
    points = read("rmsd_of_variables_compared_to_observations")
    assert points[f"Sea level anomaly (m) [{SSH}]{{surface}}"]["Lead day 3"] == pytest.approx(abs(0.15 + 0.1148 - 0.3))
    assert points[f"Zonal current (m/s) [{EASTWARD}]{{15m}}"]["Lead day 3"] == pytest.approx(0.1)
    drift = read("deviation_of_lagrangian_trajectories_compared_to_glorys_reanalysis")[metrics.LAGRANGIAN_LABEL]
    assert set(drift) == {"label", *labels.lead_day_labels(2, 9)}
    assert drift["Lead day 2"] == pytest.approx(0.1 * 86400 / (1852 * 60) * 111, rel=0.02)
    cells = reports.read_reports(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in reports.available(cells).collect()] == [("global", "glonet")]
    docs = {r.metric: r.depths for r in reports.documents(cells).collect()}
    assert docs["rmsd_of_variables_compared_to_glo12_analysis"]["50m"]["variables"]["temperature"]["data"]["1"] == pytest.approx(2.0)
    assert set(docs) == set(metrics.ALL)
    region = regions.custom("part", "Part", 21, 25, -5, 0)
    assert evaluate_challenger(spark, lambda s: catalog.open_cube(s, catalog.CHALLENGERS["glonet"], root), "g", str(tmp_path / "out"), region, root, metrics.ALL[1:2]).done == [metrics.ALL[1]]
    assert evaluate_challenger(spark, lambda s: catalog.open_cube(s, catalog.CHALLENGERS["glonet"], root), "g", str(tmp_path / "out"), None, root + "x", metrics.ALL[1:2]).failed


def test_stage_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    root = f"file://{tmp_path}/stage"
    assert stage.staged(spark, root, "k", build).count() == 3 == stage.staged(spark, root, "k", build).count() and built == [1]
    stage.clear(spark, [f"{root}/k"])
    assert not stage.is_staged(spark, f"{root}/k")
    with stage.build_guard(spark, f"{root}/k", poll=0.01):
        assert (tmp_path / "stage" / "k.lock").exists()
    assert not (tmp_path / "stage" / "k.lock").exists()
    (tmp_path / "stage" / "old.lock").touch()
    os.utime(tmp_path / "stage" / "old.lock", (0, 0))
    with stage.build_guard(spark, f"{root}/old", poll=0.01):  # its driver is gone
        pass


def test_stream_counts(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 3 + i % 25, 5)) for i in range(100)]
    spark.createDataFrame(rows, "id int, time timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, time timestamp").parquet(str(tmp_path / "in"))
    q = counts_by_forecast(matched_stream(stream, "2024-01-03")).writeStream.outputMode("complete").format("memory").queryName("matched_counts").start()
    q.processAllAvailable()
    q.stop()
    batch = counts_by_forecast(matched_stream(spark.read.parquet(str(tmp_path / "in")), "2024-01-03"))
    assert sorted(map(tuple, spark.table("matched_counts").collect())) == sorted(map(tuple, batch.collect()))


def test_levels_and_forecasts_are_pruned_at_the_scan(spark, tmp_path, capsys):
    root = str(tmp_path / "data")
    stored(spark, root)
    challenger = catalog.open_cube(spark, catalog.CHALLENGERS["glonet"], root)
    reference = catalog.open_reference(spark, "glorys_reanalysis", challenger, root)
    rmsd.cube_rmsd(challenger, reference, [TEMPERATURE]).explain("formatted")
    plan = capsys.readouterr().out
    pushed = [line for line in plan.split("\n") if line.startswith("PushedFilters") and "In(depth_idx, [0,2,3,4])" in line]
    assert len(pushed) >= 2 and "dynamicpruning" in plan
    assert SALINITY not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_range_match_is_an_equality_join(spark, capsys):
    obs = spark.createDataFrame([(1, datetime(2024, 1, 3))], "id int, time timestamp_ntz")
    class4.match_forecasts(obs, spark.createDataFrame([(D1,)], "first_day date"), 10).explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_unknown_forecasts_fail(spark):
    points = spark.createDataFrame([(1, D1), (2, D2)], "id int, first_day date")
    assert class4.known_forecasts(points, spark.createDataFrame([(D1,), (D2,), (D2,)], "first_day date")).count() == 2
    with pytest.raises(Exception, match="No forecast of 2024-01-10"):
        class4.known_forecasts(points, spark.createDataFrame([(D1,)], "first_day date")).collect()
    with pytest.raises(ValueError, match="2024-01-10"):
        lagrangian.same_forecasts(points, points.where("id = 1"))
    lagrangian.same_forecasts(points, points.unionByName(points))


def test_splines_of_many_profiles():
    r = np.random.default_rng(3)
    x, y, q = np.cumsum(r.uniform(0.5, 2, (50, 7)), 1), r.normal(size=(50, 7)), r.uniform(-1, 14, 50)
    assert np.allclose(class4.natural_splines(x, y, q), [class4.natural_spline(a, b, c) for a, b, c in zip(x, y, q, strict=True)], equal_nan=True)


def test_trajectories_equal_the_field(spark):
    r = np.random.default_rng(5)
    lat, lon = tuple(np.linspace(0, 4, 9)), tuple(np.linspace(10, 14, 9))
    rows, fields = [], {}
    for d in (D1, D2):
        u, v = r.normal(0, 0.5, (2, 4, 9, 9)).astype(np.float32)
        if d == D2:
            u[2], v[2] = np.nan, np.nan  # a day without rows
        fields[d] = u, v
        rows += [(d, "a", t, i, j, float(u[t, i, j]), float(v[t, i, j])) for t in range(4) for i in range(9) for j in range(9) if not np.isnan(u[t, i, j])]
    currents = spark.createDataFrame(rows, "first_day date, side string, lead_day int, lat_idx int, lon_idx int, u float, v float").repartition(7)
    particles = spark.createDataFrame([(i, 0.3 + 0.4 * i, 13.9 - 0.3 * i) for i in range(9)], "pid int, lat double, lon double")
    for kernel in (lagrangian.fourth_order, lambda f, w, step, a, o, dt: (a + f.velocity(w, a, o)[1] * dt, o + f.velocity(w, a, o)[0] * dt, f.velocity(w, a, o)[2])):
        got = {(x.first_day, x.day, x.pid): (x.lat, x.lon) for x in lagrangian.trajectories(currents, particles, lat, lon, 4, kernel=kernel).collect()}
        assert len(got) == 2 * 4 * 9
        for d, (u, v) in fields.items():
            want = lagrangian.Field(u, v, np.array(lat), np.array(lon)).drift(np.array([0.3 + 0.4 * i for i in range(9)]), np.array([13.9 - 0.3 * i for i in range(9)]), 3, kernel)
            for t in range(4):
                for i in range(9):
                    a, b = got[d, t, i]
                    assert (a is None and np.isnan(want[0][t, i])) or (a == pytest.approx(want[0][t, i]) and b == pytest.approx(want[1][t, i]))


def test_parts_are_merged_as_a_cube_is_opened(spark, tmp_path):
    root = str(tmp_path / "data")
    axes = stored(spark, root)
    folder = f"{root}/challenger/glo12/native"
    whole = catalog.open_cube(spark, catalog.CHALLENGERS["glonet"], root)
    for part, names in (("a", [TEMPERATURE, SALINITY]), ("b", [EASTWARD, NORTHWARD])):
        catalog.write_cube(Cube(axes, whole.levels.select(*ingest.CELL, *names).where("lead_day <> 3" if part == "b" else "true"), whole.surface if part == "a" else None), f"{folder}/parts/{part}")
    os.rename(f"{folder}/parts/a/axes.json", f"{folder}/axes.json")
    cube = catalog.open_cube(spark, catalog.CHALLENGERS["glo12"], root, preprocess=lambda df: df.where("lead_day > 0"))
    assert cube.levels.count() == whole.levels.where("lead_day NOT IN (0, 3)").count() and {TEMPERATURE, NORTHWARD} <= set(cube.levels.columns)
    assert cube.surface.count() == whole.surface.where("lead_day > 0").count()
    a, b = spark.createDataFrame([(1, 2.0, 3.0)], "k int, x double, y double"), spark.createDataFrame([(1, 9.0, 4.0)], "k int, x double, z double")
    assert tuple(ingest.merged([a, b], ("k",), override=True).first()) == (1, 2.0, 3.0, 4.0)
    with pytest.raises(ValueError):
        ingest.merged([a, b], ("k",))


def test_staged_cubes_are_read_again(spark, tmp_path):
    root, folder = str(tmp_path / "data"), f"file://{tmp_path}/stage"
    stored(spark, root)
    calls = []

    def challenger(s):
        calls.append(1)
        return catalog.open_cube(s, catalog.CHALLENGERS["glonet"], root)

    names = [m for m in metrics.ALL if "rmsd_of_variables" in m]
    plain = evaluate_challenger(spark, challenger, "glonet", str(tmp_path / "a"), None, root, names)
    staged = evaluate_challenger(spark, challenger, "glonet", str(tmp_path / "b"), None, root, names, ["challenger", "references"], folder)
    keys = stage.children(spark, folder)
    assert not staged.failed and len(keys) == 3 and all("-10d" in k and "depths-5-" in k for k in keys)
    for m in names:
        assert sorted(map(str, spark.read.json(f"{plain.path}/{m}").collect())) == sorted(map(str, spark.read.json(f"{staged.path}/{m}").collect()))
    times = {k: os.stat(f"{tmp_path}/stage/{k}/axes.json").st_mtime_ns for k in keys}
    assert not evaluate_challenger(spark, challenger, "glonet", str(tmp_path / "c"), None, root, names, ["references", "challenger"], folder).failed
    assert times == {k: os.stat(f"{tmp_path}/stage/{k}/axes.json").st_mtime_ns for k in stage.children(spark, folder)}
    for stages, where in ((["x"], folder), (["references"], "")):
        with pytest.raises(ValueError):
            evaluate_challenger(spark, challenger, "g", str(tmp_path / "d"), None, root, names, stages, where)


def test_point_ids_hold_over_splits(spark, tmp_path):
    root = str(tmp_path / "data")
    stored(spark, root)
    cube = catalog.open_cube(spark, catalog.CHALLENGERS["glonet"], root)
    ids = lambda: sorted((str(r.point_id), r.depth) for r in catalog.observations(spark, cube, root).collect())
    first = ids()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert ids() == first and len(set(first)) == 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def shuffled(spark, df):
    """The rows of df and how many rows its stages wrote to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        of = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in map(of.apply, range(of.size()))}

    before, rows = written(), df.collect()
    return rows, sum(n for i, n in written().items() if i not in before)


def sampled_grid(spark, n=4000):
    """Points (many in each box) and levels on a small grid, some without values, as frames and arrays."""
    r = np.random.default_rng(11)
    axis, depth = tuple(2.0 * i for i in range(4)), (0.5, 3.0, 7.0, 15.0, 40.0, 100.0)
    values = r.normal(10, 3, (2, len(depth), 4, 4))
    values[0, 2, 1, 1] = values[1, 5, 0, 0] = values[1, 0, 3, 3] = values[1, 1:4, 2, 3] = np.nan
    cells = [(D1, t, k, i, j, float(values[t, k, i, j])) for t in range(2) for k in range(6) for i in range(4) for j in range(4) if not np.isnan(values[t, k, i, j]) or k == 2]
    points = [(i, D1, i % 2, float(a), float(o), float(q)) for i, (a, o, q) in enumerate(zip(r.uniform(-0.2, 6.2, n), r.uniform(-0.2, 6.2, n), r.choice([*r.uniform(-2, 120, 50), *depth], n), strict=True))]
    schema = "first_day date, lead_day int, depth_idx int, lat_idx int, lon_idx int, v double"
    return axis, depth, values, points, spark.createDataFrame(cells, schema), spark.createDataFrame(points, "id int, first_day date, lead_day int, latitude double, longitude double, depth double")


def profile_at(axis, values, t, a, o):
    """The bilinear profile at a place, NaN where a corner is missing; None outside the grid."""
    if not (axis[0] <= a <= axis[-1] and axis[0] <= o <= axis[-1]):
        return None
    i, j = min(int(a // 2), 2), min(int(o // 2), 2)
    u, v = a / 2 - i, o / 2 - j
    return (1 - u) * (1 - v) * values[t, :, i, j] + (1 - u) * v * values[t, :, i, j + 1] + u * (1 - v) * values[t, :, i + 1, j] + u * v * values[t, :, i + 1, j + 1]


def test_salinity_splines_equal_each_profile_and_move_a_row_a_point(spark):
    axis, depth, values, points, levels, df = sampled_grid(spark)
    rows, moved = shuffled(spark, class4.sample_spline(df, levels, "v", axis, axis, depth, ["id"]))
    want = {}
    for i, _, t, a, o, q in points:
        y = profile_at(axis, values, t, a, o)
        x = math.nan if y is None else class4.natural_spline(np.array(depth), y, q)
        if not math.isnan(x):
            want[i] = x
    assert 1000 < len(want) < len(points) and {r.id: r.model_value for r in rows} == pytest.approx(want)
    assert moved < 3 * len(points)
    twice = df.where("id < 100").unionByName(df.where("id < 50"))  # an id of several points names none
    assert {r.id for r in class4.sample_spline(twice, levels, "v", axis, axis, depth, ["id"]).collect()} == {i for i in want if 50 <= i < 100}


def test_brackets_equal_each_profile_and_move_a_row_a_point(spark):
    axis, depth, values, points, levels, df = sampled_grid(spark)
    rows, moved = shuffled(spark, class4.sample_bracket(df, levels, "v", axis, axis, depth, ["id"]))
    want = {}
    for i, _, t, a, o, q in points:
        y = profile_at(axis, values, t, a, o)
        x = math.nan if y is None else float(y[depth.index(q)] if q in depth else np.interp(q, depth, y))
        if not math.isnan(x):
            want[i] = x
    assert 1000 < len(want) < len(points) and {r.id: r.model_value for r in rows} == pytest.approx(want)
    assert moved < 3 * len(points)
    rows, moved = shuffled(spark, class4.bilinear(df, levels.where("depth_idx = 3"), "v", axis, axis, ["id"]))
    want = {i: y[3] for i, _, t, a, o, _ in points if (y := profile_at(axis, values, t, a, o)) is not None and not math.isnan(y[3])}
    assert {r.id: r.model_value for r in rows} == pytest.approx(want) and moved < 3 * len(points)


def test_one_level_is_sampled_once(spark):
    axis, depth, values, points, levels, df = sampled_grid(spark)
    of = lambda f, name: f(df, levels, "v", axis, axis, depth[:1], ["id"], name=name)
    rows, moved = shuffled(spark, of(class4.sample_bracket, "a").join(of(class4.sample_spline, "b"), "id"))
    want = {i: y[0] for i, _, t, a, o, _ in points if (y := profile_at(axis, values, t, a, o)) is not None and not math.isnan(y[0])}
    assert {r.id: r.a for r in rows} == {r.id: r.b for r in rows} == pytest.approx(want)
    assert moved < 3 * len(points)  # both samplers have one plan, which runs once


def test_expressions_of_points_are_compiled(spark, capsys):
    """The JVM doesn't compile methods of more than 8000 bytes."""
    axis, depth, _, _, levels, df = sampled_grid(spark, 10)
    obs = df.select("id", F.lit(datetime(2024, 1, 4)).alias("time"), "latitude", "longitude", "depth")
    matched = class4.match_forecasts(obs, df.select("first_day").distinct(), 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for f in (class4.sample_spline, class4.sample_bracket):
            f(matched, levels, "v", axis, axis, depth, ["id", "first_day"]).explain("codegen")
        class4.bilinear(matched, levels, "v", axis, axis, ["id", "first_day"]).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x.split(";")[0]) for x in capsys.readouterr().out.split("maxMethodCodeSize:")[1:]]
    assert len(sizes) > 10 and max(sizes) < 8000
