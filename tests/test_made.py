"""Made-up inputs: planted changes and effects are found again."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loadweave.functions import projection
from loadweave.operators import causal, cube, sales
from loadweave.sources import facts, made


@pytest.fixture(scope="module")
def regions(spark):
    return made.Made(spark).regions().cache()


def test_all_changes_are_found(spark, regions):
    rows = made.Made(spark).consumption().join(regions.select("town", "code"), "town")
    days = rows.select("code", (F.substring("period", 1, 4).cast("int") * 12 + F.substring("period", 5, 2).cast("int") - 1).alias("mi"), F.substring("period", 9, 2).cast("int").alias("hour"), F.lit(1).alias("days"), "kwh", "cust")
    months = cube.daily_series(cube.hour_cube(days, ["code", "mi", "hour"]))
    window = (2025 * 12 + 2, 2025 * 12 + 7)
    found = {r["code"]: r for r in causal.activations(months, window, window[0] - 12).collect()}
    want = {r["code"]: (r["role"], r["adoption"]) for r in regions.collect()}
    assert sum(role == "treated" for role, _ in want.values()) == 18
    names = {"treated": "treated", "before": "excluded_prior", "after": "excluded_late", "never": "never_treated"}
    assert {c: (r["status"], r["t_mi"]) for c, r in found.items()} == {c: (names[role], g) for c, (role, g) in want.items()}


def test_effect_and_scan(spark, regions):
    raw = made.Made(spark).sales()
    typed = sales.typed_sales(raw, ["A"], ["B"], ["B:04"], provinces=["11"])
    scan = sales.scanned(typed, [2025 * 12, 2025 * 12 + 1])
    assert scan._jdf.queryExecution().executedPlan().toString().count("Range") <= 2  # one read of the rows
    scan = scan.cache()
    cells = sales.cells(scan)
    plain = typed.where("group <> 'other' and origin <> 'unknown'")
    want = {tuple(r[:4]): tuple(r[4:]) for r in causal.sales_cells(plain, ["code", "mi", "group", "origin"], F.col("value"), F.col("masked")).collect()}
    assert {tuple(r[:4]): tuple(r[4:]) for r in cells.collect()} == want and len(want) == 30 * 12 * 3 * 2
    shot = {(r["code"], r["mi"], r["sex"]): r["value"] for r in sales.snapshot(scan, "sex").collect()}
    mine = typed.where(f"mi in ({2025 * 12}, {2025 * 12 + 1})").groupBy("code", "mi", "sex").agg(F.sum("value").alias("v")).collect()
    assert shot == {(r["code"], r["mi"], r["sex"]): r["v"] for r in mine}
    stats = sales.quality(scan).first()
    assert stats["rows"] == raw.count() == 30 * 12 * 8 * 5 * 4 and 0.02 < stats["mask_rate"] < 0.03 and stats["distances_seen"] == ["1", "2", "3", "4", "9"] and stats["unknown_origin_rows"] == stats["rows"] // 5
    panel = causal.double_difference(cells, ["code", "mi"], sales.outcome_parts()).cache()
    units = regions.where("role in ('treated', 'never')").select("code", F.when(F.col("role") == "treated", F.col("adoption")).alias("g"))
    study = causal.event_study(causal.att_gt(panel, units))
    post = study.where("k between 0 and 4").agg(F.avg("tau")).first()[0]
    planted = regions.where("role = 'treated'").agg(F.avg("tau")).first()[0]
    assert 0.05 < planted < 0.35
    assert post == pytest.approx(planted, abs=0.03) and all(abs(r["tau"]) < 0.04 for r in study.where("k < -1").collect())


def test_values_are_independent_of_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = sorted(map(tuple, made.Made(spark, 5, 7).stations(20).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert sorted(map(tuple, made.Made(spark, 5, 7).stations(20).collect())) == one and one != sorted(map(tuple, made.Made(spark, 5, 8).stations(20).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_facts_are_read_once(spark, tmp_path):
    path = tmp_path / "use.csv"
    path.write_text("period,kwh\n2025010101,1\n2025010201,2\n")
    held = facts.Facts(spark, f"{tmp_path}/facts")
    reads = []

    def make():
        reads.append(1)
        return spark.createDataFrame([(len(path.read_text()),)], "n int")

    assert [held.known(str(path), "size", make).first()[0] for _ in range(2)] == [37, 37] and len(reads) == 1
    assert held.known(str(path), "size", make, other=1).first()[0] == 37 and len(reads) == 2
    dates = [r["date"] for r in held.observed_dates(str(path), "period").orderBy("date").collect()]
    assert dates == [dt.date(2025, 1, 1), dt.date(2025, 1, 2)] and held.rows(str(path)) == 3
    # A known fact needs the file's state alone: its content may even be unreadable.
    path.write_text("period,kwh\n2025010101,1\n2025010301,2\n2025010401,2\n")
    assert held.known(str(path), "size", make).first()[0] == 50 and len(reads) == 3
    assert held.observed_dates(str(path), "period").count() == 3
    assert held.forget(str(path), (("size", {}),)) == 5 and held.known(str(path), "size", make).first()[0] == 50 and len(reads) == 3


KOREA = 'PROJCS["Korea 2000 / Central Belt 2010",GEOGCS["Korea 2000",DATUM["Geocentric_datum_of_Korea",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",38],PARAMETER["central_meridian",127],PARAMETER["scale_factor",1],PARAMETER["false_easting",200000],PARAMETER["false_northing",600000],UNIT["metre",1]]'
UTM = 'PROJCRS["WGS 84 / UTM zone 31N",BASEGEOGCRS["WGS 84",DATUM["World Geodetic System 1984",ELLIPSOID["WGS 84",6378137,298.257223563,LENGTHUNIT["metre",1]]]],CONVERSION["UTM zone 31N",METHOD["Transverse Mercator"],PARAMETER["Latitude of natural origin",0,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Longitude of natural origin",3],PARAMETER["Scale factor at natural origin",0.9996],PARAMETER["False easting",500000],PARAMETER["False northing",0]],CS[Cartesian,2],LENGTHUNIT["metre",1]]'


def test_projections_from_text(spark):
    grid = projection.grid_of(KOREA)
    assert (grid.lat0, grid.lon0, grid.fe, grid.fn) == (38, 127, 200000, 600000)
    x, y = spark.range(1).select(*grid.forward(F.lit(38.0), F.lit(127.0))).first()
    assert (x, y) == pytest.approx((200000, 600000), abs=1e-6)
    # A quarter of a degree of the meridian, by Simpson's rule over its radius of curvature.
    e2 = grid.f * (2 - grid.f)
    radius = lambda p: grid.a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    steps = [math.radians(37.75 + 0.25 * i / 100) for i in range(101)]
    arc = sum(radius(p) * (1 if i in (0, 100) else 4 if i % 2 else 2) for i, p in enumerate(steps)) * (steps[1] - steps[0]) / 3
    assert spark.range(1).select(grid.forward(F.lit(37.75), F.lit(127.0))[1]).first()[0] == pytest.approx(600000 - arc, abs=1e-3)
    utm = projection.grid_of(UTM)
    assert (utm.k0, utm.lon0, round(1 / utm.f, 6)) == (0.9996, 3, 298.257224)
    x, y = spark.range(1).select(*utm.forward(F.lit(48.8582), F.lit(2.2945))).first()
    assert (x, y) == pytest.approx((448251.8, 5411932.7), abs=1.0)
    degrees = projection.grid_of('GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]]]')
    assert not degrees.projected and spark.range(1).select(*degrees.forward(F.lit(1.0), F.lit(2.0))).first()[:] == (2.0, 1.0)
    feet = projection.grid_of(KOREA.replace('UNIT["metre",1]', 'UNIT["foot",0.3048]'))
    assert spark.range(1).select(feet.forward(F.lit(37.75), F.lit(127.0))[1]).first()[0] == pytest.approx(600000 - arc / 0.3048, abs=1e-2)
    for bad in ("", "PROJCS[", KOREA.replace("Transverse_Mercator", "Mercator_1SP"), 'PROJCS["x"]', "A[1]]"):
        with pytest.raises(ValueError):
            projection.grid_of(bad)
