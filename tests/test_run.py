"""The stages from files to ranked regions, on small files with known answers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loadweave import __main__ as cli
from loadweave.plans import run as runs
from loadweave.plans import stages
from loadweave.sources import made


@pytest.fixture(scope="module")
def settings(tmp_path_factory):
    home = tmp_path_factory.mktemp("files")
    towns = [(f"1111010{i}00", f"Seoul Jung Town{i}") for i in range(1, 5)]
    (home / "regions.csv").write_text("code,name,status\n1100000000,Seoul,\n1111000000,Seoul Jung,\n" + "".join(f"{c},{n},\n" for c, n in towns))
    lines, hours = ["period,hour,kwh,cust,province,district,town"], ["code,period,hour,kwh"]
    for i, (code, _) in enumerate(towns, 1):
        for month in range(1, 13):
            for hour in range(24):
                lines.append(f"2024{month:02d},{hour},{100 + (50 * i if hour == 19 else 0)},{3 if i == 4 else 20},Seoul,Jung,Town{i}")
        for day in range(120):
            date = dt.date(2024, 9, 1) + dt.timedelta(days=day)
            for hour in range(24):
                load = 10 + hour % 5 + (i if hour == 19 else 0) + (6 if i == 2 and day > 100 else 0)
                hours.append(f"{code},{date:%Y%m%d},{hour},{load}")
    (home / "use.csv").write_text("\n".join(lines) + "\n2024,1,5,1,Seoul,Jung,Town1\n202401,1,7,1,Nowhere,None,Town9\n")
    (home / "hours.csv").write_text("\n".join(hours) + "\n")
    (home / "stations.csv").write_text("station,lat,lon,fast,slow\ns1,37.50,127.00,2,1\ns2,37.51,127.00,,4\nbad,,127.0,1,1\n")
    (home / "places.csv").write_text("code,lat,lon\n" + "".join(f"{c},{37.50 + 0.01 * k},127.00\n" for k, (c, _) in enumerate(towns)))
    (home / "ev.csv").write_text("code,ev\n" + "".join(f"{c},{10 * (k + 1)}\n" for k, (c, _) in enumerate(towns)))
    paths = {"regions": "regions.csv", "consumption": "use.csv", "hourly": "hours.csv", "stations": "stations.csv", "places": "places.csv", "registered": "ev.csv"}
    return {"paths": {k: f"{home}/{v}" for k, v in paths.items()}, "evaluation_days": 14, "calibration_days": 42, "validation_days": 14, "training_days": 40, "window": ["2024-06", "2024-09"], "draws": 3, "forecast": {"rounds": 2, "depth": 2, "at_least": 30}, "battery": {"candidates": [[0, 0], [14, 40]]}}


def test_all_stages(spark, settings, tmp_path):
    wanted = "regions cube customers match_rates load_types months activations hourly hour_panel forecasts metrics surges places stations points access priority headline detail".split()
    done = runs.run(spark, settings, f"{tmp_path}/out", only=wanted)
    assert done["status"] == "done", done["stages"]
    states = {e["stage"]: e["status"] for e in done["stages"]}
    assert states == dict.fromkeys(wanted, "done")
    tables = done["tables"]
    got = {r["code"]: r for r in tables["load_types"].collect()}
    assert len(got) == 4 and all(r["peak_hour"] == 19 for r in got.values()) and got["1111010400"]["load_type"] == "high" and got["1111010100"]["load_type"] == "low"
    surges = {r["code"]: r["surge_risk"] for r in tables["surges"].where("multiplier = 1.2").collect()}
    assert len(surges) == 4 and tables["priority"].where("rank = 1").count() == 1
    assert tables["matching"].first()["unmatched"] == pytest.approx(0.2)
    # The region with few customers has no figures in the export.
    out = spark.read.csv(f"{tmp_path}/out/export/load_types", header=True)
    assert [r["concentration"] is None for r in out.orderBy("code").collect()] == [False, False, False, True]
    assert spark.read.csv(f"{tmp_path}/out/inside/stages", header=True).count() == len(states)
    # The tables are the exact ones, with a folder or without; a second run reads what stands.
    plain = runs.run(spark, settings, only=["regions", "cube", "load_types"])["tables"]["load_types"]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, tables["load_types"].collect()))
    wanted = ["regions", "cube", "customers", "load_types", "months"]
    again = runs.run(spark, settings, f"{tmp_path}/out", resume=True, only=wanted)
    assert [e["status"] for e in again["stages"]] == ["kept"] * 5 and sorted(map(tuple, again["tables"]["load_types"].collect())) == sorted(map(tuple, plain.collect()))
    other = runs.run(spark, {**settings, "weeks": 3}, f"{tmp_path}/out", resume=True, only=wanted)
    assert [e["status"] for e in other["stages"]] == ["done"] * 5


def test_a_failure_at_execution_is_the_stages_own(spark, tmp_path):
    held = stages.Stages(stages.Store(spark, f"{tmp_path}/store"))
    late = lambda: spark.range(3).select(F.raise_error(F.lit("late")).alias("x"))
    assert held.run(stages.Stage("bad", late)) is None and held.run(stages.Stage("good", lambda: {"good": spark.range(2), "more": spark.range(4)})).count() == 2
    assert [(e["stage"], e["status"]) for e in held.log] == [("bad", "skipped"), ("good", "done")] and held.log[0]["error"] and held.results["more"].count() == 4
    with pytest.raises(Exception, match="late"):
        held.run(stages.Stage("worst", late, critical=True))
    assert held.log[-1]["status"] == "failed"
    # What was half written isn't taken for a table.
    resumed = stages.Stages(stages.Store(spark, f"{tmp_path}/store"), resume=True)
    assert resumed.run(stages.Stage("bad", late)) is None and resumed.run(stages.Stage("good", late)).count() == 2
    assert [e["status"] for e in resumed.log] == ["skipped", "kept"] and resumed.results["more"].count() == 4


def test_whole_run_on_made_up_files(spark, tmp_path):
    paths = made.Made(spark).write(f"{tmp_path}/in", ("2025-08-15", "2025-12-31"))
    (tmp_path / "holidays.json").write_text(json.dumps({"2025-10-03": "holiday", "2025-12-25": "holiday"}))
    (tmp_path / "weather.csv").write_text("ts,station,observed,forecast,issued_at\n" + "".join(f"2025-12-{d:02d} 12:00:00,s,{d}.5,{d},2025-12-{d - 1:02d} 17:00:00\n" for d in range(2, 30)))
    (tmp_path / "heights.csv").write_text("lat,lon,elev\n" + "".join(f"{37.48 + 0.001 * i:.3f},{126.95 + 0.001 * j:.3f},{i + j}\n" for i in range(70) for j in range(90)))
    (tmp_path / "history.csv").write_text("code,ym,ev,fuel\n" + "".join(f"11110{(u + 101) * 100:05d},{y}12,{40 + 5 * u + 20 * (y - 2022)},\n" for u in range(30) for y in (2022, 2025)))
    paths |= {"holidays": f"{tmp_path}/holidays.json", "weather": f"{tmp_path}/weather.csv", "elevations": f"{tmp_path}/heights.csv", "registered_history": f"{tmp_path}/history.csv", "part": paths["consumption"]}
    settings = {
        "paths": paths, "window": ["2025-03", "2025-08"], "evaluation_days": 14, "validation_days": 14, "training_days": 60, "calibration_days": 42, "draws": 5, "forecast": {"rounds": 2, "depth": 2, "at_least": 100},
        "industries": {"wait": ["A"], "control": ["B"], "placebo": ["B:04"]}, "names": {"서울특별시": "서울"}, "battery": {"most_regions": 3, "candidates": [[0, 0], [14, 40]]}, "multipliers": [1.1, 1.2],
    }
    done = runs.run(spark, settings, f"{tmp_path}/out")
    states = {e["stage"]: e["status"] for e in done["stages"]}
    assert {s: e for s, e in states.items() if e != "done"} == {} and len(states) > 50 and done["status"] == "done"
    tables = done["tables"]
    found = {r["code"]: r["g"] for r in tables["units"].collect()}
    assert sum(g is not None for g in found.values()) == 18 and tables["activations"].count() == 30
    tau = tables["effects"].where("k between 0 and 4").agg(F.avg("tau")).first()[0]
    assert tau == pytest.approx(made.Made(spark).regions().where("role = 'treated'").agg(F.avg("tau")).first()[0], abs=0.03)
    assert tables["holidays"].count() == 2 and tables["sales_quality"].first()["distances_seen"] == ["1", "2", "3", "4", "9"]
    assert spark.read.csv(f"{tmp_path}/out/inside/sales_quality", header=True).first()["distances_seen"] == "1;2;3;4;9"
    held = runs.Run(spark, settings)
    held.runner.results |= tables
    known = runs.measured(held)
    assert known["n_distance_codes"] == 5 and known["unmatched_share"] == 0 and known["mde"] > 0 and known["individual_ids"] in (0.0, 1.0) and known["usable_forecasts"] == 1 and len(known) >= 16
    assert tables["homes"].count() == 40 and tables["priority"].where("rank = 1").count() == 1 and tables["battery_runs"].where("mode = 'compare'").count() > 0
    exported = spark.read.csv(f"{tmp_path}/out/export/vehicle_regions", header=True)
    assert "lat" not in exported.columns


def test_parts_and_missing_inputs(spark, settings):
    first = runs.run_first_part(spark, settings)
    assert first["status"] == "done" and "surges" not in first["tables"]
    some = {**settings, "paths": {k: v for k, v in settings["paths"].items() if k in ("regions", "consumption")}}
    done = runs.run(spark, some)
    states = {e["stage"]: e["status"] for e in done["stages"]}
    assert done["status"] == "done" and states["hourly"] == "left out" == states["access"] and states["surges"] == "done"
    broken = {**settings, "paths": {**settings["paths"], "consumption": "/nowhere/at/all.csv"}}
    assert runs.run(spark, broken)["status"] == "failed"


def test_preflight_and_seasons(spark, settings):
    got = {r["check"]: r["verdict"] for r in runs.preflight(spark, settings).collect()}
    assert len(got) == 21 and got["activation candidates"] == "fail" and got["unmatched towns"] == "warn" and got["seasons covered"] == "warn" and got["fonts"] == "n.a."
    rows = {r["window"]: r for r in runs.run_seasons(spark, settings, "2024-12-10", 2, 1, 2).collect()}
    assert set(rows) == {"2024-12-10", "2024-11-10", None} and rows["2024-11-10"]["shared"] == 2


def test_command_line(spark, settings, tmp_path, capsys):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps(settings))
    assert cli.main(["--settings", str(path), "--first-part"]) == 0 and "load_types: done" in capsys.readouterr().out
    assert cli.main(["--settings", str(path), "--vehicles"]) == 0 and "vehicles: left out" in capsys.readouterr().out
