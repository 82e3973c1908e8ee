"""From files to ranked regions: settings in, stages run in order, tables stored exactly and written, rounded, for export.

Settings (JSON, merged over ``DEFAULTS``): paths and columns of the inputs, and parameters.  A stage whose
input isn't given is left out; what fails, unless it is critical, is noted and the rest goes on.  Every stage's
tables are stored as Parquet before the next one reads them; CSV files for the inside and for export are written
from these and never read again.
"""

from __future__ import annotations

import datetime as dt
import importlib.util
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.stored import shared_folder
from ..operators import battery, causal, cube, inputs, keys, models, priority, publish, quantile_trees, risk, sales, scenario, sessions, spatial, two_level
from ..operators import timeseries as ts
from ..sources import csv, facts, files
from . import stages
from .stages import Stage

DEFAULTS: dict[str, Any] = {
    "paths": {},
    "columns": {
        "consumption": {"period": "period", "hour": "hour", "kwh": "kwh", "cust": "cust", "province": "province", "district": "district", "town": "town"},
        "part": {"period": "period", "hour": "hour", "kwh": "kwh", "cust": "cust", "province": "province", "district": "district", "town": "town"},
        "hourly": {"code": "code", "period": "period", "hour": "hour", "kwh": "kwh"},
        "regions": {"code": "code", "name": "name", "status": "status"},
        "stations": {"station": "station", "lat": "lat", "lon": "lon", "fast": "fast", "slow": "slow"},
        "places": {"code": "code", "lat": "lat", "lon": "lon"},
        "registered": {"code": "code", "ev": "ev"},
        "registered_history": {"code": "code", "ym": "ym", "ev": "ev", "fuel": "fuel"},
        "sales": {c: c for c in ("ym", "sido", "sgg", "umd", "bidvs", "medvs", "dist", "metric", "tizo", "sex", "age", "income")},
        "stocks": {"code": "code", "mi": "mi", "stock": "stock"},
        "vehicles": {"vehicle": "vehicle", "ts": "ts", "lat": "lat", "lon": "lon", "charging": "charging", "soc": "soc"},
        "weather": {"ts": "ts", "station": "station", "observed": "observed", "forecast": "forecast", "issued_at": "issued_at"},
        "elevations": {"lat": "lat", "lon": "lon", "elev": "elev"},
        "prices": {"ts": "ts", "price": "price"},
    },
    "names": {},
    "provinces": [],
    "bands": {"night": [0, 1, 2, 3, 4, 5], "morning": [6, 7, 8, 9], "day": [10, 11, 12, 13, 14, 15, 16], "evening": [17, 18, 19, 20, 21, 22, 23]},
    "window": None,
    "lookback": None,
    "weeks": 4,
    "evaluation_start": None,
    "evaluation_days": 28,
    "validation_days": 28,
    "training_days": 120,
    "calibration_days": 84,
    "forecast": {"rounds": 20, "depth": 3, "rate": 0.3, "least": 20, "at_least": 100},
    "multipliers": [1.1, 1.2, 1.3],
    "multiplier": 1.2,
    "industries": {"wait": [], "control": [], "placebo": []},
    "industry_reference": "control_ref",
    "most_masked": 0.5,
    "draws": 50,
    "vehicle": {"gap_minutes": 15.0, "cell_m": 250.0, "eps_m": 150.0, "least": 3, "days": 3, "away_km": 1.0},
    "battery": {"candidates": [list(p) for p in battery.CANDIDATES], "new_chargers": [0, 3], "utilization": 0.1, "charger_kw": 7.0, "most_regions": 30, "least_days": 14, "most_bias": 0.2},
    "scenario": {"base": None, "months": 36, "years": [2030], "factors": {"low": 0.5, "mid": 1.0, "high": 1.5}, "betas": {"low": 0.8, "main": 1.0, "high": 1.2}},
    "radius_km": 2.0,
    "virtual_chargers": 4.0,
    "w_risk": 0.5,
    "confirmed": [],
    "least_customers": 5,
    "digits": 6,
}


#: Raised when what a stage makes of the same inputs changes, so that tables of earlier code aren't taken for its own.
FORM = 1


class Run:
    """Stages over one set of settings; every stage's tables are in ``results``."""

    def __init__(self, spark: SparkSession, settings: dict[str, Any], out: str | None = None, resume: bool = False):
        self.spark, self.settings, self.out = spark, stages.merged(DEFAULTS, settings), out
        folder = f"{out.rstrip('/')}/store" if out else f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self.runner = stages.Stages(stages.Store(spark, folder), resume)

    @property
    def results(self) -> dict[str, DataFrame]:
        return self.runner.results

    def source(self, name: str, required: tuple[str, ...] = ()) -> DataFrame:
        path = files.one_csv(self.spark, self.settings["paths"][name])
        wanted = self.settings["columns"][name]
        return csv.read_columns(self.spark, path, wanted, required)

    def given(self, *names: str) -> bool:
        return all(self.settings["paths"].get(n) for n in names)

    def state(self, name: str) -> Any:
        """Length and time of change of an input; the path itself where it can't be found (its stage fails, then)."""
        path = self.settings["paths"][name]
        try:
            return facts.state_of(self.spark, path)
        except Exception:
            return path

    def run(self, stage: Stage) -> DataFrame | None:
        """Runs a stage where its inputs are given and the stages before it gave a table; publishes it where there is a folder."""
        if not self.given(*stage.needs) or any(self.results.get(a) is None for a in stage.after):
            self.runner.left_out(stage)
            return None
        settings = {k: v for k, v in self.settings.items() if k != "paths"}
        table = self.runner.run(stage, [FORM, settings, {n: self.state(n) for n in stage.needs}])
        if table is not None and self.out is not None and stage.title:
            try:
                files.write_table(table, self.out, stage.name, stage.title, digits=self.settings["digits"], exported=self.exported(table))
            except Exception as error:  # the table stands; only its files are missing
                self.runner.log[-1] |= {"error": type(error).__name__, "status": "not published"}
        return table

    def exported(self, table: DataFrame) -> DataFrame:
        """The table without the numbers of regions with few customers, where customers are known."""
        counts = self.results.get("customers")
        if counts is None or "code" not in table.columns:
            return table
        hide = [f.name for f in table.schema.fields if f.dataType.typeName() == "double"]
        return publish.export_pair(table, counts, self.settings["least_customers"], hide)[1]

    # consumption
    def cube_of_regions(self, master: DataFrame, source: str = "consumption") -> dict[str, DataFrame]:
        s = self.settings
        named = files.cube_of_file(self.spark, s["paths"][source], s["columns"][source], provinces=s["provinces"], names=s["names"])
        matched = keys.match_regions(named, master, s["names"])
        joined = named.join(matched.where("code is not null"), ["province", "district", "town"])
        return {"cube": joined.groupBy("code", "mi", "hour").agg(F.sum("kwh").alias("kwh"), F.max("n_days").alias("n_days"), F.sum("cust_sum").alias("cust_sum"), F.min("cust_min").alias("cust_min")), "matching": keys.match_rates(matched, named)}

    def channels(self, master: DataFrame, whole: DataFrame) -> dict[str, DataFrame]:
        part = self.cube_of_regions(master, "part")["cube"]
        on = ["code", "mi", "hour"]
        return {"channels": cube.ratio_table(cube.channel_ratio(part, whole, on), ["hour"]), "channel_within": cube.containment(part, whole, on)}

    def window(self) -> tuple[tuple[int, int], int] | None:
        s = self.settings
        if not s["window"]:
            return None
        window = tuple(month_of(x) for x in s["window"])
        return window, month_of(s["lookback"]) if s["lookback"] else window[0] - 12

    # vehicles
    def vehicles(self) -> DataFrame:
        path = files.one_csv(self.spark, self.settings["paths"]["vehicles"])
        return files.vehicle_log(self.spark, path, self.settings["columns"]["vehicles"])

    def sessions(self, log: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
        v = self.settings["vehicle"]
        found = sessions.sessions(log, ["vehicle"], F.col("charging"), v["gap_minutes"]).withColumn("id", F.concat_ws(" ", "vehicle", "session"))
        near = spatial.nearest_small(found, places, "id", "code")
        bases = sessions.base_sessions(found, "vehicle", v["eps_m"], v["least"], v["days"]).select("vehicle", "session", "is_base")
        held = found.join(near.select("id", "code"), "id").join(bases, ["vehicle", "session"], "left").withColumn("is_base", F.coalesce("is_base", F.lit(False))).drop("id")
        return {"sessions": held, "session_histogram": sessions.session_histogram(found), "session_lengths": sessions.duration_summary(found), "charge_bands": sessions.soc_bands(found)}

    def homes(self, log: DataFrame) -> DataFrame:
        """vehicle, lat, lon of its home: the middle of its records there."""
        celled = sessions.with_cell(log.where("lat is not null"), self.settings["vehicle"]["cell_m"])
        homes = sessions.home_cells(celled, "vehicle", "cell")
        return celled.join(homes, ["vehicle", "cell"]).groupBy("vehicle").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))

    def shape(self, found: DataFrame) -> DataFrame:
        return sessions.charging_shape(sessions.occupancy(found), self.settings["vehicle"]["least"], found.count())

    # sales and effects
    def sales(self) -> dict[str, DataFrame]:
        i, window = self.settings["industries"], self.window()
        typed = sales.typed_sales(self.source("sales", ("ym", "umd", "metric")), i["wait"], i["control"], i["placebo"])
        months = [window[0][0] - 1] if window else []
        models.refuse_late_snapshots(months, window[0][0] if window else 0)
        return {"sales": sales.scanned(typed, months)}

    def units(self, found: DataFrame) -> DataFrame:
        """code, g (NULL: never adopted) of the regions that enter the comparison."""
        return found.where("status in ('treated', 'never_treated')").select("code", F.when(F.col("status") == "treated", F.col("t_mi")).cast("int").alias("g"))

    def panel(self, scan: DataFrame, units: DataFrame, main: str = "wait") -> DataFrame:
        reference = self.settings["industry_reference"]
        found = causal.double_difference(sales.cells(scan), ["code", "mi"], sales.outcome_parts(main, reference), self.settings["most_masked"])
        return found.join(units.select("code"), "code", "left_semi")

    def effects(self, panel: DataFrame, units: DataFrame) -> dict[str, DataFrame]:
        return {"effects": causal.event_study_bootstrap(panel, units, self.settings["draws"]), "effects_by_cohort": causal.att_gt(panel, units)}

    def placebo(self, panel: DataFrame, scan: DataFrame, units: DataFrame) -> dict[str, DataFrame]:
        draws = self.settings["draws"]
        none = self.panel(scan, units, "placebo")
        real, placebo = (causal.event_study_draws(p, units, draws) for p in (panel, none))
        return {"placebo": causal.event_study_bootstrap(none, units, draws), "discounted": causal.discounted(real, placebo), "placebo_verdict": causal.placebo_verdict(real, placebo)}

    def least_effect(self, panel: DataFrame, scan: DataFrame, units: DataFrame) -> DataFrame:
        return causal.least_detectable_of_all(panel, self.panel(scan, units, "placebo"), units, self.settings["draws"])

    def stocks(self, units: DataFrame) -> DataFrame:
        raw = self.source("stocks", ("code", "mi", "stock"))
        rates = causal.stock_rates(raw.select(expr.clean_code("code", 10).alias("code"), F.col("mi").try_cast("int").alias("mi"), expr.to_number("stock").alias("stock")))
        return causal.contamination(rates, units)

    def unit_features(self, changes: DataFrame, scan: DataFrame) -> DataFrame:
        """Changes of units with the shares of waiting and outside sales before the window; nothing of their load."""
        share = lambda by, label, name: inputs.shares_within(sales.snapshot(scan, by), "code", by, "value").where(F.col(by) == label).select("code", F.col("share").alias(name))
        return priority.attached(changes, [share("group", "wait", "wait_share"), share("origin", "outsider", "outsider_share")])

    def heterogeneity(self, rows: DataFrame) -> dict[str, DataFrame]:
        features = [c for c in rows.columns if c not in ("code", "treated", "delta")]
        models.refuse_load_features(features)
        shown, slope, groups = models.heterogeneity(rows, features, groups=2, trees=20)
        return {"heterogeneity": shown, "heterogeneity_slope": slope, "heterogeneity_groups": groups}

    def quadrants(self, loads: DataFrame, changes: DataFrame) -> DataFrame:
        both = loads.join(changes.where("treated").select("code", F.col("delta").alias("effect")), "code")
        return cube.quadrants(both, "concentration", "effect", cube.cut_of(loads, "concentration"), 0.0)

    # access
    def points(self, places: DataFrame) -> DataFrame:
        registered = self.source("registered", ("code", "ev")).select(expr.clean_code("code", 10).alias("code"), expr.to_number("ev").alias("ev"))
        return inputs.demand_points(places, registered)

    def access(self, chargers: DataFrame, points: DataFrame) -> DataFrame:
        known = points.select("code", F.col("ev").isNotNull().alias("access_known"))
        return spatial.catchment(chargers.select("station", "lat", "lon", "chargers"), points, self.settings["radius_km"]).join(known, "code")

    def slopes(self, chargers: DataFrame, points: DataFrame, access: DataFrame) -> DataFrame:
        known = self.source("elevations", ("lat", "lon", "elev"))
        known = known.select(*[expr.to_number(c).alias(c) for c in ("lat", "lon", "elev")])
        high = spatial.with_elevation(points, known)[0]
        up = spatial.with_elevation(chargers, known)[0].withColumnRenamed("elev", "elev_station")
        steep = spatial.catchment(up.select("station", "lat", "lon", "chargers", "elev_station"), high, self.settings["radius_km"], spatial.slope_distance())
        return risk.correlations(access.select("code", F.col("access").alias("level")).join(steep.select("code", F.col("access").alias("steep")), "code"), "level", "steep")

    def chargers_per_vehicle(self, stock: DataFrame, points: DataFrame) -> DataFrame:
        rows = points.join(stock, "code").where("chargers > 0 and ev is not null")
        return risk.top_to_bottom_multiple(rows.withColumn("per_charger", F.col("ev") / F.col("chargers")), "per_charger")

    # hours
    def days(self, hourly: DataFrame) -> tuple[dt.date, dt.date, dt.date]:
        """First day of calibration, first and last day of evaluation: by default the last days there are."""
        s = self.settings
        start = dt.date.fromisoformat(s["evaluation_start"]) if s["evaluation_start"] else dt.date.fromisoformat(stages.evaluation_window(str(hourly.agg(F.max("date")).first()[0]), s["evaluation_days"])[0])
        return start - dt.timedelta(days=s["calibration_days"]), start, start + dt.timedelta(days=s["evaluation_days"] - 1)

    def periods(self, hourly: DataFrame) -> two_level.Periods:
        _, start, last = self.days(hourly)
        before = lambda n: (start - dt.timedelta(days=n)).isoformat()
        return two_level.Periods(before(self.settings["validation_days"] + 1), before(1), last.isoformat())

    def calibration(self, hourly: DataFrame) -> DataFrame:
        first, start, _ = self.days(hourly)
        rows = hourly.where(F.col("date").between(F.lit(first), F.lit(start - dt.timedelta(days=1))))
        return rows.groupBy("code").agg(F.max("kw").alias("calib_peak_kw"), F.avg("kw").alias("mean_kw"))

    def panel_of_hours(self, hourly: DataFrame, holidays: DataFrame | None) -> DataFrame:
        p, s = self.periods(hourly), self.settings
        first = dt.date.fromisoformat(p.train_to) - dt.timedelta(days=s["training_days"])
        return two_level.hourly_panel(hourly, holidays, weeks=s["weeks"]).where(F.col("date").between(F.lit(first), F.lit(p.last).cast("date")))

    def backtest(self, hourly: DataFrame) -> DataFrame:
        """By region: the baseline's errors on the calibration's days, beside yesterday's."""
        first, start, _ = self.days(hourly)
        based = ts.baseline(hourly, self.settings["weeks"])
        held = ts.with_day(based).withColumn("lag1", ts.calendar_lag("kw", 1, ["code", "hour"]))
        held = held.where(F.col("date").between(F.lit(first), F.lit(start - dt.timedelta(days=1))))
        own = ts.backtest(held)
        naive = held.where("baseline_kw is not null").groupBy("code").agg(F.avg(F.abs(F.col("kw") - F.col("lag1"))).alias("mae_yesterday"))
        return own.join(naive, "code", "left")

    def forecasts(self, panel: DataFrame) -> DataFrame:
        """actual, baseline and yesterday's value of the evaluation days, with a median and an upper quantile of models of their own."""
        f, p = self.settings["forecast"], self.periods(panel)
        train = panel.where(p.of().isin("train", "valid"))
        features = models.usable_features(train, ["lag1", "lag2", "lag7", "lag14", "roll7", "baseline_kw", "level", "week_peak", "trend", "hour", "dow", "holiday"])
        if train.where("kw is not null").limit(f["at_least"]).count() < f["at_least"]:
            raise ValueError(f"at least {f['at_least']} training rows are needed")
        options = {k: f[k] for k in ("rounds", "depth", "rate", "least")}
        m50, m90 = quantile_trees.fit_many(train, "kw", features, [quantile_trees.Options(tau=tau, **options) for tau in (0.5, 0.9)])
        rows = panel.where(p.of() == "eval").withColumn("q50", F.greatest(m50.prediction(), F.lit(0.0)))
        return rows.select("code", "date", "hour", F.col("kw").alias("actual_kw"), "baseline_kw", "lag1", "q50", F.greatest(m90.prediction(), "q50").alias("q90"))

    def kept(self):
        """Stores the tables that models read again and again, beside those of stages."""
        store = self.runner.store
        return lambda df: store.keep(df, store.path("part", uuid.uuid4().hex))

    def two_level(self, panel: DataFrame, hourly: DataFrame) -> dict[str, DataFrame]:
        found = two_level.forecast(panel, self.periods(hourly), store=self.kept(), **self.settings["forecast"])
        calib, ahead = self.calibration(hourly), found.peaks.where("period = 'eval'")
        grid = self.grid()
        alerts = risk.alert_table(ahead.withColumn("actual_peak", F.col("kw")), calib, grid, {"yesterday": "day_peak", "baseline": "base_peak", "ai": "q90c"})
        return {
            "two_level": found.metrics(), "peak_alerts": alerts, "peak_forecasts": ahead.select("code", "date", "kw", "q50", "q90", "q90c", "raised"),
            "predicted_ratios": two_level.predicted_ratios(ahead.select("code", "date", "q50", F.col("q90c").alias("q90")), calib),
        }

    def grid(self) -> DataFrame:
        return self.spark.createDataFrame([(float(m),) for m in self.settings["multipliers"]], "multiplier double")

    def surges(self, pred: DataFrame, hourly: DataFrame) -> DataFrame:
        return risk.surge_risk(risk.day_peaks(pred), self.calibration(hourly), self.grid()).withColumn("peak_ratio", F.col("mean_q90_peak_ratio"))

    def monthly_surges(self, held: DataFrame) -> DataFrame:
        last = held.agg(F.max("mi")).first()[0]
        return cube.monthly_risk(held, self.grid(), last).withColumn("peak_ratio", F.col("peak_ratio_observed"))

    # batteries
    def battery_runs(self, hourly: DataFrame, targets: DataFrame, backtest: DataFrame, panel: DataFrame, pred: DataFrame | None) -> dict[str, DataFrame]:
        b = self.settings["battery"]
        first, start, last = self.days(hourly)
        chosen = targets.where(F.col("place") <= b["most_regions"]).select("code")
        between = lambda df, a, z: df.where(F.col("date").between(F.lit(a), F.lit(z)))
        series = lambda df, c: df.groupBy("code", "date").agg(F.count(c).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("hour", c))), lambda x: x[c]).alias(c)).where("n = 24").drop("n")  # noqa: E731  (24 values)
        own = hourly.join(chosen, "code", "left_semi")
        history = series(between(own, first, start - dt.timedelta(days=1)), "kw").select("code", F.col("kw").alias("load"))
        days = series(between(own, start, last), "kw").withColumnRenamed("kw", "actual")
        days = days.join(series(between(panel, start, last), "baseline_kw").withColumnRenamed("baseline_kw", "base"), ["code", "date"], "left")
        if pred is not None:
            for q, name in (("q50", "p50"), ("q90", "p90")):
                days = days.join(series(pred, q).withColumnRenamed(q, name), ["code", "date"], "left")
        if self.given("prices"):
            hours = csv.prices(self.source("prices", ("ts", "price"))).select(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "price")
            daily = hours.groupBy("date").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("hour", "price"))), lambda x: x["price"]).alias("price")).where("n = 24").drop("n")
            days = days.join(daily, "date", "left")
        calib = self.calibration(hourly).withColumnRenamed("calib_peak_kw", "peak")
        added = {int(n): battery.added_load(battery.utilization([1.0] * 24, b["utilization"]), int(n), b["charger_kw"]) for n in b["new_chargers"]}
        sizes = battery.scenario_sizes(history, calib, self.settings["multipliers"], added, [tuple(p) for p in b["candidates"]])
        checked = battery.reliable_regions(backtest, calib, b["least_days"], b["most_bias"])
        runs = battery.run_scenarios(battery.scenario_days(days, calib, self.settings["multipliers"], added, compared_at=max(added)), sizes, battery.Battery(), checked)
        return {"battery_runs": runs, "battery_sizes": sizes}

    # scores
    def ranking(self, surges: DataFrame, access: DataFrame, runs: DataFrame | None, predicted: DataFrame | None) -> DataFrame:
        rows = surges.select("code", "multiplier", "status", "surge_risk", "peak_ratio")
        if predicted is not None:
            held = priority.with_predicted_risk(rows, predicted.withColumnRenamed("ai_peak_ratio", "predicted_peak_ratio"))
            rows = held.withColumn("peak_ratio", F.col("used_peak_ratio")).drop("used_peak_ratio", "predicted_missing")
        return priority.priority_table(rows, access.select("code", "access"), self.settings["multiplier"], self.settings["w_risk"], energy=runs)

    def simulation(self, ranked: DataFrame, access: DataFrame, chargers: DataFrame, points: DataFrame) -> dict[str, DataFrame]:
        """Virtual chargers at the regions ranked first, and at those of the least access."""
        low = spatial.bottom_with_ties(access, "access", 0.2)
        n = max(1, low.count())
        chosen = {"priority": ranked.where(F.col("rank") <= n).select("code"), "least access": low.select("code")}
        after = spatial.added_chargers(chargers, points, chosen, self.settings["virtual_chargers"], self.settings["radius_km"])
        return {"simulation": spatial.access_gap(after, low), "access_after": after}

    def scenarios(self, hourly: DataFrame, surges: DataFrame) -> dict[str, DataFrame]:
        c = self.settings["scenario"]
        raw = self.source("registered_history", ("code", "ym", "ev")).withColumn("code", expr.clean_code("code", 10))
        history = inputs.ev_history(raw).select("code", expr.month_index("ym").alias("mi"), F.col("ev").alias("ev_count"))
        base = month_of(c["base"]) if c["base"] else history.agg(F.max("mi")).first()[0]
        growth = scenario.growth_rate(history, base, c["months"])
        peaks = scenario.typical_day(hourly).groupBy("code").agg(F.max("kw").alias("peak"))
        grid = scenario.scenario_grid(growth, peaks, base, c["years"], c["factors"], c["betas"])
        limits = self.calibration(hourly).select("code", (F.col("calib_peak_kw") * self.settings["multiplier"]).alias("limit_kw"))
        return {"scenarios": grid.join(limits, "code", "left").withColumn("over", F.col("peak_kw") > F.col("limit_kw")), "scenario_summary": scenario.scenario_summary(grid, limits, "mid", "high")}

    def headline(self, surges: DataFrame, multiple: DataFrame | None, effects: DataFrame | None, then: DataFrame | None) -> DataFrame:
        s = self.settings
        none = [c for c in ("tp_ai", "alerts_ai", "tp_base", "alerts_base", "actual_days") if c not in surges.columns]
        rows = surges.withColumns({c: F.lit(None).cast("long") for c in none}) if none else surges
        avoided = effects.withColumnRenamed("ai_effect", "effect") if effects is not None else None
        return priority.headline_rows(multiple, rows, avoided, then, s["multiplier"], max(s["battery"]["new_chargers"]), year=s["scenario"]["years"][-1])

    def story(self, headline: DataFrame, metrics: DataFrame | None, simulation: DataFrame | None) -> DataFrame:
        skill = None
        if metrics is not None:
            row = metrics.where("level = 'peak' and period = 'eval' and scope = 'all'").select("skill_ai").first()
            skill = row[0] if row else None
        gain = None
        if simulation is not None:
            before = simulation.where("strategy = 'before'").select(F.col("mean_low").alias("b"))
            gain = simulation.where("strategy <> 'before'").crossJoin(F.broadcast(before)).select("strategy", expr.ratio(F.col("mean_low") - F.col("b"), "b").alias("gain")).orderBy("strategy")
        return priority.story_rows(headline, gain, skill)

    def detail(self, ranked: DataFrame, counts: DataFrame) -> dict[str, DataFrame]:
        rows, least, numbers = publish.detail_rows(ranked), self.settings["least_customers"], ["score"]
        printed = publish.pages(rows, counts, least, numbers)
        return {"detail": printed, "detail_states": publish.state_counts(rows, counts, least), "detail_check": publish.check_pages(printed, numbers)}

    def first_part(self) -> list[Stage]:
        s, window = self.settings, self.window()
        found = [
            Stage("regions", lambda: csv.region_master(self.source("regions", ("code", "name"))), ("regions",), critical=True),
            Stage("cube", self.cube_of_regions, ("regions", "consumption"), ("regions",), critical=True),
            Stage("customers", lambda c: c.groupBy("code").agg(F.max("cust_sum").alias("n")), after=("cube",)),
            Stage("match_rates", lambda m: m, after=("matching",), title="Towns matched with codes"),
            Stage("months", cube.daily_series, after=("cube",)),
            Stage("bands", lambda c: cube.band_shares(c, s["bands"], "code"), after=("cube",), title="Shares of bands of hours"),
            Stage("channels", self.channels, ("part",), ("regions", "cube"), title="One channel against the other"),
            Stage("load_types", lambda c: cube.classify_load(cube.concentration(c)), after=("cube",), title="Concentration of load and its type"),
        ]
        if window:
            found += [Stage("activations", lambda m: causal.activations(m, *window), after=("months",), title="Rising change points by region"), Stage("units", self.units, after=("activations",))]
        return found

    def vehicle_part(self) -> list[Stage]:
        v = self.settings["vehicle"]
        return [
            Stage("places", lambda: inputs.centroids(self.source("places", ("code", "lat", "lon"))), ("places",)),
            Stage("vehicles", self.vehicles, ("vehicles",)),
            Stage("vehicle_ids", lambda log: sessions.key_verdict(sessions.pair_speeds(log, "vehicle"), "vehicle", log.select("vehicle").distinct().count()), after=("vehicles",)),
            Stage("sessions", self.sessions, after=("vehicles", "places")),
            Stage("vehicle_regions", lambda f: sessions.regional_sessions(f, "vehicle", "code", max(f.agg(F.countDistinct(F.to_date("start"))).first()[0], 1), v["least"]), after=("sessions",), title="Charging sessions by region"),
            Stage("homes", self.homes, after=("vehicles",)),
            Stage("away", lambda f, h: sessions.away_charging(f, h, "vehicle", "code", v["away_km"], v["least"]), after=("sessions", "homes"), title="Charging away from home by region"),
            Stage("charging_shape", self.shape, after=("sessions",), title="Charging by hour of day"),
        ]

    def effect_part(self) -> list[Stage]:
        s = self.settings
        return [
            Stage("sales", self.sales, ("sales",)),
            Stage("sales_quality", sales.quality, after=("sales",), title="Quality of sales data"),
            Stage("outcomes", self.panel, after=("sales", "units")),
            Stage("least_effect", self.least_effect, after=("outcomes", "sales", "units"), title="Least detectable effects"),
            Stage("effects", self.effects, after=("outcomes", "units"), title="Effects by distance from adoption"),
            Stage("regression", lambda p, u: causal.binned_event_study(p, u), after=("outcomes", "units"), title="Effects by regression"),
            Stage("placebo", self.placebo, after=("outcomes", "sales", "units"), title="Placebo effects"),
            Stage("contamination", self.stocks, ("stocks",), ("units",), title="Openings around adoption"),
            Stage("unit_changes", lambda p, u: causal.unit_outcomes(p, u, 6), after=("outcomes", "units")),
            Stage("unit_features", self.unit_features, after=("unit_changes", "sales")),
            Stage("effects_by_cell", lambda f: causal.cell_effects(f, "wait_share", "outsider_share"), after=("unit_features",), title="Effects by cell of two shares"),
            Stage("heterogeneity", self.heterogeneity, after=("unit_features",)),
            Stage("quadrants", self.quadrants, after=("load_types", "unit_changes"), title="Load and effect"),
        ]

    def second_part(self) -> list[Stage]:
        s = self.settings
        surges = Stage("surges", self.surges, after=("forecasts", "hourly"), title="Risk of surges by region")
        if not self.given("hourly"):  # without hours, months stand in
            surges = Stage("surges", self.monthly_surges, after=("cube",), title="Risk of surges by region, from months")
        return [
            Stage("stations", lambda: inputs.stations(self.source("stations", ("station", "lat", "lon"))), ("stations",)),
            Stage("station_stock", lambda c, p: inputs.region_stock(c.join(spatial.nearest_small(c, p, "station", "code").select("station", "code"), "station")), after=("stations", "places"), title="Stations and chargers by region"),
            Stage("points", self.points, ("registered",), ("places",)),
            Stage("access", self.access, after=("stations", "points"), title="Access to chargers"),
            Stage("slope_check", self.slopes, ("elevations",), ("stations", "points", "access"), title="Access with and without slopes"),
            Stage("away_against_access", lambda a, w: sessions.low_access_contrast(w.join(a.select("code", "access"), "code")), after=("access", "away"), title="Charging away where access is low"),
            Stage("holidays", lambda: files.load_holidays(self.spark, s["paths"]["holidays"]), ("holidays",)),
            Stage("weather", lambda: inputs.weather_issues(self.source("weather", ("ts", "station"))), ("weather",)),
            Stage("external_inputs", lambda w, h: inputs.input_audit(w, h, ts.issue_cutoff(F.col("ts"))), after=("weather", "holidays"), title="External inputs"),
            Stage("hourly", lambda: csv.hourly_facts(self.source("hourly", ("code", "period", "kwh"))), ("hourly",)),
            Stage("targets", lambda h: inputs.concentrated_targets(h, self.days(h)[0].isoformat(), (self.days(h)[1] - dt.timedelta(days=1)).isoformat()), after=("hourly",)),
            Stage("backtest", self.backtest, after=("hourly",), title="Baseline on past days"),
            Stage("hour_panel", self.panel_of_hours, after=("hourly",), beside=("holidays",)),
            Stage("forecasts", self.forecasts, after=("hour_panel",)),
            Stage("metrics", lambda p: ts.ai_improvement(ts.forecast_metrics(p)), after=("forecasts",), title="Errors of the forecasts"),
            surges,
            Stage("risk_summary", lambda r, _: risk.risk_summary(r), after=("surges", "forecasts"), title="Alerts by multiplier"),
            Stage("two_level", self.two_level, after=("hour_panel", "hourly"), title="Errors of forecasts of hours and peaks"),
            Stage("districts", lambda h: two_level.district_forecast(h, self.periods(h), store=self.kept(), **s["forecast"]), after=("hourly",), title="Errors of forecasts of districts"),
            Stage("charge_types", models.charge_types, after=("hourly",), title="Types of charging"),
            Stage("battery_runs", self.battery_runs, after=("hourly", "targets", "backtest", "hour_panel"), beside=("forecasts",)),
            Stage("battery_comparison", battery.compared_runs, after=("battery_runs",), title="Battery plans by input"),
            Stage("battery_effects", battery.ai_effects, after=("battery_runs",), title="Excess that forecasts avoid"),
            Stage("review", lambda r: priority.review_order(r, self.spark.createDataFrame([(str(c),) for c in s["confirmed"]], "code string"), s["multiplier"]), after=("battery_runs",), title="Order of review"),
            Stage("priority", self.ranking, after=("surges", "access"), beside=("battery_runs", "predicted_ratios"), title="Priority of regions"),
            Stage("simulation", self.simulation, after=("priority", "access", "stations", "points"), title="Virtual chargers"),
            Stage("scenarios", self.scenarios, ("registered_history",), ("hourly", "surges"), title="Scenarios"),
            Stage("multiple", self.chargers_per_vehicle, after=("station_stock", "points")),
            Stage("headline", self.headline, after=("surges",), beside=("multiple", "battery_effects", "scenarios"), title="Headline figures"),
            Stage("story", self.story, after=("headline",), beside=("two_level", "simulation"), title="Story"),
            Stage("detail", self.detail, after=("priority", "customers"), title="Detail pages"),
        ]

    def all(self) -> list[Stage]:
        return [*self.first_part(), *self.vehicle_part(), *self.effect_part(), *self.second_part()]


def month_of(text: str) -> int:
    """Month index of YYYY-MM text."""
    year, month = str(text).replace("-", "")[:4], str(text).replace("-", "")[4:6]
    return int(year) * 12 + int(month) - 1


def run(spark: SparkSession, settings: dict[str, Any] | str, out: str | None = None, first_part_only: bool = False, resume: bool = False, only: list[str] | None = None) -> dict[str, Any]:
    """Runs all stages (or the first part, or those named); returns status, the stage log, the tables and the folder."""
    held = Run(spark, stages.load_settings(settings, {}) if isinstance(settings, str) else settings, out, resume)
    status = "done"
    try:
        for stage in held.first_part() if first_part_only else held.all():
            if only is None or stage.name in only:
                held.run(stage)
    except Exception:
        status = "failed"
    if out is not None:
        held.runner.summary(spark).coalesce(1).write.mode("overwrite").csv(f"{out.rstrip('/')}/inside/stages", header=True)
    return {"status": status, "stages": held.runner.log, "tables": held.results, "folder": out}


def run_first_part(spark: SparkSession, settings: dict[str, Any] | str, out: str | None = None) -> dict[str, Any]:
    return run(spark, settings, out, first_part_only=True)


def run_vehicles(spark: SparkSession, settings: dict[str, Any] | str, out: str | None = None) -> dict[str, Any]:
    """The vehicle log's stages alone."""
    names = [s.name for s in Run(spark, {}).vehicle_part()]
    return run(spark, settings, out, only=names)


def go(spark: SparkSession, settings: dict[str, Any], out: str, last: str | None = None) -> dict[str, Any]:
    """Checks first, then all stages, then the ranking over past windows where a last one is named."""
    checks = preflight(spark, settings)
    done = run(spark, settings, out, resume=True)
    seasons = run_seasons(spark, settings, last) if last else None
    return {**done, "checks": checks, "seasons": seasons}


def run_seasons(spark: SparkSession, settings: dict[str, Any], last: str, windows: int = 4, months: int = 3, top: int = 20) -> DataFrame | None:
    """The ranking of several evaluation windows and how far their top groups agree."""
    ranks = None
    wanted = ["regions", "cube", "places", "stations", "points", "access", "hourly", "hour_panel", "forecasts", "surges", "priority"]
    for start in priority.season_starts(last, windows, months):
        table = run(spark, stages.merged(settings, {"evaluation_start": start}), only=wanted)["tables"].get("priority")
        if table is not None:
            rows = table.select(F.lit(start).alias("window"), "code", "rank")
            ranks = rows if ranks is None else ranks.unionByName(rows)
    return None if ranks is None else priority.compared_windows(ranks, top)


#: Packages that stages import beside Spark.
PACKAGES = ("numpy", "pandas", "pyarrow")


def measured(held: Run) -> dict[str, float | None]:
    """What the results of a run say about its checks, by metric; what wasn't made measures nothing."""
    found, s = held.results, held.settings
    one = lambda name, *columns: found[name].agg(*columns).first()[0] if found.get(name) is not None else None
    out: dict[str, float | None] = {"missing_packages": sum(importlib.util.find_spec(p) is None for p in PACKAGES)}
    out["n_candidates"] = cube.regions_above(found["months"]).count() if found.get("months") is not None else None
    if found.get("sales_quality") is not None:
        row = found["sales_quality"].first()
        out |= {"n_bands": len(row["times_seen"]), "n_distance_codes": len(row["distances_seen"]), "masked_share": row["mask_rate"]}
    out["unmatched_share"] = one("matching", F.max("unmatched"))
    out["contained_share"] = one("channel_within", F.max("not_above"))
    if found.get("vehicle_ids") is not None:
        row = found["vehicle_ids"].first().asDict()
        out["individual_ids"] = float("individual" in map(str, row.values()))
    out["solver_works"] = float(battery.schedule([1.0] * 18 + [3.0, 3.0] + [1.0] * 4, 2.0, battery.Battery())["feasible"])
    out["mde"] = one("least_effect", F.max(F.when(F.col("outcome") == "main", F.col("mde"))))
    out["access_matched"] = one("access", F.avg(F.col("access_known").cast("int")))
    out["seasons_covered"] = one("seasons", F.count_if("covered"))
    out["weight_error"] = max(0.0, -s["w_risk"], s["w_risk"] - 1)  # the other axis has the rest of 1
    out["robust_share"] = one("priority", F.avg(F.col("robust_top").cast("int")))
    window = held.window()
    if window and found.get("months") is not None:
        out["missing_months"] = stages.missing_months(found["months"].agg(F.max("mi")).first()[0], window[0], 3)
    states = {e["stage"]: e["status"] for e in held.runner.log}
    out["model_works"] = {"done": 1.0, "kept": 1.0, "skipped": 0.0}.get(states.get("forecasts"))
    out["ai_passes"] = one("metrics", F.max(F.when(F.col("code").isNull(), F.col("passes").cast("int"))))
    out["usable_forecasts"] = one("weather", F.avg(F.when(F.col("forecast").isNotNull(), (F.col("issued_at") <= ts.issue_cutoff(F.col("ts"))).cast("int"))))
    if found.get("surges") is not None:
        out["zero_risk_share"] = found["surges"].where(expr.isclose("multiplier", s["multiplier"]) & (F.col("status") == "assessed")).agg(F.avg((F.col("surge_risk") == 0).cast("int"))).first()[0]
    return out


def preflight(spark: SparkSession, settings: dict[str, Any], whole: bool = False) -> DataFrame:
    """The verdicts before a run: what can be measured on the given files, 'n.a.' for the rest; an unreadable file is no figure.

    whole: all stages are run first, so that what their results say is measured too.
    """
    held = Run(spark, settings)
    first = {x.name for x in held.first_part()}
    early = ("sales", "sales_quality", "vehicles", "vehicle_ids", "hourly", "weather")
    for stage in held.all():
        if whole or stage.name in early or stage.name in first:
            held.run(stage)
    held.run(Stage("seasons", cube.season_coverage, after=("hourly",)))
    rows = {k: float(v) for k, v in measured(held).items() if v is not None}
    metrics = spark.createDataFrame([tuple(rows.values())], ", ".join(f"{k} double" for k in rows))
    return publish.preflight(metrics)
