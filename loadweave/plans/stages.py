"""Stages with declared inputs: stored once, resumed, isolated and timed; settings and windows."""

from __future__ import annotations

import copy
import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def merged(base: dict, over: dict) -> dict:
    """Nested settings, the second ones first; keys that begin with _ are comments."""
    out = copy.deepcopy({k: v for k, v in base.items() if not str(k).startswith("_")})
    for key, value in over.items():
        if str(key).startswith("_"):
            continue
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def load_settings(path: str, defaults: dict) -> dict:
    with open(path, encoding="utf-8") as f:
        return merged(defaults, json.load(f))


@dataclass(frozen=True)
class Stage:
    """A step: what it needs given, which tables it is made of, and whether the run ends where it fails.

    needs: names of input paths; after: tables without which it is left out; beside: tables it takes where they exist (else
    None).  make takes the tables of after and beside in that order and returns a table, or several by name.
    """

    name: str
    make: Callable[..., Any]
    needs: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    beside: tuple[str, ...] = ()
    critical: bool = False
    title: str | None = None


@dataclass
class Store:
    """Tables of stages as Parquet in one folder, under a name that tells what they were made of."""

    spark: SparkSession
    folder: str

    def path(self, name: str, mark: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}-{mark}"

    def has(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def keep(self, table: DataFrame, path: str) -> DataFrame:
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)


@dataclass
class Stages:
    """Runs stages in order; a stage is done once its tables are stored, so what fails when it is computed fails there.

    A critical one raises; another's failure is noted, without its message, and the rest goes on.  With ``resume`` a
    stage whose tables stand, made of the same inputs by the same settings, is read and not made again.
    """

    store: Store | None = None
    resume: bool = False
    log: list[dict[str, Any]] = field(default_factory=list)
    results: dict[str, Any] = field(default_factory=dict)
    marks: dict[str, str] = field(default_factory=dict)

    def left_out(self, stage: Stage) -> None:
        self.log.append({"stage": stage.name, "critical": stage.critical, "status": "left out", "seconds": 0.0})

    def run(self, stage: Stage, given: Any = None) -> Any:
        """given: what the stage depends on besides its tables (settings, states of its files)."""
        began = time.time()
        entry: dict[str, Any] = {"stage": stage.name, "critical": stage.critical}
        try:
            tables = [self.results.get(n) for n in (*stage.after, *stage.beside)]
            made_of = [stage.name, given, *[self.marks.get(n) for n in (*stage.after, *stage.beside)]]
            mark = hashlib.sha256(json.dumps(made_of, sort_keys=True, default=str).encode()).hexdigest()[:16]
            known = self._known(stage.name, mark)
            entry["status"] = "kept" if known is not None else "done"
            for name, table in (known if known is not None else self._made(stage, tables, mark)).items():
                self.results[name], self.marks[name] = table, mark
            return self.results.get(stage.name)
        except Exception as error:
            entry |= {"status": "failed" if stage.critical else "skipped", "error": type(error).__name__}
            if stage.critical:
                raise
            return None
        finally:
            entry["seconds"] = round(time.time() - began, 3)
            self.log.append(entry)

    def _made(self, stage: Stage, tables: list[Any], mark: str) -> dict[str, Any]:
        found = stage.make(*tables)
        found = found if isinstance(found, dict) else {stage.name: found}
        if self.store is None:
            return found
        stored = {n: self.store.keep(t, self.store.path(n, mark)) for n, t in found.items()}
        listed = self.store.spark.createDataFrame([(n, t.schema.json()) for n, t in stored.items()], "name string, schema string")
        self.store.keep(listed.coalesce(1), self.store.path(stage.name, mark) + ".tables")
        return stored

    def _known(self, name: str, mark: str) -> dict[str, Any] | None:
        if not self.resume or self.store is None or not self.store.has(listed := self.store.path(name, mark) + ".tables"):
            return None
        rows = self.store.spark.read.parquet(listed).collect()  # a row a table
        paths = {r["name"]: self.store.path(r["name"], mark) for r in rows}
        if not all(map(self.store.has, paths.values())):
            return None
        return {r["name"]: self.store.spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(paths[r["name"]]) for r in rows}

    def summary(self, spark):
        """One row for each stage, exported without error messages."""
        rows = [(e["stage"], e["critical"], e["status"], e.get("error"), e["seconds"]) for e in self.log]
        return spark.createDataFrame(rows, "stage string, critical boolean, status string, error string, seconds double")


def energy_window(train_days: int, validation_days: int, weeks: int, calibration_days: int) -> int:
    """Days of history that the hourly stages read: calibration, or training with validation and the baseline's weeks."""
    return max(calibration_days, train_days + validation_days + 7 * weeks)


def evaluation_window(last: str, days: int = 28) -> tuple[str, str]:
    """The last so many days up to a date (inclusive)."""
    import datetime as dt

    end = dt.date.fromisoformat(last)
    return (end - dt.timedelta(days=days - 1)).isoformat(), last


def preregistered(skill: float | None) -> str:
    """Decision on a skill fixed beforehand: 5 % or more keep, 0 to 5 % support, below withdraw."""
    return "not_computed" if skill is None else "keep" if skill >= 0.05 else "support" if skill >= 0 else "withdraw"


def calendar_warnings(start: str, end: str, holidays: int, lunar: tuple[str, ...] = ()) -> list[str]:
    """Warnings only: no calendar, a window that touches the turn of the year, or one that touches a
    lunar new year's day of the calendar or lies beside it."""
    import datetime as dt

    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    out = [] if holidays else ["no holiday calendar"]
    days = {(a + dt.timedelta(days=i)) for i in range((b - a).days + 1)}
    if any((d.month, d.day) >= (12, 24) or (d.month, d.day) == (1, 1) for d in days):
        out.append("the window touches the turn of the year")
    if any((a - dt.date.fromisoformat(d)).days <= 1 and (dt.date.fromisoformat(d) - b).days <= 1 for d in lunar):
        out.append("the window touches the lunar new year")
    return out


def missing_months(last: int, window: tuple[int, int], r: int) -> int:
    """Months of an activation window that a source, whose last month index is given, can't follow for r months."""
    return len([m for m in range(window[0], window[1] + 1) if m + r - 1 > last])


def clipped_window(window: tuple[int, int], last: int) -> tuple[int, int]:
    """The window up to the last month there is."""
    return window[0], min(window[1], last)
