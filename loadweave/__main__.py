"""python -m loadweave --settings FILE --out FOLDER [--first-part | --vehicles | --preflight | --go] [--resume]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import run as runs
from .plans import stages


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loadweave")
    parser.add_argument("--settings", required=True)
    parser.add_argument("--out")
    parser.add_argument("--first-part", action="store_true")
    parser.add_argument("--vehicles", action="store_true")
    parser.add_argument("--preflight", action="store_true")
    parser.add_argument("--go", action="store_true", help="checks, then all stages, then past windows up to --last")
    parser.add_argument("--last")
    parser.add_argument("--resume", action="store_true", help="read the tables of stages whose inputs and settings haven't changed")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("loadweave").getOrCreate()
    settings = stages.load_settings(given.settings, {})
    if given.preflight:
        runs.preflight(spark, settings).show(30, truncate=False)
        return 0
    if given.vehicles:
        done = runs.run_vehicles(spark, settings, given.out)
    elif given.go:
        if not given.out:
            parser.error("--go needs --out")
        done = runs.go(spark, settings, given.out, given.last)
        done["checks"].show(30, truncate=False)
    else:
        done = runs.run(spark, settings, given.out, given.first_part, given.resume)
    for entry in done["stages"]:
        print(f"{entry['stage']}: {entry['status']} ({entry['seconds']} s)")
    return 0 if done["status"] == "done" else 1


if __name__ == "__main__":
    raise SystemExit(main())
