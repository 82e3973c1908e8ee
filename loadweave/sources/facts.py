"""Facts about files, kept beside them: read once for a state of the file, and again when it has changed.

A fact is a small table, stored as Parquet under a name made of the file's path, length and time of
change, of what is asked and of its options.  Another length or time is another name, so what is out of date
is never read; ``forget`` deletes what belongs to states that are gone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def state_of(spark: SparkSession, path: str) -> dict[str, Any]:
    """path, length and time of change of a file, or of all files of a folder together."""
    place, fs = _hadoop(spark, path)
    status = fs.getFileStatus(place)
    if status.isFile():
        return {"path": status.getPath().toString(), "length": status.getLen(), "changed": status.getModificationTime()}
    inside = [s for s in fs.listStatus(place) if s.isFile()]
    return {"path": status.getPath().toString(), "length": sum(s.getLen() for s in inside), "changed": max([status.getModificationTime(), *[s.getModificationTime() for s in inside]]), "files": len(inside)}


def _digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:24]


class Facts:
    """A folder of facts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, path: str, what: str, options: dict[str, Any], state: dict[str, Any]) -> str:
        return f"{self.folder}/{_digest(state['path'])}/{_digest([state, what, options])}"

    def known(self, path: str, what: str, make: Callable[[], DataFrame], **options: Any) -> DataFrame:
        """The table of a fact: stored if it is known of this state of the file, else made and stored first."""
        target = self._place(path, what, options, state_of(self.spark, path))
        place, fs = _hadoop(self.spark, f"{target}/_SUCCESS")
        if not fs.exists(place):
            make().coalesce(1).write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)

    def forget(self, path: str, keep: tuple[tuple[str, dict[str, Any]], ...] = ()) -> int:
        """Deletes all facts of a path but those (what, options) of its present state; how many."""
        state = state_of(self.spark, path)
        stay = {self._place(path, what, options, state).rsplit("/", 1)[-1] for what, options in keep}
        place, fs = _hadoop(self.spark, f"{self.folder}/{_digest(state['path'])}")
        found = [s.getPath() for s in fs.listStatus(place)] if fs.exists(place) else []
        gone = [p for p in found if p.getName() not in stay]
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    def observed_dates(self, path: str, period: str) -> DataFrame:
        """``files.observed_dates``, read from the file once for each state of it."""
        return self.known(path, "observed_dates", lambda: files.observed_dates(self.spark, path, period), period=period)

    def rows(self, path: str) -> int:
        """Lines of a file, its header included."""
        return self.known(path, "rows", lambda: self.spark.read.text(path).agg(F.count("*").alias("n"))).first()["n"]
