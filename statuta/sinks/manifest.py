"""Runs that are seen whole or not at all: tables first, then a manifest that names them.

A run's tables are written under its number; the manifest of the run, written last, has a row for
every table there is, with the folder where its latest state lies. Readers follow the latest
finished manifest and nothing else, so a run that broke, or is under way, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Runs:
    """The runs of a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def latest(self) -> int | None:
        """The number of the last finished run."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        top = path(f"{self.folder}/manifest")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return None
        names = [str(s.getPath().getName()) for s in fs.listStatus(top)]
        return max((int(n.split("=")[1]) for n in names if n.startswith("run=") and fs.exists(path(f"{self.folder}/manifest/{n}/_SUCCESS"))), default=None)

    def places(self, run: int | None = None) -> dict[str, str]:
        """The folder of every table after a run, the last one if none is named."""
        run = self.latest() if run is None else run
        if run is None:
            return {}
        return {r["name"]: r["path"] for r in self.spark.read.schema("name string, path string").json(f"{self.folder}/manifest/run={run}").collect()}

    def table(self, name: str, run: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.places(run)[name])

    def write(self, tables: dict[str, DataFrame | Callable[[Runs], DataFrame]], run: int | None = None) -> int:
        """Writes a run and returns its number, by default the next one. A table may be a function of
        the runs, which it reads as they were before. Tables that the run does not write stay as they are.
        Repeating a run that did not finish replaces what it left."""
        last = self.latest()
        run = run if run is not None else 0 if last is None else last + 1
        if last is not None and run <= last:
            raise ValueError(f"run {run} is finished")
        places = self.places()
        for name, df in tables.items():
            path = f"{self.folder}/data/run={run}/{name}"
            (df(self) if callable(df) else df).write.mode("overwrite").parquet(path)
            places[name] = path
        rows = self.spark.createDataFrame(sorted(places.items()), "name string, path string")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/run={run}")
        return run
