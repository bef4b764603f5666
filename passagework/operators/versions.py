"""Tables that change together: a change is written beside what is there, and one row makes it the current version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "version string, number long, tables map<string,string>, schemas map<string,string>"


class Conflict(Exception):
    """Another change was made current since this one was read."""


class Versions:
    """Named tables below ``root``.  Readers of a version see all its tables as they were made current together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _newest(self):
        from ..streaming.publication import read_or_empty

        # a row a change, and no more is ever read of them
        return read_or_empty(self.spark, f"{self.root}/pointer", POINTER).orderBy(F.desc("number"), F.desc("version")).first()

    def current(self) -> tuple[int, dict[str, DataFrame]]:
        """(number of the version, its tables); 0 and none before the first change."""
        row = self._newest()
        if row is None:
            return 0, {}
        return row["number"], {name: self.spark.read.schema(row["schemas"][name]).parquet(path) for name, path in row["tables"].items()}

    def change(self, tables: dict[str, DataFrame], since: int) -> int:
        """Write ``tables`` and make them current, with those of the version ``since`` that they do not replace.

        Nothing is seen before the last write, which is a row in one file.  A change since ``since`` is a conflict; of two that
        are made at one moment the one with the greater name stands, and the other is a conflict.
        """
        row = self._newest()
        if (row["number"] if row else 0) != since:
            raise Conflict(f"version {row['number'] if row else 0} is current, not {since}")
        name = uuid.uuid4().hex
        paths, schemas = (dict(row["tables"]), dict(row["schemas"])) if row else ({}, {})
        for table, rows in tables.items():
            paths[table] = f"{self.root}/{table}/{name}"
            schemas[table] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            rows.write.option("compression", "zstd").parquet(paths[table])
        self.spark.createDataFrame([(name, since + 1, paths, schemas)], POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")
        if self._newest()["version"] != name:
            raise Conflict("another change was made at the same moment")
        return since + 1
