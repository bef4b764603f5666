"""Owner scoping: the only way that library code reads an owned table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Ids that go into the condition of a scan.
LONG_LIST = 1_000


@dataclass(frozen=True)
class TenantScope:
    """Rows of one owner; what is missing and what belongs to others look alike."""

    user_id: str
    column: str = "user_id"

    def rows(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.column) == F.lit(self.user_id))

    def one(self, df: DataFrame, **key) -> DataFrame:
        """The row of the owner with that key, or no row."""
        found = self.rows(df)
        for name, value in key.items():
            found = found.where(F.col(name) == F.lit(value))
        return found.limit(1)

    def among(self, df: DataFrame, column: str, values: list[str]) -> DataFrame:
        """Rows whose id is listed; malformed ids match nothing.  A list above ``LONG_LIST`` is a table that is joined."""
        from .functions.ids import UUID_PATTERN

        sound = [v for v in values if UUID_PATTERN.fullmatch(v)]
        if len(sound) <= LONG_LIST:
            return self.rows(df).where(F.col(column).isin(sound) if sound else F.lit(False))
        return self.among_rows(df, column, df.sparkSession.createDataFrame([(v,) for v in sound], "id string"), "id")

    def among_rows(self, df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
        """Rows whose id is in a table of ids, of any length; malformed, null and repeated ids change nothing."""
        from .functions.ids import is_uuid

        sound = ids.where(is_uuid(F.col(id_column))).select(F.col(id_column).alias(column))
        return self.rows(df).join(sound, column, "left_semi")


def filters_on(df: DataFrame, column: str = "user_id") -> bool:
    """True if the optimised plan restricts ``column`` with an equality: for tests of public queries."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any("Filter" in line and f"{column}#" in line and " = " in line for line in plan.splitlines())
