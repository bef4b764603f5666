"""Mixing sources to target weights: repetition rates per source, seeded copies per document.

1. Word counts are aggregated per source (a partial sum for each task, so a hot
   source costs one row a task).
2. ``targets`` shares the whole among the sources by weight; a target stops at
   ``most_repeats`` times its source, and what is over goes to the others by
   weight, round after round, until none is above.
3. A document is taken floor(rate) times, and once more if a number in [0, 1)
   drawn from the MD5 of seed and id lies below the fraction of the rate.

Sources rank by code point, null last; weights repeat over that rank.  The rank
is worked out in ranges, so sources are never brought to one task or the driver.

Defined cases: null text counts 0 words and is never counted in a target; a
null source is a source; a source of size 0 has target 0 and takes nothing;
equal rows are taken alike (they draw the same number); null ids draw as the
text "null"; an empty table gives an empty result; extra columns are left to the
caller (``carry``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3.0
SEED = 17


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0) by source, null last, from counts per range of sources."""
    parts = settle(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()),
        "mixing-ranges",
    )
    # a row for each range, not for each source; ranges are shuffle partitions
    before = (
        parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.orderBy("_part")) - F.col("n"))
        .select("_part", "before")
    )
    inside = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return parts.join(before, "_part").withColumn("rank", F.col("before") + F.row_number().over(inside) - 1).drop("_part", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to the same with ``target``: each round settles the sources that stop, and reshares the rest."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = settle(ranked(sizes).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(most_repeats)), "mixing-sources")
    stopped = F.lit(False)
    level = None
    while True:
        open_ = ~stopped
        sums = rows.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(stopped, F.col("most"))).alias("fixed"),
            F.sum(F.when(open_, F.col("weight"))).alias("weights"),
            F.count(F.when(stopped, 1)).alias("n"),
        ).first()
        if not sums["weights"]:
            break
        level = ((sums["all"] or 0) - (sums["fixed"] or 0.0)) / sums["weights"]
        # levels only rise, so those that stopped stay so
        stopped_now = F.col("most") < F.col("weight") * F.lit(level)
        if rows.where(stopped_now).count() == sums["n"]:
            break
        stopped = stopped_now
    target = F.col("most") if level is None else F.least(F.col("most"), F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", target.alias("target"))


def draw(id_column: str, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 13 hex digits of MD5(seed:id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, carry: list[str], weights: tuple[float, ...] = WEIGHTS, most_repeats: float = MOST_REPEATS, id_column: str = "doc_id", source_column: str = "source", seed: int = SEED) -> DataFrame:
    """``carry`` columns with ``size source_size target copies``: how often each document is taken."""
    carry = [c for c in carry if c not in ("size", "source_size", "target", "copies")]
    rows = docs.withColumns({"_m_size": word_count(), "_m_source": F.col(source_column)})
    sizes = rows.groupBy("_m_source").agg(F.sum("_m_size").alias("source_size")).withColumnRenamed("_m_source", "source")
    goals = settle(targets(settle(sizes, "mixing-sizes"), weights, most_repeats), "mixing-targets").select(F.col("source").alias("_m_name"), F.col("source_size").alias("_m_all"), F.col("target").alias("_m_target"))
    joined = rows.join(goals, F.col("_m_source").eqNullSafe(F.col("_m_name")))
    rate = F.least(F.when(F.col("_m_all") > 0, F.col("_m_target") / F.col("_m_all")).otherwise(0.0), F.lit(float(most_repeats)))
    copies = F.floor(rate) + F.when(draw(id_column, seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select(*carry, F.col("_m_size").alias("size"), F.col("_m_all").alias("source_size"), F.col("_m_target").alias("target"), copies.cast("long").alias("copies"))


#: The mix in DuckDB: the level is the share a unit of weight that fits once the sources that stop below it are settled.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sources
), ordered AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
         sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER () AS total
  FROM weighed
), level AS (
  SELECT max((total - fixed) / open) AS level FROM ordered
), goals AS (
  SELECT source, source_size, least(most, weight * level) AS target FROM weighed, level
), rated AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
         CAST(concat('0x', substr(md5(concat('17:', coalesce(CAST(d.doc_id AS VARCHAR), 'null'))), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS drawn
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
