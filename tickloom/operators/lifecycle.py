"""Deletion of symbols and retention of ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schema import CALENDARS, TIMEFRAMES

# Suffixes of the candle tables, as users know them.
_SUFFIX = {"gregorian": "greg", "jalali": "jalali"}
CANDLE_TABLES = {
    f"candles_{timeframe}_{_SUFFIX[calendar]}": (calendar, timeframe)
    for calendar in CALENDARS
    for timeframe in TIMEFRAMES
}


def last_deletions(deletions: DataFrame) -> DataFrame:
    """``(symbol, since)``: rows of the symbol up to that batch no longer count."""
    return deletions.groupBy("symbol").agg(F.max("since").alias("since"))


def undeleted(rows: DataFrame, deletions: DataFrame) -> DataFrame:
    """Rows that came in after the last deletion of their symbol, if any."""
    gone = last_deletions(deletions).withColumnRenamed("symbol", "_symbol")
    hidden = (F.col("symbol") == F.col("_symbol")) & (F.col("batch_id") <= F.col("since"))
    return rows.join(gone, hidden, "left_anti")


def candle_table(calendar: Column, timeframe: Column) -> Column:
    """Table name of a candle's calendar and timeframe."""
    suffix = F.when(calendar == "gregorian", _SUFFIX["gregorian"]).otherwise(_SUFFIX["jalali"])
    return F.concat(F.lit("candles_"), timeframe, F.lit("_"), suffix)


def table_counts(states: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Rows per table, out of one pass over the states of all timeframes; every table is listed.

    A candle is a key of the states, a symbol one that has day states, and the ticks are counted in these.
    ``ticks`` are counted themselves if given, as where some have expired.
    """
    name = candle_table(F.col("calendar"), F.col("timeframe"))
    keys = states.groupBy("symbol", "calendar", "timeframe", "bucket_start").agg(F.sum("ticks").alias("ticks"))
    rows, day = F.count(F.lit(1)), F.col("timeframe") == "1d"
    found = keys.agg(
        F.coalesce(F.sum(F.when(day, F.col("ticks"))), F.lit(0)).alias("ticks"),
        *(F.count(F.when(name == table, 1)).alias(table) for table in CANDLE_TABLES),
        F.count_distinct(F.when(day, F.col("symbol"))).alias("symbols"),
    )
    if ticks is not None:
        found = found.drop("ticks").crossJoin(ticks.agg(rows.alias("ticks")))
    # one row to one for each table
    tables = ["ticks", *CANDLE_TABLES, "symbols"]
    listed = F.explode(F.array(*(F.struct(F.lit(t).alias("name"), F.col(t).alias("rows")) for t in tables)))
    return found.select(listed.alias("t")).select("t.name", "t.rows")


def delete_summary(states: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """What deleting the given rows does to each table; as :func:`table_counts`."""
    done = F.when(F.col("name") == "symbols", "deleted").otherwise("dropped")
    return table_counts(states, ticks).select(
        "name", "rows", F.when(F.col("rows") > 0, done).otherwise("no-op").alias("outcome")
    )


def retention_limit(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(days=F.lit(days))


def kept_since(ticks: DataFrame, cutoff: Column) -> DataFrame:
    return ticks.filter(F.col("ts") >= cutoff)


def unexpired(ticks: DataFrame, days: int, as_of: Column) -> DataFrame:
    return kept_since(ticks, retention_limit(as_of, days))


def old_tick_count(ticks: DataFrame, as_of: Column, days: int = 6) -> DataFrame:
    """Early warning: how many ticks are older than ``days`` before ``as_of``."""
    old = ticks.filter(F.col("ts") < retention_limit(as_of, days))
    return old.agg(F.count(F.lit(1)).alias("old_ticks"))
