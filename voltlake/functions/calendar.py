"""Half-hour settlement periods (1 to 48 from midnight) and four-hour EFA blocks (1 from 23:00
of the day before)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .holidays import between

HOLIDAYS = between(1990, 2060)
FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy", "dd-MMM-yyyy", "yyyy/MM/dd"]


def period_of(ts: Column) -> Column:
    return (F.floor((F.hour(ts) * 60 + F.minute(ts)) / 30) + 1).cast("int")


def period_from_23(ts: Column) -> Column:
    """The other convention: period 1 begins at 23:00. Not used by any query."""
    return (F.pmod(F.floor((F.hour(ts) * 60 + F.minute(ts)) / 30) + 2, F.lit(48)) + 1).cast("int")


def efa_of_period(sp: Column) -> Column:
    return (F.floor((sp + 1) / 8) % 6 + 1).cast("int")


def efa_date_of_period(day: Column, sp: Column) -> Column:
    return F.date_add(day, F.floor((sp + 1) / 48).cast("int"))


def efa_of_time(ts: Column) -> Column:
    return (F.floor(((F.hour(ts) + 1) % 24) / 4) + 1).cast("int")


def efa_date_of_time(ts: Column) -> Column:
    return F.date_add(F.to_date(ts), F.when(F.hour(ts) >= 23, 1).otherwise(0))


def month(day: Column) -> Column:
    return F.trunc(day, "MM")


def parse_day(c: str, formats: list[str] | None = None) -> Column:
    """A lenient date of mixed formats, the day first; null if none fits."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(F.trim(f"`{c}`"), F.lit(f))) for f in formats or FORMATS))


def strict_day(c: str, formats: list[str] | None = None) -> Column:
    """As `parse_day`, but text that is no date is an error."""
    day = parse_day(c, formats)
    return F.when(F.col(c).isNull(), F.lit(None).cast("date")).otherwise(F.coalesce(day, F.raise_error(F.concat(F.lit("no date: "), F.col(c))).cast("date")))


def bank_holiday(day: Column, holidays: list[str] | None = None) -> Column:
    """1 on the given days, else 0; by default on the bank holidays of England."""
    days = HOLIDAYS if holidays is None else holidays
    # One literal of all days, which a plan can hold as often as it likes.
    return F.when(F.contains(F.lit(" ".join(days)), F.date_format(day, "yyyy-MM-dd")), 1).otherwise(0) if days else F.lit(0)


def slot_of_week(day: Column, sp: Column) -> Column:
    return F.weekday(day) * 48 + sp - 1


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.sql("select explode(sequence(trunc(cast(:s as date), 'MM'), trunc(cast(:e as date), 'MM'), interval 1 month)) as month", args={"s": start, "e": end})


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.sql("select explode(sequence(cast(:s as date), cast(:e as date), interval 1 day)) as day", args={"s": start, "e": end})


def chunks(spark: SparkSession, start: str, end: str, size: int = 7) -> DataFrame:
    """Inclusive windows of at most `size` days that cover a range."""
    return spark.sql(
        f"select s as start, least(date_add(s, {size - 1}), cast(:e as date)) as end from (select explode(sequence(cast(:s as date), cast(:e as date), interval {size} day)) as s)",
        args={"s": start, "e": end},
    )
