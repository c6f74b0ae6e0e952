"""Calendar features of a timestamp, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_week(ts: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(ts) + 1


def weekend(ts: Column) -> Column:
    """2 on Saturday and Sunday, else 1."""
    return F.when(day_of_week(ts) >= 6, 2).otherwise(1)


def season(ts: Column) -> Column:
    """Winter 1 (from December), spring 2, summer 3, autumn 4."""
    return (F.floor(F.month(ts) % 12 / 3) + 1).cast("int")


def timezone(ts: Column) -> Column:
    """The part of the day: 1 to 4 at weekends, 5 to 7 on weekdays."""
    h = F.hour(ts)
    free = F.when(h.between(1, 5), 1).when((h <= 7) | (h >= 22), 2).when(h.between(9, 12), 4).otherwise(3)
    work = F.when(h.between(1, 4), 5).when(h.between(7, 21), 7).otherwise(6)
    return F.when(weekend(ts) == 2, free).otherwise(work)


def calendar_columns(ts: Column) -> list[Column]:
    return [F.hour(ts).alias("hour"), timezone(ts).alias("timezone"), day_of_week(ts).alias("day_of_week"), F.month(ts).alias("month"), season(ts).alias("season"), weekend(ts).alias("weekend"), F.day(ts).alias("day_of_month")]


def parsed_reading_time(text: Column) -> Column:
    """`dd/MM/yyyy HH...` as a timestamp; null where it is none."""
    return F.try_to_timestamp(F.substring(text, 1, 13), F.lit("dd/MM/yyyy HH"))


def reading_key(household: Column, ts: Column) -> Column:
    return F.concat(household.cast("string"), F.lit("_"), F.date_format(ts, "dd/MM/yyyy"), F.lit("-"), F.date_format(ts, "HH"))


def consumption_class(amount: Column, threshold: float = 0.0) -> Column:
    """2 above the threshold, else 1; null stays null."""
    return F.when(amount > threshold, 2).when(amount.isNotNull(), 1)
