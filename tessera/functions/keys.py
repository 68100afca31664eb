"""Normal form of join keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters without meaning around a key: blank, tab, line ends.
KEY_BLANKS = " \t\r\n"


def clean_key(key: Column | str) -> Column:
    """``key`` without surrounding blanks, tabs and line ends; null if nothing is left.

    Letter case counts.  Null stays null.
    """
    return F.nullif(F.btrim(F.col(key) if isinstance(key, str) else key, F.lit(KEY_BLANKS)), F.lit(""))


def month_number(moment: Column) -> Column:
    """Months since year 0, so that consecutive months are consecutive integers."""
    return F.year(moment) * 12 + F.month(moment) - 1


def month_name(number: Column) -> Column:
    """``yyyy-MM`` of a month number."""
    return F.concat(F.lpad((number / 12).cast("int").cast("string"), 4, "0"), F.lit("-"), F.lpad((number % 12 + 1).cast("string"), 2, "0"))
