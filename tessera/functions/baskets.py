"""Normal form of basket keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARKS = "\"' \t\r\n"


def basket_key(text: Column) -> Column:
    """``yyyymmdd-customer`` of a date and customer number, however written.

    Quotes and blanks have no meaning, nor have leading zeros.  Dates are
    ``month/day/year`` or ``year-month-day``.  Any other text stands for itself;
    null, and a text of nothing but quotes and blanks, is no basket.
    """

    def built(bare: Column) -> Column:
        shape = F.translate(bare, "0123456789", "")
        part = lambda text, mark, n: F.substring_index(F.substring_index(text, mark, n), mark, -1)
        two = lambda x: F.lpad(x, 2, "0")

        def dated(year: Column, month: Column, day: Column, customer: Column) -> Column:
            sound = (F.length(year) == 4) & F.length(month).between(1, 2) & F.length(day).between(1, 2) & (customer != "")
            bare_number = F.ltrim(customer, F.lit("0"))
            return F.when(sound, F.concat(year, two(month), two(day), F.lit("-"), F.when(bare_number == "", "0").otherwise(bare_number))).otherwise(bare)

        rest = F.substring_index(bare, "/", -1)
        us = dated(part(rest, "-", 1), part(bare, "/", 1), part(bare, "/", 2), F.substring_index(bare, "-", -1))
        iso = dated(part(bare, "-", 1), part(bare, "-", 2), part(bare, "-", 3), F.substring_index(bare, "-", -1))
        return F.when(shape == "//-", us).when(shape == "---", iso).when(bare != "", bare)

    # the array binds the bare text, which is then made once
    return F.transform(F.array(F.translate(text, _MARKS, "")), built)[0]


def basket_items(df: DataFrame, key: str, item: str) -> DataFrame:
    """``basket, item`` of the rows that have both.

    Rows without a basket are left out by their raw text, so that the key isn't
    made once more for the filter.
    """
    kept = df.where((F.translate(key, _MARKS, "") != "") & F.col(item).isNotNull())
    return kept.select(F.coalesce(basket_key(F.col(key)), F.lit("")).alias("basket"), F.col(item).alias("item"))


#: The same as SQL, of a column ``t`` that has lost its quotes and blanks.
BASKET_SQL = r"""CASE
    WHEN regexp_full_match(t, '\d{1,2}/\d{1,2}/\d{4}-\d+') THEN regexp_extract(t, '/(\d{4})-', 1) || lpad(regexp_extract(t, '^(\d+)/', 1), 2, '0') || lpad(regexp_extract(t, '/(\d{1,2})/', 1), 2, '0') || '-' || regexp_extract(t, '-0*(\d+)$', 1)
    WHEN regexp_full_match(t, '\d{4}-\d{1,2}-\d{1,2}-\d+') THEN t[1:4] || lpad(regexp_extract(t, '^\d{4}-(\d+)-', 1), 2, '0') || lpad(regexp_extract(t, '^\d{4}-\d+-(\d+)-', 1), 2, '0') || '-' || regexp_extract(t, '-0*(\d+)$', 1)
    ELSE t END"""
