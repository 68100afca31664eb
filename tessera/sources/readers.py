"""Readers with declared schemas, and a seeded stream of drawn lines."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

_STRING, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
_TEXT_MAP = T.MapType(_STRING, _STRING)
_COMPLIMENTS = ("hot", "cute", "cool", "funny", "photos", "more", "profile", "list", "note", "plain", "writer")


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


#: Schemas of the JSON-lines inputs.
SCHEMAS: dict[str, T.StructType] = {
    "review": _schema(review_id=_STRING, user_id=_STRING, business_id=_STRING, stars=_DOUBLE, date=T.TimestampNTZType()),
    "business": _schema(
        business_id=_STRING, city=_STRING, stars=_DOUBLE, review_count=_LONG, attributes=_TEXT_MAP, categories=_STRING, hours=_TEXT_MAP, latitude=_DOUBLE, longitude=_DOUBLE,
    ),
    "tip": _schema(business_id=_STRING, text=_STRING, likes=_LONG),
    "photo": _schema(business_id=_STRING),
    "checkin": _schema(business_id=_STRING, time=T.MapType(_STRING, _LONG)),
    "user": _schema(
        user_id=_STRING, average_stars=_DOUBLE, review_count=_LONG, yelping_since=_STRING, elite=_STRING, friends=_STRING, useful=_LONG, funny=_LONG, cool=_LONG,
        **{f"compliment_{c}": _LONG for c in _COMPLIMENTS},
    ),
}
#: Schemas of the headered CSV inputs.
CSV_SCHEMAS = {"ratings": _schema(user_id=_STRING, business_id=_STRING, stars=_DOUBLE), "baskets": _schema(user_id=_STRING, business_id=_STRING)}


def read_json_lines(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None) -> DataFrame:
    """JSON lines of a known kind; only ``columns`` are parsed.  A damaged line fails the query."""
    schema = SCHEMAS[kind]
    wanted = T.StructType([f for f in schema if columns is None or f.name in columns])
    return spark.read.schema(wanted).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Headered, quoted CSV; each file has its own header line."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', mode="FAILFAST")


def read_transactions(spark: SparkSession, path: str, date: int = 0, customer: int = 1, product: int = 5) -> DataFrame:
    """``date_customer_id, product_id`` of a quoted CSV, by column positions; numbers lose leading zeros."""
    rows = spark.read.csv(path, header=True, quote='"')
    column = [F.col(f"`{c}`") for c in rows.columns]
    key = F.concat_ws("-", column[date], column[customer].cast("bigint").cast("string"))
    return rows.select(key.alias("date_customer_id"), column[product].cast("bigint").alias("product_id"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``id, label, features`` of headerless lines ``index,cluster,f1,f2,...``."""
    fields = F.split("value", ",")
    features = F.transform(F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0))), lambda x: x.cast("double"))
    return spark.read.text(path).where(F.trim("value") != "").select(fields[0].cast("bigint").alias("id"), fields[1].cast("int").alias("label"), features.alias("features"))


def read_intermediate(spark: SparkSession, path: str) -> DataFrame:
    """The headered CSV of ``date_customer_id, product_id``, whatever its header is called."""
    return read_csv(spark, path, "date_customer_id string, product_id bigint")


class DrawnLines(DataSource):
    """Stream of lines drawn from a text file with replacement.

    Options: ``path`` (a file that the driver can read), ``size`` (lines of each
    batch, 100), ``seed`` (0), ``batches`` (as many as wanted, 10).  Columns:
    ``pos`` (from 0), ``batch``, ``value``.  A seed gives the same stream again.
    """

    @classmethod
    def name(cls) -> str:
        return "drawn_lines"

    def schema(self) -> str:
        return "pos bigint, batch bigint, value string"

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _DrawnLinesReader(self.options)


class _DrawnLinesReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.seed = options["path"], int(options.get("seed", 0))
        self.size, self.batches = int(options.get("size", 100)), int(options.get("batches", 10))
        self.lines: list[str] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0}

    def _batch(self, number: int) -> list[tuple[int, int, str]]:
        if self.lines is None:  # once for the stream
            with open(self.path, encoding="utf-8") as file:
                self.lines = file.read().splitlines()
        lines = self.lines
        draw = random.Random(f"{self.seed}/{number}")
        return [(number * self.size + i, number, draw.choice(lines)) for i in range(self.size)] if lines else []

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        number = start["batch"]
        if number >= self.batches:
            return iter(()), start
        return iter(self._batch(number)), {"batch": number + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([row for number in range(start["batch"], end["batch"]) for row in self._batch(number)])
