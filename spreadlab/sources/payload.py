"""Endpoint payloads: declared fields plus positional rows, cast to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared type names and the Spark type each one becomes.
TYPE_MAP = {
    "BOOLEAN": "boolean", "INTEGER": "bigint", "INT": "bigint", "DECIMAL": "double", "FLOAT": "double",
    "DOUBLE": "double", "DATE": "timestamp", "DATETIME": "timestamp", "VARCHAR": "string", "STRING": "string",
}


def typed(value: Column, declared: str) -> Column:
    """Cast text to the declared type; a bad value becomes null, an unknown type stays text."""
    target = TYPE_MAP.get(declared.upper())
    if target is None or target == "string":
        return value
    out = value.try_cast(target)
    return F.when(~F.isnan(out), out) if target == "double" else out


def cast_rows(rows: DataFrame, values: str, fields: list[dict], names: str) -> DataFrame:
    """Positional array column to one typed column per wanted field.

    `names` is the array column with the field names of the row's own document, which say
    where each value stands; a document that lacks a wanted name fails the job.
    """
    def value(name: str) -> Column:
        at = F.array_position(names, F.lit(name)).cast("int")
        lacking = F.raise_error(F.lit(f"payload has no field {name}")).cast("string")
        return F.when(at > 0, F.get(F.col(values), at - 1)).otherwise(lacking)

    return rows.select(*[typed(value(f["name"]), f["dataType"]).alias(f["name"]) for f in fields])


def _present(docs: DataFrame, needed: list[str]) -> DataFrame:
    """Keep `data`; a document lacking one of the needed members fails the job."""
    absent = F.lit(False)
    for n in needed:
        absent = absent | F.col(n).isNull()
    message = F.raise_error(F.lit(f"payload lacks one of {needed}"))
    return docs.select(
        F.when(absent, message.cast(docs.schema["data"].dataType)).otherwise(F.col("data")).alias("data"),
        *[c for c in docs.columns if c == "fields"],
    )


def read_payloads(spark: SparkSession, path: str, fields: list[dict]) -> DataFrame:
    """Read `{_meta, report, fields, data}` documents with positional rows."""
    docs = spark.read.schema(
        "_meta string, fields array<struct<name:string,dataType:string>>, data array<array<string>>"
    ).json(path, multiLine=True)
    rows = _present(docs, ["fields", "data"]).select(F.col("fields.name").alias("names"), F.explode("data").alias("row"))
    return cast_rows(rows, "row", fields, "names")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read `{_meta, data: [{...}]}` documents with named members."""
    wrapped = T.StructType([T.StructField("_meta", T.StringType()), T.StructField("data", T.ArrayType(schema))])
    docs = spark.read.schema(wrapped).json(path, multiLine=True)
    return _present(docs, ["_meta", "data"]).select(F.inline("data"))
