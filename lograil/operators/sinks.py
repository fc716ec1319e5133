"""Exports. Spark commits a job's output whole or not at all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(records: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Records as CSV with header; null is empty; quoted where needed, quotes doubled."""
    records.filter("is_record").select(*columns).write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv wrote: line ends of any kind inside quotes stay as they are."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_value(c: Column, kind: str) -> Column:
    """A cell as a JSON value: numbers as numbers if they are, JSON embedded, else text."""
    as_text = F.to_variant_object(F.struct(c.alias("x")))
    text = F.variant_get(as_text, "$.x", "variant")
    if kind == "number":
        return F.when(c.rlike(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$"), F.try_parse_json(c)).otherwise(text)
    return F.coalesce(F.try_parse_json(c), text) if kind == "json" else text


def json_line(columns: Mapping[str, str]) -> Column:
    """One JSON object of the columns (name -> kind); absent cells are null."""
    return F.to_json(F.struct(*[json_value(F.col(n), k).alias(n) for n, k in columns.items()]), {"ignoreNullFields": "false"})


def record_json(columns: Mapping[str, str], extra: str = "extra", pretty: bool = False) -> Column:
    """A whole record as one JSON object: its columns, then its extra keys, whose values are JSON if they can be read as such. An extra key replaces a column of its name."""
    own = F.array(*[F.struct(F.lit(n).alias("key"), json_value(F.col(n), k).alias("value")) for n, k in columns.items()])
    more = F.coalesce(F.col(extra), F.create_map().cast("map<string,string>"))
    own = F.filter(own, lambda e: ~F.map_contains_key(more, e["key"]))
    added = F.transform(F.map_entries(more), lambda e: F.struct(e["key"].alias("key"), json_value(e["value"], "json").alias("value")))
    return F.to_json(F.map_from_entries(F.concat(own, added)), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def record_csv(columns: Sequence[str]) -> Column:
    """A whole record as CSV: a line of names and a line of cells."""
    cell = lambda c: F.when(c.rlike('[",\\r\\n]|^\\s|\\s$'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.concat(F.concat_ws(",", *[cell(F.lit(n)) for n in columns]), F.lit("\n"), F.concat_ws(",", *[cell(F.col(n).cast("string")) for n in columns]))


def write_json_lines(records: DataFrame, path: str, columns: Mapping[str, str]) -> None:
    records.filter("is_record").select(json_line(columns).alias("value")).write.text(path)


def new_bookmarks(found: DataFrame, table: DataFrame) -> DataFrame:
    """Bookmarks (source, line_no) that the table does not have yet; manual ones are never overwritten."""
    return found.select("source", "line_no").distinct().join(table, ["source", "line_no"], "left_anti").withColumn("automatic", F.lit(True))
