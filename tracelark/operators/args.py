"""Event arguments: parsing, lookup, and merging of a begin's with its end's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One argument: numbers in ``num`` with empty text; text, true, false and null in ``str`` with 0.0.
ARGS_TYPE = "array<struct<key:string,str:string,num:double>>"


def parse_args(args_json: Column) -> Column:
    """Arguments in the order of the object's keys; nested values stay JSON text. Not an object: no arguments."""
    # One reading of the text; map entries keep its order, and repeated keys.
    entries = F.map_entries(F.from_json(args_json, "map<string,variant>"))

    def arg(entry: Column) -> Column:
        value = entry["value"]
        number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|TINYINT|SMALLINT)")
        text = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("null"))
        num = F.when(number, F.try_variant_get(value, "$", "double"))
        return F.struct(entry["key"].alias("key"), F.when(number, F.lit("")).otherwise(text).alias("str"), F.coalesce(num, F.lit(0.0)).alias("num"))

    return F.coalesce(F.transform(entries, arg), F.expr("array()").cast(ARGS_TYPE))


def with_args(events: DataFrame) -> DataFrame:
    """Adds args, parsed from args_json."""
    return events.withColumn("args", parse_args(F.col("args_json")))


def arg_value(args: Column, key: str) -> Column:
    """The first argument of that key, as a struct; null if there is none."""
    return F.get(F.filter(args, lambda a: a["key"] == key), F.lit(0))


def merge_args(begin: Column, end: Column) -> Column:
    """A begin's arguments with the end's values for shared keys (first match), then the end's other keys."""
    replaced = F.transform(begin, lambda b: F.coalesce(F.get(F.filter(end, lambda e: e["key"] == b["key"]), F.lit(0)), b))
    added = F.filter(end, lambda e: ~F.exists(begin, lambda b: b["key"] == e["key"]))
    return F.concat(replaced, added)
