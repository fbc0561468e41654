"""From raw text fields to events: numbers, missing values, tracks and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.sources.schema import EVENT_COLUMNS, INT32, INT64

#: Reserved colour names and the palette slot of each.
COLOR_SLOTS = {
    "thread_state_running": 3,
    "thread_state_runnable": 2,
    "thread_state_sleeping": 4,
    "thread_state_uninterruptible": 0,
    "thread_state_iowait": 1,
    "rail_idle": 3,
    "rail_animation": 6,
    "rail_response": 5,
    "rail_load": 1,
    "background_memory_dump": 4,
    "light_memory_dump": 5,
    "detailed_memory_dump": 7,
}
PALETTE_SIZE = 8


def saturated(text: Column, low: int, high: int) -> Column:
    """A number in text, cut toward zero and held within bounds; missing or malformed is null."""
    decimal = text.try_cast("decimal(38,6)")
    wide = text.try_cast("double")
    held = F.when(wide >= float(high), F.lit(high)).when(wide <= float(low), F.lit(low))
    whole = F.when(decimal.isNotNull(), F.greatest(F.least(decimal, F.lit(high).cast("decimal(38,6)")), F.lit(low).cast("decimal(38,6)")))
    return F.coalesce(held, whole.cast("bigint"), wide.cast("bigint"))


def normalize_events(raw: DataFrame) -> DataFrame:
    """Typed events from raw ones (text fields of RAW_FIELDS with args, and trace_id and seq).

    Fractions are cut toward zero, overflow saturates, missing text is '' and missing numbers are 0. An event whose
    number is no number is rejected, as one that can't be parsed.
    """
    numbers = {"ts": INT64, "dur": INT64, "pid": INT32, "tid": INT32}
    clean = [F.col(n).isNull() | F.trim(n).try_cast("double").isNotNull() for n in numbers]
    typed = raw.where(clean[0] & clean[1] & clean[2] & clean[3])
    columns = {c: F.coalesce(F.col(c), F.lit("")) for c in ("name", "cat", "ph", "cname", "id")}
    for n, (low, high) in numbers.items():
        kind = "int" if high == INT32[1] else "bigint"
        columns[n] = F.coalesce(saturated(F.trim(n), low, high), F.lit(0)).cast(kind)
    columns["args_json"] = F.coalesce(F.col("args"), F.lit(""))
    return typed.select(*(columns.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS))


def is_counter() -> Column:
    return F.col("ph") == "C"


def is_metadata() -> Column:
    return F.col("ph") == "M"


def assign_track(events: DataFrame) -> DataFrame:
    """Adds track_type and track_id: counters by (pid, name, id), all else by (pid, tid).

    An event with an empty phase is a thread event. Metadata belongs to its thread's track without being one of
    its events.
    """
    counter = F.concat(F.lit("C:"), F.col("pid"), F.lit(":"), F.length("name"), F.lit(":"), F.col("name"), F.lit(":"), F.col("id"))
    thread = F.concat(F.lit("T:"), F.col("pid"), F.lit(":"), F.col("tid"))
    return events.withColumn("track_type", F.when(is_counter(), "COUNTER").otherwise("THREAD")).withColumn(
        "track_id", F.when(is_counter(), counter).otherwise(thread)
    )


def display_name(track_type: Column, name: Column, tid: Column, ref: Column) -> Column:
    """A track's shown name: its own, else ``Thread n`` or ``Counter``; with ``(id)`` where it has one."""
    own = F.when(name != "", name).when(track_type == "COUNTER", F.lit("Counter")).otherwise(F.concat(F.lit("Thread "), tid.cast("string")))
    return F.when(ref != "", F.concat(own, F.lit(" ("), ref, F.lit(")"))).otherwise(own)


def name_hash(name: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, 32 bits, as a long."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(name)), lambda i: F.conv(F.substr(F.hex(F.encode(name, "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    mask = (1 << 32) - 1
    hashed = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda a, b: (a.bitwiseXOR(b) * 16777619).bitwiseAND(mask))
    return F.when(F.octet_length(name) > 0, hashed).otherwise(F.lit(2166136261).cast("bigint"))


def color_class(events: DataFrame) -> DataFrame:
    """Adds color_slot (0 to 7): by ``cname`` where that is reserved, else from the name's hash; 0 without a name.

    Hashes are made once for each distinct name and joined back.
    """
    slot = F.when(F.col("name") == "", 0).otherwise(F.pmod(name_hash(F.col("name")), F.lit(PALETTE_SIZE))).cast("int")
    names = events.select("name").distinct().withColumn("slot", slot)
    reserved = F.create_map(*(F.lit(x) for pair in COLOR_SLOTS.items() for x in pair))
    return events.join(names, "name", "left").withColumn("color_slot", F.coalesce(F.try_element_at(reserved, F.col("cname")), F.col("slot"))).drop("slot")
