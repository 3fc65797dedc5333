"""Messages and their parts: the join, rollups and the roles' kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Role -> (record_format, event_type, role) of a message.
ROLE_KINDS = {
    "user": ("message", "prompt", "user"),
    "assistant": ("message", "response", "assistant"),
    "system": ("system", "system_notice", "system"),
    "tool": ("tool_result", "tool_output", "tool"),
}
OTHER_KIND = ("diagnostic", "debug_log", "runtime")


def kind_struct(kind: tuple[str, str, str]) -> Column:
    return F.struct(F.lit(kind[0]).alias("record_format"), F.lit(kind[1]).alias("event_type"), F.lit(kind[2]).alias("role"))


def role_kind(role: Column) -> Column:
    """struct<record_format, event_type, role> of a role name."""
    out = kind_struct(OTHER_KIND)
    for name, kind in ROLE_KINDS.items():
        out = F.when(role == name, kind_struct(kind)).otherwise(out)
    return out


def with_role_kind(df: DataFrame, role: str) -> DataFrame:
    return df.withColumn("__k", role_kind(F.col(role))).withColumns({"record_format": F.col("__k.record_format"), "event_type": F.col("__k.event_type")}).drop("__k")


def join_parts(messages: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with their parts in order, parts without a message).

    Of several messages with one (session_id, message_id) only the first in the input has the parts.
    A message without parts has an empty list.
    """
    key = ["session_id", "message_id"]
    others = [c for c in parts.columns if c not in (*key, "part_id")]
    grouped = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part_id", *others))).alias("parts"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("input_seq"))
    joined = messages.withColumn("__place", place).join(grouped, key, "left")
    mine = F.when(F.col("__place") == 1, F.col("parts"))
    empty = F.filter(F.coalesce("parts", F.array().cast(grouped.schema["parts"].dataType)), lambda _: F.lit(False))
    return joined.withColumn("parts", F.coalesce(mine, empty)).drop("__place"), parts.join(messages, key, "left_anti")


def session_rollup(messages: DataFrame) -> DataFrame:
    """A row for each session: messages, first and last created_at as text, sorted distinct roles, models and providers."""
    distinct = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"),
        F.min("created_at").alias("first_created_at"),
        F.max("created_at").alias("last_created_at"),
        distinct("role", "roles"),
        distinct("model", "models"),
        distinct("provider", "providers"),
    )
