"""Parity of two event stores: duplicate ids, rows on one side, columns that differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EPSILON = 2.220446049250313e-16


def _same(left: Column, right: Column, real: bool) -> Column:
    return F.coalesce(F.abs(left - right) <= EPSILON, left.isNull() & right.isNull()) if real else left.eqNullSafe(right)


def differences(left: DataFrame, right: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, field, detail) of all mismatches; order by all three for a report.

    Ids that stand twice on a side are told as such; the rows are compared as one full outer join.
    """
    columns = [c for c in left.columns if c != key]
    twice = [side.groupBy(key).count().filter("count > 1").select(key, F.lit(key).alias("field"), F.lit(f"duplicate in {name}").alias("detail")) for side, name in ((left, "left"), (right, "right"))]
    a = left.select(key, F.struct(*columns).alias("a"))
    b = right.select(key, F.struct(*columns).alias("b"))
    reals = {f.name for f in left.schema if isinstance(f.dataType, DoubleType)}
    found = F.array_compact(F.array(*(F.when(~_same(F.col(f"a.{c}"), F.col(f"b.{c}"), c in reals), F.lit(c)) for c in columns)))
    fields = F.when(F.col("a").isNull(), F.array(F.lit("missing_left"))).when(F.col("b").isNull(), F.array(F.lit("missing_right"))).otherwise(found)
    rows = a.join(b, key, "full_outer").select(key, F.explode(fields).alias("field"))
    detail = F.when(F.col("field") == "missing_left", "row is only on the right").when(F.col("field") == "missing_right", "row is only on the left").otherwise("values differ")
    return reduce(DataFrame.unionByName, twice, rows.withColumn("detail", detail))


def report(left: DataFrame, right: DataFrame, parse_errors: int = 0) -> dict:
    found = [r.asDict() for r in differences(left, right).orderBy("event_id", "field", "detail").collect()]
    n, m = left.count(), right.count()
    return {"left_records": n, "right_records": m, "parse_errors": parse_errors, "count_difference": m - n, "mismatches": found, "ok": not found and not parse_errors and n == m}
