"""What a result was made from: digests of records and order, versions; JSON results."""

from __future__ import annotations

import platform

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_digest(records: DataFrame) -> DataFrame:
    """One row: records, whether rec_id is 1..n without gaps or repeats, and a digest that the order of tasks doesn't change."""
    one = F.conv(F.substring(F.sha2(F.concat_ws("\u0001", F.col("rec_id").cast("string"), F.to_json(F.array_sort(F.map_entries("rec")))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return records.agg(F.count("*").alias("records"), ((F.count("*") == F.count_distinct("rec_id")) & (F.min("rec_id") == 1) & (F.max("rec_id") == F.count("*"))).alias("whole"), F.sum(one).cast("string").alias("digest"))


def stamp(records: DataFrame, configuration: dict[str, str]) -> dict[str, str]:
    row = record_digest(records).first()
    return {"records": str(row.records), "whole": str(row.whole), "digest": row.digest or "0", "spark": pyspark.__version__, "python": platform.python_version()} | configuration


def write_json(result: DataFrame, path: str, mark: dict[str, str]) -> None:
    """The result's rows as JSON lines, each with the stamp."""
    m = F.create_map(*[F.lit(x) for kv in sorted(mark.items()) for x in kv])
    result.withColumn("stamp", m).write.mode("overwrite").json(path)


def differences(a: DataFrame, b: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """key, column, left, right where two results with the same columns differ."""
    cols = [c for c in a.columns if c != key and c not in ignore]
    long = lambda df, out: df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])).alias("e")).select(key, "e.column", F.col("e.v").alias(out))
    return long(a, "left").join(long(b, "right"), [key, "column"], "full").filter(~F.col("left").eqNullSafe(F.col("right")))
