"""Helpers shared by the operators: batch bounds, text bytes, input tables, filters of keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fennwick.tables import materialize, shared_dir, spread  # noqa: F401

#: Rows of one Arrow batch. Texts can be long, so far fewer than Spark's default of 10,000.
BATCH_ROWS = 256
#: A filter of keys has 2**FILTER_BITS bits.
FILTER_BITS = 22


def bound_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size, unless the caller has already set one below Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) >= 10000:
        spark.conf.set(key, str(BATCH_ROWS))


def utf8(name: str | Column = "text") -> Column:
    """The text's UTF-8 bytes; null counts as the empty text."""
    column = F.col(name) if isinstance(name, str) else name
    return F.coalesce(column, F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A few rows of the driver's as a table. They go to the JVM as Arrow, as lists would start Python workers of their own in the executors."""
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = [field.split() for field in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array(columns[name], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields]), schema)


def bit_test(keys: DataFrame, column: str = "key"):
    """A test ``of(hash)`` that is true for every 64-bit hash in ``keys``, and false for most others while keys are few.

    2**22 bits in one array, however many keys: a scalar subquery, so the rows tested need not be dealt anew.
    """
    spark, bit = keys.sparkSession, F.pmod(F.col(column), F.lit(1 << FILTER_BITS))
    words = keys.groupBy(F.shiftright(bit, 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits"))
    full = spark.range(1 << FILTER_BITS - 6).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    whole = materialize(full.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("words")), "bits").scalar()

    def of(key: Column) -> Column:
        at = F.pmod(key, F.lit(1 << FILTER_BITS))
        return F.call_function("shiftright", F.get(whole, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return of


def once_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of ``rows`` for each value of a 64-bit hash. Only rows whose hash may be there twice are dealt anew."""
    copies = materialize(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "copies")
    repeated = bit_test(copies, key)(F.col(key))
    return rows.where(~repeated).unionAll(rows.where(repeated).dropDuplicates([key]))
