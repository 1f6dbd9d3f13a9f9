"""Registry of the queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with its SQL if it has any."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# One paragraph a line of every document; documents have no blank lines at their ends in this form.
LINES_SQL = "lines AS (SELECT doc_id, idx - 1 AS idx, parts[idx] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents) q)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))


# The line items of an order, in a total order, as a numbered list.
ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
SEQ_SQL = "seq AS (SELECT l_orderkey AS seq_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS pos, CAST(l_linenumber AS BIGINT) AS ordinal FROM lineitem)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq_key"), rank.alias("pos"), F.col("l_linenumber").cast("long").alias("ordinal"))
