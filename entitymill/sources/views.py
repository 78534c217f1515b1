"""Views of messy keyed records and of a usage log, derived from the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, source_file, id_raw, name_raw, alias_a_raw, alias_b_raw, extras_raw); seq is the order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq",
        "CAST(o_orderkey % 3 AS STRING) AS source_file",
        "CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '0' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey + 1000 AS STRING) END AS id_raw",
        "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' Customer ' || CAST(o_custkey AS STRING) || ' ' END AS name_raw",
        "CASE WHEN o_orderkey % 7 = 0 THEN '12' WHEN o_orderkey % 4 = 0 THEN '' ELSE '+1 (555) ' || lpad(CAST((o_custkey + o_orderkey % 2) % 100 AS STRING), 3, '0') || '-' || lpad(CAST(o_custkey % 50 AS STRING), 4, '0') END AS alias_a_raw",
        "CASE WHEN o_orderkey % 9 = 0 THEN 'x!' WHEN o_orderkey % 3 = 0 THEN '' ELSE '@User_' || CAST(o_custkey AS STRING) END AS alias_b_raw",
        "'{\"st\":\"' || o_orderstatus || '\",\"pr\":\"' || o_orderpriority || '\"}' AS extras_raw",
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, us, day, event_type, latency_ms, k, ledger_type, amount, probe)."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.selectExpr(
        "event_id",
        "user_id",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS us",
        "date_format(ts, 'yyyy-MM-dd') AS day",
        "event_type",
        "value AS latency_ms",
        "k",
        "CASE WHEN event_type = 'signup' THEN 'credit' WHEN event_type = 'purchase' THEN 'debit' END AS ledger_type",
        "CAST(CASE WHEN event_type = 'signup' THEN 5 WHEN event_type = 'purchase' THEN 1 + k % 4 END AS BIGINT) AS amount",
        "CASE WHEN k % 17 = 0 THEN 'a!' WHEN k % 3 = 0 THEN CAST(900 + 2 * k AS STRING) WHEN k % 3 = 1 THEN '+1 (555) ' || lpad(CAST(k % 100 AS STRING), 3, '0') || '-' || lpad(CAST(k % 50 AS STRING), 4, '0') ELSE '@User_' || CAST(k AS STRING) END AS probe",
    )
