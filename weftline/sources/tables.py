"""The tables in the roles that the queries need: jobs, licences, users, segments, pairs, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed clocks, so that results can be repeated.
NOW = "1998-10-15 00:00:00"
EVENTS_NOW = "2024-01-20 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now(at: str = NOW):
    return F.lit(at).cast("timestamp_ntz")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, status, created_at, priority, price."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


JOBS_SQL = "(SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at, o_orderpriority AS priority, o_totalprice AS price FROM orders)"


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, customer_id, key_hash, tier, status, issued_at, expired_at."""
    p = F.substring("o_orderpriority", 1, 1)
    tier = F.when(p.isin("1", "2"), "ENTERPRISE").when(p == "3", "PRO").otherwise("TRIAL")
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "EXPIRED").otherwise("PENDING")
    issued = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("key_hash"), tier.alias("tier"), status.alias("status"), issued.alias("issued_at"), F.when(F.col("o_orderkey") % 50 != 0, issued + F.make_dt_interval(F.lit(365))).alias("expired_at"))


LICENSES_SQL = "(SELECT o_orderkey AS id, o_custkey AS customer_id, sha256(o_orderkey::VARCHAR) AS key_hash, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'ENTERPRISE' WHEN o_orderpriority[1] = '3' THEN 'PRO' ELSE 'TRIAL' END AS tier, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'EXPIRED' ELSE 'PENDING' END AS status, o_orderdate AS issued_at, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate + INTERVAL 365 DAY END AS expired_at FROM orders)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, email, is_superuser, workspace_id (the nation's first user)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("email"), (F.col("c_custkey") % 100 == 0).alias("is_superuser"), (F.col("c_nationkey") + 1).cast("long").alias("workspace_id"), (F.col("c_acctbal") >= 0).alias("is_active"))


USERS_SQL = "(SELECT c_custkey AS id, lower(c_name) AS email, c_custkey % 100 = 0 AS is_superuser, (c_nationkey + 1)::BIGINT AS workspace_id, c_acctbal >= 0 AS is_active FROM customer)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, line, text: a document's lines."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))


SEGMENTS_SQL = "(SELECT doc_id AS job_id, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, seq, source_text, translated_text: a user's turn and the assistant's answer to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("turn").over(w).alias("t2"), F.lead("text").over(w).alias("x2"))
    return c.filter("role = 'user' AND r2 = 'assistant' AND t2 = turn + 1").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.col("text").alias("source_text"), F.col("x2").alias("translated_text"))


PAIRS_SQL = "(SELECT conv_id AS job_id, turn AS seq, text AS source_text, x2 AS translated_text FROM (SELECT *, lead(role) OVER w AS r2, lead(turn) OVER w AS t2, lead(text) OVER w AS x2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r2 = 'assistant' AND t2 = turn + 1)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
