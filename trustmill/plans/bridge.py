"""The star-schema tables seen as the event model, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The clocks of the order tables and of the event stream.
NOW, STREAM_NOW = "TIMESTAMP '1998-08-02 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "m_events": """
SELECT o.o_orderkey AS event_id, c.c_name AS organizer_name, c.c_mktsegment AS category, n.n_name AS city,
  CASE o.o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'P' THEN 'UPDATED' ELSE 'DISCOVERED' END AS status,
  CASE substr(o.o_orderpriority,1,1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' WHEN '4' THEN 'D' ELSE 'E' END AS publishing_tier,
  o.o_orderdate AS first_seen,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_orderdate + (o.o_orderkey % 10) * INTERVAL '1' DAY END AS last_verified,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL '30' DAY END AS registration_deadline,
  CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL '45' DAY END AS start_date,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL '46' DAY END AS end_date
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "m_links": """
SELECT l_orderkey AS event_id, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice,
  CASE l_linestatus WHEN 'O' THEN 'REGISTRATION' ELSE 'EVENT_PAGE' END AS url_type,
  CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_shipdate END AS last_checked
FROM lineitem""",
    "m_event_sources": """
SELECT l_orderkey AS event_id, l_suppkey AS source_id, l_partkey AS source_url_id,
  CAST(1 + l_linenumber % 7 AS INT) AS source_level, l_shipdate AS observed_at FROM lineitem""",
    "m_sources": """
SELECT s_suppkey AS source_id, s_name AS name, CAST(floor(abs(s_acctbal)) AS INT) % 101 AS trust_score,
  CAST(s_nationkey % 2 AS INT) AS enabled FROM supplier""",
    "m_outcomes": """
SELECT event_id AS seq, ts AS observed_at, user_id AS source_id,
  CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'signup' THEN 'valid' WHEN 'click' THEN 'dead_link' WHEN 'error' THEN 'fake' ELSE 'duplicate' END AS outcome FROM events""",
    "m_notifications": """
SELECT event_id AS notification_id, event_id % 500 AS event_id, CAST(user_id % 4 AS INT) AS target_id,
  CASE event_type WHEN 'purchase' THEN 'CORRECTION' WHEN 'error' THEN 'REMINDER_24' ELSE 'ALERT' END AS template,
  CASE WHEN event_id % 4 = 0 THEN 'QUEUED' WHEN event_id % 4 = 1 THEN 'FAILED' WHEN event_id % 4 = 2 THEN 'SUPPRESSED' ELSE 'SENT' END AS status, ts AS created_at FROM events""",
    "m_targets": """
SELECT * FROM (VALUES (0, ''), (1, '{"categories":["BUILDING","MACHINERY"]}'), (2, '{"cities":["INDIA","CHINA"],"categories":["BUILDING"]}'), (3, 'not json')) AS t(target_id, filter)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = [t for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    if name == "m_targets":
        return spark.sql(sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def with_views(*names: str) -> str:
    """The head of an oracle query over some of the views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names) + "\n"
