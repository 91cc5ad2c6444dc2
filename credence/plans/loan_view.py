"""The driver's tables seen as raw loans and as scored rows, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_END, TEST_START = "1999-12-31", "2000-01-01"


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw loan per order, under source names, with untidy strings, line breaks and quotes among them."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    date = F.col("o_orderdate")
    text = lambda c: c.cast("string")
    policy = "Does not meet the credit policy. Status:"
    rows = (read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")))
    return rows.select(
        k.alias("loan_id"),
        F.when(status == "P", "Current")
        .when(status == "F", F.when(k % 5 == 0, f"  {policy}Fully Paid").otherwise("Fully Paid"))
        .otherwise(F.when(k % 5 == 0, f"{policy}Charged Off").when(k % 5 == 1, " DEFAULT ").otherwise("Charged Off")).alias("status"),
        F.when(k % 7 == 0, F.date_format(date, "yyyy-MM-dd")).otherwise(F.date_format(date, "MMM-yyyy")).alias("issue_month"),
        F.col("o_totalprice").cast("double").alias("loan_amount"),
        F.when(F.col("c_acctbal") < 0, None).when(F.col("c_custkey") % 17 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal").cast("double") * 10).alias("annual_income"),
        F.when(k % 97 == 0, "n/a").otherwise(F.concat(text(k * 7 % 40), F.lit("."), text(k % 10))).alias("debt_to_income"),
        F.concat(text(k * 13 % 121), F.lit(".5%")).alias("revolUtil"),
        (k * 31 % 9000).alias("total_credit_utilized"), (k % 10 * 1000).alias("total_credit_limit"),
        (300 + 5 * (k * 31 % 110)).cast("int").alias("fico_range_low"), (304 + 5 * (k * 31 % 110)).cast("int").alias("fico_range_high"),
        F.when(k % 3 == 0, " 36 months").otherwise(" 60 months").alias("term"),
        F.when(k % 53 != 0, F.substring("o_orderpriority", 1, 1)).alias("grade_digit"),
        F.col("c_mktsegment").alias("homeownership"), F.col("n_name").alias("state"),
        (F.col("o_totalprice").cast("double") / 2).alias("total_pymnt"), F.lit(0.0).alias("recoveries"),
        F.concat(F.lit("https://example.test/"), text(k)).alias("url"),
        F.when(k % 6 == 0, "line one\nline two, more").when(k % 6 == 1, 'he said "pay, now" ok').when(k % 6 == 2, "ends with \\")
        .when(k % 6 == 3, 'C:\\new\r\n"quoted"').alias("desc"),
    ).withColumn("grade_digit", F.translate("grade_digit", "12345", "ABCDE")).withColumnRenamed("grade_digit", "grade")


RAW_SQL = r"""raw AS (SELECT o_orderkey AS k, o_orderkey AS loan_id,
  CASE o_orderstatus WHEN 'P' THEN 'Current'
    WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Does not meet the credit policy. Status:Fully Paid' ELSE 'Fully Paid' END
    ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'Does not meet the credit policy. Status:Charged Off' WHEN o_orderkey % 5 = 1 THEN 'DEFAULT' ELSE 'Charged Off' END END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS TIMESTAMP) ELSE date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) END AS issue_d,
  CAST(o_totalprice AS DOUBLE) AS loan_amnt,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 0.0 ELSE CAST(c_acctbal AS DOUBLE) * 10 END AS annual_inc,
  CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE (o_orderkey * 7 % 40) || '.' || (o_orderkey % 10) END AS dti,
  (o_orderkey * 13 % 121) || '.5%' AS revol_util,
  o_orderkey * 31 % 9000 AS total_credit_utilized, o_orderkey % 10 * 1000 AS total_credit_limit,
  300 + 5 * (o_orderkey * 31 % 110) AS fico_range_low, 304 + 5 * (o_orderkey * 31 % 110) AS fico_range_high,
  CASE WHEN o_orderkey % 3 = 0 THEN ' 36 months' ELSE ' 60 months' END AS term,
  CASE WHEN o_orderkey % 53 <> 0 THEN translate(substr(o_orderpriority, 1, 1), '12345', 'ABCDE') END AS grade,
  c_mktsegment AS home_ownership, n_name AS addr_state,
  CAST(o_totalprice AS DOUBLE) / 2 AS total_pymnt, 0.0 AS recoveries, 'https://example.test/' || o_orderkey AS url,
  CASE o_orderkey % 6 WHEN 0 THEN 'line one' || chr(10) || 'line two, more' WHEN 1 THEN 'he said "pay, now" ok' WHEN 2 THEN 'ends with \'
    WHEN 3 THEN 'C:\new' || chr(13) || chr(10) || '"quoted"' END AS "desc"
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

#: Closed loans with label and features, as SQL.
LOANS_SQL = RAW_SQL + """,
closed AS (SELECT *, CASE WHEN status LIKE '%Fully Paid' THEN 0 ELSE 1 END AS default_flag FROM raw WHERE status <> 'Current'),
loans AS (SELECT *, CASE WHEN dti <> 'n/a' THEN CAST(dti AS DOUBLE) END AS dti_clean,
  CAST(replace(revol_util, '%', '') AS DOUBLE) / 100 AS credit_utilization,
  (fico_range_low + fico_range_high) / 2.0 AS fico_midpoint,
  CASE WHEN fico_range_low + 2 < 580 THEN 'poor' WHEN fico_range_low + 2 < 670 THEN 'fair' WHEN fico_range_low + 2 < 740 THEN 'good'
    WHEN fico_range_low + 2 < 800 THEN 'very_good' ELSE 'exceptional' END AS fico_band,
  loan_amnt / nullif(annual_inc, 0) AS loan_to_income_ratio FROM closed)"""


def scored_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Informative scores with many ties."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus <> 'P'")
    default = F.col("o_orderstatus") == "O"
    return orders.select(default.cast("int").alias("label"),
                         ((F.col("o_orderkey") * 7919 % 1000 + F.when(default, 150).otherwise(0)) / F.lit(1150.0)).alias("score"))


def scored_items(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Near-unique scores, or eleven distinct ones."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    value = F.col("l_discount").cast("double") * 10 if coarse else F.least(F.col("l_extendedprice").cast("double") / F.lit(105000.0), F.lit(1.0))
    return items.select((F.col("l_returnflag") == "R").cast("int").alias("label"), value.alias("score"))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select((F.col("event_type") == "error").cast("int").alias("label"), F.least(F.col("value").cast("double") / F.lit(500.0), F.lit(1.0)).alias("score"))


SCORED_SQL = {
    "loans": "SELECT CAST(o_orderstatus = 'O' AS INT) AS label, (o_orderkey * 7919 % 1000 + CASE WHEN o_orderstatus = 'O' THEN 150 ELSE 0 END) / 1150.0::DOUBLE AS score FROM orders WHERE o_orderstatus <> 'P'",
    "items": "SELECT CAST(l_returnflag = 'R' AS INT) AS label, least(CAST(l_extendedprice AS DOUBLE) / 105000.0::DOUBLE, 1.0::DOUBLE) AS score FROM lineitem",
    "ties": "SELECT CAST(l_returnflag = 'R' AS INT) AS label, CAST(l_discount AS DOUBLE) * 10 AS score FROM lineitem",
    "events": "SELECT CAST(event_type = 'error' AS INT) AS label, least(CAST(value AS DOUBLE) / 500.0::DOUBLE, 1.0::DOUBLE) AS score FROM events",
}

SCORED = {"loans": scored_loans, "items": scored_items, "ties": lambda spark, sf_dir: scored_items(spark, sf_dir, coarse=True), "events": scored_events}
