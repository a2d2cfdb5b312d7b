"""The domain's tables, derived from the given ones, in Spark and as SQL for the oracles."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(x: Column | str, digits: int = 4) -> Column:
    """Round at 0.7 of the last digit: means of few prices often end in exactly half of it, where
    the order of summation would decide."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 10**digits + 0.3) / 10**digits


def cut_sql(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + 0.3) / 1e{digits}"


def digest_sql(*columns: str) -> str:
    """``digest_number`` in SQL; doubles have to be cast to decimals by the caller."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), chr(92) || 'N')" for c in columns)})), 1, 15) AS BIGINT)"


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of events: ``event_id, step, type, amount, sender, dest, label``; step is an hour from 1."""
    e = read(spark, sf_dir, "events")
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    return e.select(
        "event_id",
        (F.floor(micros / 3.6e9) + 1).alias("step"),
        F.col("event_type").alias("type"),
        F.col("value").alias("amount"),
        F.col("user_id").alias("sender"),
        F.get_json_object("props", "$.k").cast("long").alias("dest"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


EVT = """evt AS (SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9) AS BIGINT) + 1 AS step,
  event_type AS type, value AS amount, user_id AS sender, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS dest,
  CAST(event_type = 'error' AS INTEGER) AS label FROM events)"""


#: Orders that a task joins, about, in tables of more than eight times as many.
JOIN_ROWS = 1 << 18


def dealt(orders: DataFrame, key: str = "o_orderkey") -> DataFrame:
    """Large tables are dealt by ``key`` over a number of tasks that grows with their rows; left alone, a join's
    partitions are put together until there is about one a core, so what a task sorts grows with the table."""
    parts = -(-orders.count() // JOIN_ROWS)
    return orders.repartition(max(parts, int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key) if parts > 8 else orders


def ords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of orders with balances: payer the customer, payee the least supplier of the order."""
    o, c, s = (read(spark, sf_dir, n) for n in ("orders", "customer", "supplier"))
    first = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("dest"))
    o = dealt(o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice", "o_orderstatus"))
    j = o.join(first, "o_orderkey").join(c, o.o_custkey == c.c_custkey).join(s, F.col("dest") == s.s_suppkey)
    return j.select(
        F.col("o_orderkey").alias("event_id"),
        (F.datediff("o_orderdate", F.lit("1995-01-01")) + 1).cast("long").alias("step"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_custkey").alias("sender"),
        "dest",
        F.col("c_acctbal").alias("sender_old"),
        F.round(F.col("c_acctbal") - F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).otherwise(0.0), 2).alias("sender_new"),
        F.col("s_acctbal").alias("dest_old"),
        F.round(F.col("s_acctbal") + F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).otherwise(0.0), 2).alias("dest_new"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


ORD = """ord AS (SELECT o_orderkey AS event_id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 1 AS step,
  o_orderpriority AS type, o_totalprice AS amount, o_custkey AS sender, dest, c_acctbal AS sender_old,
  round(c_acctbal - CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE 0 END, 2) AS sender_new, s_acctbal AS dest_old,
  round(s_acctbal + CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice ELSE 0 END, 2) AS dest_new,
  CAST(o_orderstatus = 'F' AS INTEGER) AS label
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS dest FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = dest)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a probability that follows from the amount, so that oracles are exact."""
    return evt(spark, sf_dir).withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("amount") / 500)))


SCORES = EVT + ", scores AS (SELECT *, least(1.0, greatest(0.0, amount / 500)) AS p FROM evt)"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which keys repeat with other contents: line items by order and line."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.format_string("%d-%d", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.struct("l_partkey", "l_suppkey").alias("payload"),
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").alias("shipped_at"),
        "l_extendedprice",
        F.col("l_quantity").alias("quantity"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as predictions, with a probability from their size."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("transaction_id"),
        (F.pmod("n_chars", F.lit(1000)) / 1000).alias("p"),
        (F.pmod("n_chars", F.lit(1000)) >= 500).cast("int").alias("prediction"),
        "source",
        "lang",
        (F.col("doc_id") * 60).alias("made_at"),
    )


PRED = """pred AS (SELECT doc_id AS transaction_id, (n_chars % 1000) / 1000 AS p, CAST(n_chars % 1000 >= 500 AS INTEGER) AS prediction,
  source, lang, doc_id * 60 AS made_at FROM documents)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as label submissions: the outcome is the parity of the text's length."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("transaction_id"),
        "turn",
        F.col("role").alias("source_type"),
        F.pmod(F.length("text"), F.lit(2)).alias("outcome"),
        F.when(F.col("turn") == 3, F.format_string("s-%d-%d", "conv_id", F.lit(2))).otherwise(F.format_string("s-%d-%d", "conv_id", "turn")).alias("submission_id"),
    )


SUB = """sub AS (SELECT conv_id AS transaction_id, turn, role AS source_type, CAST(length(text) % 2 AS INTEGER) AS outcome,
  's-' || conv_id || '-' || CASE WHEN turn = 3 THEN 2 ELSE turn END AS submission_id FROM conversations)"""
