"""Mail-shaped views over the driver's tables, in Spark and as a DuckDB CTE of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIL_SQL = """mail AS (
  SELECT d.doc_id AS message_id, CAST(e.user_id % 5 AS BIGINT) AS account_id, d.source AS folder, CAST(substr(d.source, 4) AS BIGINT) AS mailbox_id,
    d.lang AS body_lang, d.text AS body_text, 'user' || e.user_id || '@' || e.event_type || '.example' AS from_addr, 'User ' || e.user_id AS from_name,
    left(split_part(d.text, '.', 1), 60) AS subject, ['user' || (e.user_id + 1) || '@example.org', e.event_type || '@list.example'] AS to_addrs,
    CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE e.ts END AS date_sent, CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE e.ts END AS internal_date,
    CASE d.doc_id % 4 WHEN 1 THEN [] WHEN 2 THEN ['report_' || d.doc_id || '.pdf'] WHEN 3 THEN ['100%_done ' || d.doc_id || '.TXT', 'Photo.JPG'] END AS names
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""
EFFECTIVE_SQL = "coalesce(internal_date, date_sent)"
DAY = "yyyy-MM-dd HH:mm:ss"
DAY_SQL = "%Y-%m-%d %H:%M:%S"


#: Tables with whole texts, whose rows cost much more to compute on than to move.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer splits than there are cores (one small file) are dealt to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: documents joined to the event of the same number."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "events"), F.col("event_id") == F.col("doc_id"))
    user, kind, text = F.col("user_id"), F.col("event_type"), F.col("text")
    number = F.col("doc_id").cast("string")
    names = (
        F.when(F.col("doc_id") % 4 == 1, F.array().cast("array<string>"))
        .when(F.col("doc_id") % 4 == 2, F.array(F.concat(F.lit("report_"), number, F.lit(".pdf"))))
        .when(F.col("doc_id") % 4 == 3, F.array(F.concat(F.lit("100%_done "), number, F.lit(".TXT")), F.lit("Photo.JPG")))
    )
    return joined.select(
        F.col("doc_id").alias("message_id"), (user % 5).alias("account_id"), F.col("source").alias("folder"), F.substring("source", 4, 10).cast("long").alias("mailbox_id"),
        F.col("lang").alias("body_lang"), text.alias("body_text"), F.concat(F.lit("user"), user.cast("string"), F.lit("@"), kind, F.lit(".example")).alias("from_addr"),
        F.concat(F.lit("User "), user.cast("string")).alias("from_name"), F.left(F.split_part(text, F.lit("."), F.lit(1)), F.lit(60)).alias("subject"),
        F.array(F.concat(F.lit("user"), (user + 1).cast("string"), F.lit("@example.org")), F.concat(kind, F.lit("@list.example"))).alias("to_addrs"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("date_sent"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("internal_date"),
        F.transform(names, lambda n: F.struct(n.alias("filename"), F.sha2(n, 256).alias("sha256"))).alias("attachments"),
    ).withColumn("effective_date", F.coalesce("internal_date", "date_sent"))


def labels(messages: DataFrame) -> DataFrame:
    return messages.select("message_id", "mailbox_id", F.col("message_id").alias("uid"))


def mailboxes(messages: DataFrame) -> DataFrame:
    return messages.select("mailbox_id", F.concat(F.lit("Box/"), "folder").alias("name")).distinct()


def accounts(spark: SparkSession) -> DataFrame:
    return spark.range(6).select(F.col("id").alias("account_id"), F.concat(F.lit("acct"), F.col("id").cast("string")).alias("name"))
