"""Driver tables -> ``labelled_stream(stream, ts, id, x, y)``.

Each builder has a DuckDB twin (``*_SQL``) used by the correctness oracles, so
both engines start from the same rows.  Features are integers or integers/64
so that sums are exact in binary and fold results compare across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlearn.sources.tables import read_table

# Event types in sorted order (one-hot layout of the period fixture).
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def user_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-user: one stream per user; x = [floor(value)/64, hour/8, 1]; y = +1 for purchases."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("stream"),
        F.col("ts"),
        F.col("event_id").alias("id"),
        F.array(F.floor("value").cast("double") / 64.0,
                F.hour("ts").cast("double") / 8.0,
                F.lit(1.0)).alias("x"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(-1.0).alias("y"),
    )


USER_SQL = """SELECT CAST(user_id AS VARCHAR) AS stream, ts, event_id AS id,
  [floor(value)::DOUBLE / 64.0, hour(ts)::DOUBLE / 8.0, 1.0::DOUBLE] AS x,
  CASE WHEN event_type = 'purchase' THEN 1.0 ELSE -1.0 END::DOUBLE AS y
FROM events"""


def line_stream(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """F-line: lineitem as one large labelled stream, or one per value of a column (``l_partkey``).

    Order is (l_shipdate, id, x, y) with id = 8*l_orderkey + l_linenumber; rows
    that tie on all of these are identical, so any order among them gives the
    same fold.
    """
    li = read_table(spark, sf_dir, "lineitem")
    stream = F.col(by).cast("string") if by else F.lit("all")
    return li.select(stream.alias("stream"), *_line_columns())


def _line_columns():
    return [
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"),
        F.array(F.col("l_quantity") / 64.0,
                F.col("l_linenumber").cast("double"),
                F.round(F.col("l_discount") * 100.0) / 64.0,
                F.round(F.col("l_tax") * 100.0) / 64.0).alias("x"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"),
    ]


def line_sql(by: str | None = None) -> str:
    stream = f"CAST({by} AS VARCHAR)" if by else "'all'"
    return f"""SELECT {stream} AS stream, l_shipdate AS ts,
  CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id,
  [l_quantity / 64.0, l_linenumber::DOUBLE, round(l_discount * 100.0) / 64.0,
   round(l_tax * 100.0) / 64.0] AS x,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE -1.0 END::DOUBLE AS y
FROM lineitem"""


def emb_stream(spark: SparkSession, sf_dir: str, label_mode: str = "threshold") -> DataFrame:
    """F-emb: 64-d embeddings as a digits-like table; y = +1 for label >= 5."""
    em = read_table(spark, sf_dir, "embeddings")
    if label_mode == "threshold":
        y = F.when(F.col("label") >= 5, 1.0).otherwise(-1.0)
    elif label_mode == "parity":
        y = F.when(F.pmod(F.col("label"), F.lit(2)) == 1, 1.0).otherwise(-1.0)
    else:
        y = F.when(F.col("label") != 0, 1.0).otherwise(-1.0)
    return em.select(
        F.lit("all").alias("stream"),
        F.timestamp_seconds(F.col("vec_id")).alias("ts"),
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        y.alias("y"),
        F.col("label"),
    )


EMB_SQL = """SELECT 'all' AS stream, to_timestamp(vec_id)::TIMESTAMP AS ts, vec_id AS id,
  CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label >= 5 THEN 1.0 ELSE -1.0 END::DOUBLE AS y, label
FROM embeddings"""


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw per-event rows in the cyber-log shape: timestamp, user_id, one-hot
    event-type features and a 0/1 ``label`` (1 for errors)."""
    ev = read_table(spark, sf_dir, "events")
    cols = [F.col("ts").alias("timestamp"), F.col("user_id")]
    cols += [F.when(F.col("event_type") == t, 1.0).otherwise(0.0).alias(f"n_{t}") for t in EVENT_TYPES]
    cols += [F.floor("value").cast("double").alias("value_floor"),
             F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label")]
    return ev.select(*cols)


EVENT_FEATURES_SQL = ("SELECT ts AS timestamp, user_id, "
                      + ", ".join(f"CASE WHEN event_type = '{t}' THEN 1.0 ELSE 0.0 END::DOUBLE AS n_{t}" for t in EVENT_TYPES)
                      + ", floor(value)::DOUBLE AS value_floor, "
                        "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events")


def task_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-task: one task per event type; x = [floor(value)/64, k/128, 1]; y = +1 when value > 50."""
    return _task_rows(read_table(spark, sf_dir, "events"))


def _task_rows(ev: DataFrame, *more) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select(
        F.col("event_type").alias("stream"),
        F.col("ts"),
        F.col("event_id").alias("id"),
        F.array(F.floor("value").cast("double") / 64.0, k / 128.0, F.lit(1.0)).alias("x"),
        F.when(F.col("value") > 50, 1.0).otherwise(-1.0).alias("y"),
        *more,
    )


TASK_SQL = """SELECT event_type AS stream, ts, event_id AS id,
  [floor(value)::DOUBLE / 64.0, CAST(json_extract(props, '$.k') AS DOUBLE) / 128.0, 1.0::DOUBLE] AS x,
  CASE WHEN value > 50 THEN 1.0 ELSE -1.0 END::DOUBLE AS y
FROM events"""


def rare_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-rare: labelled documents per language; x = [n_chars/4096, 1]; y = +1 when toxic."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id")
    return j.select(
        F.col("lang").alias("stream"),
        F.timestamp_seconds(F.col("doc_id")).alias("ts"),
        F.col("doc_id").alias("id"),
        F.array(F.col("n_chars").cast("double") / 4096.0, F.lit(1.0)).alias("x"),
        F.when(F.col("toxic") == 1, 1.0).otherwise(-1.0).alias("y"),
    )


RARE_SQL = """SELECT d.lang AS stream, to_timestamp(d.doc_id)::TIMESTAMP AS ts, d.doc_id AS id,
  [d.n_chars::DOUBLE / 4096.0, 1.0::DOUBLE] AS x,
  CASE WHEN l.toxic = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS y
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def user_task_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-task split by user: ``task`` is the event type, one stream per (event type, user)."""
    t = _task_rows(read_table(spark, sf_dir, "events"), F.col("user_id").cast("string").alias("user"))
    return t.select(F.concat_ws("/", "stream", "user").alias("stream"), F.col("stream").alias("task"), "user", "ts", "id", "x", "y")


USER_TASK_SQL = f"""SELECT t.stream || '/' || CAST(e.user_id AS VARCHAR) AS stream, t.stream AS task, CAST(e.user_id AS VARCHAR) AS "user",
  t.ts, t.id, t.x, t.y FROM ({TASK_SQL}) t JOIN events e ON e.event_id = t.id"""


# Line numbers, the tasks of a line-task stream in round order.
LINE_TASKS = ["1", "2", "3", "4", "5", "6", "7"]


def line_task_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-line-task: the lineitems of eight suppliers are one stream, the line number is its ``task``; x and y as in F-line."""
    group = F.floor(F.col("l_suppkey") / 8).cast("long").cast("string")
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(group.alias("stream"), F.col("l_linenumber").cast("string").alias("task"), *_line_columns())


LINE_TASK_SQL = line_sql().replace("SELECT 'all' AS stream", "SELECT CAST(l_suppkey // 8 AS VARCHAR) AS stream, CAST(l_linenumber AS VARCHAR) AS task")


def team_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-team: sixteen users are one stream; x and y as in F-user."""
    team = F.floor(F.col("stream").cast("long") / 16).cast("long").cast("string")
    return user_stream(spark, sf_dir).withColumn("stream", team)


TEAM_SQL = USER_SQL.replace("CAST(user_id AS VARCHAR)", "CAST(user_id // 16 AS VARCHAR)")
