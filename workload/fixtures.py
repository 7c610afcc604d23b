"""Views over the given tables that feed the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlake import session
from dossierlake.operators import chunking as ck, search as se
from dossierlake.session import scratch_folder, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over all cores: the text work after it is heavy and the test file has one row group."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def stored(df: DataFrame) -> DataFrame:
    """A table written once and read by several legs of one query."""
    return session.stored(df, "table")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("corpus_key"))
    return stored(ck.retrieval_chunks(docs, keep=("corpus_key",)))


def index(spark: SparkSession, sf_dir: str) -> se.Index:
    """The corpus as stored at ingest: postings, term statistics and vectors."""
    return se.write_tables(ck.searchable(chunks(spark, sf_dir)), scratch_folder(spark, "index"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BENCHMARK_QUERIES = "SELECT item_id AS query_id, text FROM benchmark"


def doc_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows. Types and projects are dealt out over the documents by id."""
    kind = F.element_at(F.array(*[F.lit(t) for t in ("memoire", "programme", "rc", "unspecified")]),
                        (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.format_string("%s_%d.pdf", "source", "doc_id").alias("file_name"), kind.alias("doc_type"),
        F.when(F.col("doc_id") % 4 == 1, F.col("doc_id") % 10).alias("project_id"), "n_chars",
        F.col("source").alias("corpus_key"))


DOC_META = """doc_meta AS (SELECT doc_id, source || '_' || doc_id || '.pdf' AS file_name,
  ['memoire', 'programme', 'rc', 'unspecified'][doc_id % 4 + 1] AS doc_type,
  CASE WHEN doc_id % 4 = 1 THEN doc_id % 10 END AS project_id, n_chars, source AS corpus_key FROM documents)"""


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as appended: labelled documents were registered a second time under another name."""
    meta = doc_meta(spark, sf_dir).select("doc_id", "file_name", "doc_type", F.lit(0).alias("ord"))
    again = table(spark, sf_dir, "labels").select("doc_id", F.lit("again.pdf").alias("file_name"),
                                                  F.lit("rc").alias("doc_type"), F.lit(1).alias("ord"))
    return meta.unionByName(again)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
    cust = table(spark, sf_dir, "customer")
    return cust.join(first, cust.c_custkey == first.o_custkey, "left").select(
        F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("client_name"),
        F.lit("active").alias("status"), "created_at", F.col("created_at").alias("updated_at"))


def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "F", "memoire").otherwise("programme").alias("doc_type"),
        F.col("o_orderdate").alias("added_at"))


PROJECTS = """projects AS (SELECT c_custkey AS project_id, c_name AS name, c_mktsegment AS client_name, 'active' AS status,
  created_at, created_at AS updated_at FROM customer LEFT JOIN
  (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
PROJECT_DOCUMENTS = """project_documents AS (SELECT o_custkey AS project_id, o_orderkey AS doc_id,
  CASE WHEN o_orderstatus = 'F' THEN 'memoire' ELSE 'programme' END AS doc_type, o_orderdate AS added_at FROM orders)"""


def reshaped(spark: SparkSession, sf_dir: str, spark_expr: str, columns: str = "doc_id") -> DataFrame:
    """Documents with their lines rewritten by an expression over (line x, 0-based index i)."""
    lines = f"array_join(transform(split(text, '\\n'), (x, i) -> {spark_expr}), '\\n')"
    return documents(spark, sf_dir).selectExpr(columns, f"{lines} AS text")


def reshaped_sql(sql_expr: str, name: str = "docs", columns: str = "doc_id") -> str:
    """The same in DuckDB, where the index j counts from 1 and i = j - 1 is written out."""
    body = sql_expr.replace("{i}", "(j - 1)")
    return f"{name} AS (SELECT {columns}, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: {body}), chr(10)) AS text FROM documents)"


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed: each line is a page, every third page with an image comment."""
    page = ("transform(split(text, '\\n'), (x, i) -> struct(i + 1 AS page, "
            "CASE WHEN i % 3 = 0 THEN concat(x, '\\n\\n\\n\\n<!-- image -->') ELSE x END AS text))")
    return documents(spark, sf_dir).selectExpr("doc_id", f"{page} AS pages")


def styled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as paragraphs: every fourth line is a heading of some level."""
    style = ("CASE WHEN i % 4 = 0 THEN concat('Heading ', 1 + (doc_id + i) % 9) "
             "WHEN i % 4 = 2 AND doc_id % 3 = 0 THEN 'titre 2' ELSE 'Normal' END")
    return documents(spark, sf_dir).selectExpr(
        "doc_id", f"transform(split(text, '\\n'), (x, i) -> struct({style} AS style, x AS text)) AS paragraphs")


STYLED = """paras AS (SELECT doc_id, i, level, trim(t, chars) AS t FROM (SELECT doc_id, i, t, {chars} AS chars,
    CASE WHEN (i - 1) % 4 = 0 THEN 1 + (doc_id + i - 1) % 9 WHEN (i - 1) % 4 = 2 AND doc_id % 3 = 0 THEN 2 END AS level
  FROM (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS t FROM
    (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))))"""

START = 1704067200  # first second of the fixture's conversations


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored history has user and assistant rows only; a turn each minute, a conversation each two hours."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    return conv.select("conv_id", (F.lit(START) + F.col("conv_id") * 7200 + F.col("turn") * 60).alias("ts"),
                       F.when(F.col("role") == "user", 0).otherwise(1).alias("part"), "role", "text")


TURNS = f"""turns AS (SELECT conv_id, {START} + conv_id * 7200 + turn * 60 AS ts, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS part, role, text
  FROM conversations WHERE role IN ('user', 'assistant'))"""


def questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(questions, earlier turns): the last user turn of each conversation is the new question.

    Its documents are those of one source.
    """
    all_turns = turns(spark, sf_dir)
    last = all_turns.filter("part = 0").groupBy("conv_id").agg(F.max("ts").alias("at"), F.max_by("text", "ts").alias("text"))
    asked = last.select(F.col("conv_id").alias("query_id"), "conv_id", "at", F.concat(F.lit("src"), F.col("conv_id") % 20).alias("corpus_key"), "text")
    earlier = all_turns.join(last.select("conv_id", "at"), "conv_id").filter(F.col("ts") < F.col("at")).drop("at")
    return asked, earlier


QUESTIONS = [TURNS, """asked AS (SELECT conv_id AS query_id, conv_id, max(ts) AS at_ts, 'src' || conv_id % 20 AS corpus_key, max_by(text, ts) AS text
  FROM turns WHERE part = 0 GROUP BY conv_id)""",
  """recent AS (SELECT t.*, row_number() OVER (PARTITION BY t.conv_id ORDER BY ts DESC, part DESC) AS r FROM turns t JOIN asked a USING (conv_id) WHERE ts < at_ts)""",
  """hist AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Utilisateur' ELSE 'Assistant' END || ' : ' || text, chr(10) ORDER BY r DESC) AS history
  FROM recent WHERE r <= 6 GROUP BY 1)"""]


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("running")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"),
                                                 (F.col("event_id") % 10).alias("current"), F.lit(10).alias("total"))


JOB_EVENTS = """job_events AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'running' END AS status,
  event_id % 10 AS current, 10 AS total FROM events)"""
