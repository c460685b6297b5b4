"""Queries on status, propagation, revisions and incremental counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.functions import text as T
from lexibridge.operators import propagation as P
from lexibridge.operators import reports as R
from lexibridge.plans import views as V
from lexibridge.plans.registry import also, query

# documents as translated segments: equal sources by the hash of the whole normalised text.
_ROWS_SQL = f"""rows AS (SELECT d.doc_id AS id, d.source AS project_id, sha256({V.normalize_sql('d.text')}) AS source_key, coalesce(l.quality = 1, false) AS confirmed, CASE d.doc_id % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'llm' WHEN 2 THEN 'tm' WHEN 3 THEN 'project_sync' ELSE 'none' END AS source,
CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'T' || d.doc_id END AS target_text, d.n_chars AS updated_at, d.doc_id % 3 = 0 AS exact, d.doc_id AS place FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = F.col("doc_id") % 5
    return V.table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("project_id"),
        T.source_hash("text").alias("source_key"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("confirmed"),
        F.when(n == 0, "manual").when(n == 1, "llm").when(n == 2, "tm").when(n == 3, "project_sync").otherwise("none").alias("source"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("T"), F.col("doc_id"))).alias("target_text"),
        F.col("n_chars").alias("updated_at"),
        (F.col("doc_id") % 3 == 0).alias("exact"),
        F.col("doc_id").alias("place"),
    )


@query(f"""WITH {_ROWS_SQL} SELECT project_id, CASE WHEN source = 'project_sync' THEN 'project_sync' WHEN exact THEN 'exact' WHEN updated_at > 0 AND target_text <> '' THEN 'fuzzy' ELSE 'none' END AS status, count(*) AS n, count(*) FILTER (WHERE confirmed) AS confirmed FROM rows GROUP BY 1, 2""")
def effective_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = P.effective_status(F.col("source"), F.col("exact"), F.col("target_text"), F.col("updated_at"))
    return _rows(spark, sf_dir).groupBy("project_id", status.alias("status")).agg(F.count("*").alias("n"), F.count_if("confirmed").alias("confirmed"))


@query(f"""WITH {_ROWS_SQL}, c AS (SELECT project_id, count(*) AS total, count(*) FILTER (WHERE target_text <> '') AS done FROM rows GROUP BY 1)
SELECT project_id, total, done, CAST(CASE WHEN done >= total THEN 100 WHEN done <= 0 THEN 0 ELSE least(99, floor(done * 100 / total)) END AS INTEGER) AS progress FROM c""")
def file_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _rows(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(F.col("target_text") != "").alias("done"))
    return counts.withColumn("progress", R.progress(F.col("done"), F.col("total")))


_PRIORITY_SQL = "CASE source WHEN 'manual' THEN 30 WHEN 'llm' THEN 20 WHEN 'llm_review' THEN 20 WHEN 'tm' THEN 10 WHEN 'project_sync' THEN 0 ELSE -1 END"


@query(f"""WITH {_ROWS_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY source_key) AS members, row_number() OVER (PARTITION BY source_key ORDER BY confirmed DESC, {_PRIORITY_SQL} DESC, updated_at DESC, id DESC) AS rank FROM rows WHERE target_text <> '')
SELECT source_key, members, id, target_text, source FROM r WHERE rank = 1 AND members > 1""")
def propagation_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.winners(_rows(spark, sf_dir).where("target_text <> ''"), "source_key")


@query(f"""WITH {_ROWS_SQL}, t AS (SELECT *, CASE WHEN confirmed THEN 0 WHEN exact THEN 1 WHEN target_text <> '' THEN 2 END AS tier FROM rows),
r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY tier, CASE WHEN tier = 0 THEN updated_at END DESC NULLS LAST, place, id) AS rank FROM t WHERE tier IS NOT NULL) SELECT source_key, id, CAST(tier AS INTEGER) AS tier, target_text FROM r WHERE rank = 1""")
def convergence_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.convergence(_rows(spark, sf_dir), "source_key").select("source_key", "id", "tier", "target_text")


for _name in ("propagation_winner", "convergence_winner"):
    also(f"{_name}_whole", _name)


@query(f"""WITH {_ROWS_SQL}, new AS (SELECT * FROM rows WHERE id % 7 <> 0), old AS (SELECT * FROM rows WHERE id % 7 <> 1), u AS (SELECT *, 1 AS sign FROM new UNION ALL SELECT *, -1 FROM old)
SELECT project_id, CAST(sum(sign) AS BIGINT) AS rows, CAST(sum(CASE WHEN confirmed THEN sign ELSE 0 END) AS BIGINT) AS confirmed, CAST(sum(CASE WHEN target_text = '' THEN sign ELSE 0 END) AS BIGINT) AS empty FROM u GROUP BY 1""")
def signed_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    flags = {"confirmed": F.col("confirmed"), "empty": F.col("target_text") == ""}
    changed = P.signed_delta(rows.where("id % 7 <> 1").withColumnRenamed("confirmed", "ok"), rows.where("id % 7 <> 0").withColumnRenamed("confirmed", "ok"), ["project_id"], {"confirmed": F.col("ok"), "empty": flags["empty"]})
    return changed


@query("""SELECT conv_id, role, arg_min(text, turn) AS before_text, arg_max(text, turn) AS after_text, min(turn) AS first_order, count(*) AS revisions FROM conversations GROUP BY 1, 2""")
def revision_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.col("text").alias("before_text"), F.col("text").alias("after_text"))
    return P.collapse_revisions(turns, ["conv_id", "role"], "turn")


@query("SELECT source AS project_id, max(doc_id) AS latest, count(*) FILTER (WHERE n_chars < 400) AS short_in_project FROM documents GROUP BY 1")
def latest_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project_id")).agg(F.max("doc_id").alias("latest"), F.count_if(F.col("n_chars") < 400).alias("short_in_project"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY")
def assignment_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key within a range that the other side gives."""
    orders, lines = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem")
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"))
    return orders.join(lines, on).select("o_orderkey", "l_linenumber")
