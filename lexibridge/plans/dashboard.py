"""Dashboard queries over metric events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.operators import reports as R
from lexibridge.plans import views as V
from lexibridge.plans.registry import query

#: Labels of event sources.
LABELS = {"manual": "Manual", "tm": "Translation memory", "llm": "LLM", "llm_review": "LLM review", "project_sync": "Project sync"}
LLM = ("llm", "llm_review")


@query(f"""WITH {V.EVENTS_SQL} SELECT source, CASE source WHEN 'manual' THEN 'Manual' WHEN 'tm' THEN 'Translation memory' WHEN 'llm' THEN 'LLM' WHEN 'llm_review' THEN 'LLM review' WHEN 'project_sync' THEN 'Project sync' END AS label,
count(*) AS events, CAST(sum(words) AS BIGINT) AS words FROM metric GROUP BY source""")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return V.metric_events(spark, sf_dir).groupBy("source").agg(F.count("*").alias("events"), F.sum("words").alias("words")).select("source", F.element_at(labels, F.col("source")).alias("label"), "events", "words")


_SERIES_SQL = """WITH {events}, spine AS (SELECT strftime(d, '{form}') AS bucket FROM (SELECT unnest(generate_series({first}, {last}, INTERVAL 1 {unit})) AS d)),
s AS (SELECT strftime(created_at, '{form}') AS bucket, count(*) AS created, sum(CASE WHEN target_was_empty THEN words ELSE 0 END) AS new_words, sum(CASE WHEN source IN ('llm', 'llm_review') THEN words ELSE 0 END) AS llm_words, count(DISTINCT user_id) AS users FROM metric GROUP BY 1)
SELECT spine.bucket, CAST(coalesce(created, 0) AS BIGINT) AS created, CAST(coalesce(new_words, 0) AS BIGINT) AS new_words, CAST(coalesce(llm_words, 0) AS BIGINT) AS llm_words, CAST(coalesce(users, 0) AS BIGINT) AS users FROM spine LEFT JOIN s ON s.bucket = spine.bucket"""


def _series(spark: SparkSession, sf_dir: str, unit: str, steps: int) -> DataFrame:
    words = F.col("words")
    return R.dense_series(
        V.metric_events(spark, sf_dir),
        R.spine(spark, V.AS_OF, steps, unit),
        R.bucket(F.col("created_at"), unit),
        created=F.count("*"),
        new_words=F.sum(F.when(F.col("target_was_empty"), words).otherwise(0)),
        llm_words=F.sum(F.when(F.col("source").isin(*LLM), words).otherwise(0)),
        users=F.countDistinct("user_id"),
    )


@query(_SERIES_SQL.format(events=V.EVENTS_SQL, form="%Y-%m-%d", first="DATE '2024-01-01'", last="DATE '2024-01-30'", unit="DAY"))
def series_day_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, "day", 30)


@query(_SERIES_SQL.format(events=V.EVENTS_SQL, form="%Y-%m", first="DATE '2023-02-01'", last="DATE '2024-01-01'", unit="MONTH"))
def series_month_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, "month", 12)


@query(f"""WITH {V.EVENTS_SQL}, t AS (SELECT model, sum(words) AS words, row_number() OVER (ORDER BY sum(words) DESC, model) AS rank, count(*) OVER () AS names FROM metric WHERE source IN ('llm', 'llm_review') GROUP BY model)
SELECT CASE WHEN names > 6 AND rank > 5 THEN '__other__' ELSE model END AS model, CAST(sum(words) AS BIGINT) AS words FROM t GROUP BY 1""")
def model_series_topn_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = V.metric_events(spark, sf_dir).where(F.col("source").isin(*LLM)).groupBy("model").agg(F.sum("words").alias("words"))
    return R.top_with_rest(totals, "model", "words", 5)


@query(f"""WITH {V.EVENTS_SQL}, daily AS (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n, epoch(date_trunc('second', max(created_at))) - epoch(date_trunc('second', min(created_at))) AS seconds FROM metric GROUP BY 1, 2),
activity AS (SELECT user_id, count(*) AS days, sum(n) AS requests, sum(greatest(1, ceil(seconds / 60))) AS minutes FROM daily GROUP BY 1),
work AS (SELECT user_id, sum(CASE WHEN target_was_empty THEN words ELSE 0 END) AS new_words, sum(CASE WHEN target_was_empty THEN 0 ELSE words END) AS modified_words FROM metric GROUP BY 1)
SELECT a.user_id, coalesce(c_name, CASE WHEN a.user_id IS NULL THEN '__unassigned__' ELSE '__unknown__' END) AS display_name, CAST(days AS BIGINT) AS days, CAST(requests AS BIGINT) AS requests, CAST(minutes AS BIGINT) AS minutes, CAST(new_words AS BIGINT) AS new_words, CAST(modified_words AS BIGINT) AS modified_words,
row_number() OVER (ORDER BY new_words + modified_words DESC, minutes DESC, requests DESC, coalesce(c_name, ''), a.user_id) AS place
FROM activity a FULL JOIN work w ON a.user_id IS NOT DISTINCT FROM w.user_id LEFT JOIN customer ON c_custkey = a.user_id AND c_custkey % 7 <> 3""")
def user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity and words by user; events of no user are one row, users without a name another kind."""
    events = V.metric_events(spark, sf_dir)
    daily = events.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    activity = daily.groupBy("user_id").agg(F.count("*").alias("days"), F.sum("n").alias("requests"), F.sum(R.active_minutes(F.col("first"), F.col("last"), F.col("n"))).alias("minutes"))
    work = events.groupBy(F.col("user_id").alias("w_user")).agg(F.sum(F.when(F.col("target_was_empty"), F.col("words")).otherwise(0)).alias("new_words"), F.sum(F.when(F.col("target_was_empty"), 0).otherwise(F.col("words"))).alias("modified_words"))
    users = V.table(spark, sf_dir, "customer").where("c_custkey % 7 <> 3").select("c_custkey", "c_name")
    both = activity.join(work, F.col("user_id").eqNullSafe(F.col("w_user")), "full").join(users, F.col("c_custkey") == F.col("user_id"), "left")
    name = F.coalesce("c_name", F.when(F.col("user_id").isNull(), "__unassigned__").otherwise("__unknown__"))
    # The report is ordered as a whole: one row per user.
    from pyspark.sql import Window

    order = Window.orderBy(F.desc(F.col("new_words") + F.col("modified_words")), F.desc("minutes"), F.desc("requests"), F.coalesce("c_name", F.lit("")), F.asc_nulls_last("user_id"))
    return both.select("user_id", name.alias("display_name"), "days", "requests", "minutes", "new_words", "modified_words", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {V.EVENTS_SQL}, files AS (SELECT lang AS language, count(*) AS files, count(DISTINCT source) AS projects, sum(n_chars) AS chars FROM documents GROUP BY lang),
langs AS (SELECT *, row_number() OVER (ORDER BY language) - 1 AS no FROM files), e AS (SELECT project_no % 5 AS no, sum(words) AS llm_words, count(DISTINCT project_no) AS event_projects FROM metric WHERE source IN ('llm', 'llm_review') GROUP BY 1)
SELECT coalesce(language, '__none__') AS language, CAST(coalesce(files, 0) AS BIGINT) AS files, CAST(coalesce(projects, 0) AS BIGINT) AS projects, CAST(coalesce(chars, 0) AS BIGINT) AS chars, CAST(coalesce(llm_words, 0) AS BIGINT) AS llm_words, CAST(coalesce(event_projects, 0) AS BIGINT) AS event_projects FROM langs FULL JOIN e USING (no)""")
def language_pair_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by language joined with events by language number; either side may lack a partner."""
    from pyspark.sql import Window

    files = V.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("files"), F.countDistinct("source").alias("projects"), F.sum("n_chars").alias("chars"))
    langs = files.withColumn("no", (F.row_number().over(Window.orderBy("language")) - 1).cast("long"))
    events = V.metric_events(spark, sf_dir).where(F.col("source").isin(*LLM)).groupBy((F.col("project_no") % 5).alias("no")).agg(F.sum("words").alias("llm_words"), F.countDistinct("project_no").alias("event_projects"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return langs.join(events, "no", "full").select(F.coalesce("language", F.lit("__none__")).alias("language"), *map(zero, ("files", "projects", "chars", "llm_words", "event_projects")))


@query(f"""WITH {V.EVENTS_SQL} SELECT (SELECT count(DISTINCT source) FROM documents) AS projects, (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM metric) AS events, (SELECT CAST(sum(words) AS BIGINT) FROM metric) AS words,
(SELECT count(DISTINCT user_id) FROM metric WHERE CAST(created_at AS DATE) = DATE '2024-01-30') AS active_today, (SELECT round(count(*) FILTER (WHERE quality = 1) * 100.0 / count(*), 1) FROM labels) AS progress""")
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, events = V.table(spark, sf_dir, "documents"), V.metric_events(spark, sf_dir)
    today = F.to_date("created_at") == F.to_date(F.lit(V.AS_OF))
    a = docs.agg(F.countDistinct("source").alias("projects"), F.count("*").alias("files"))
    b = events.agg(F.count("*").alias("events"), F.sum("words").alias("words"), F.countDistinct(F.when(today, F.col("user_id"))).alias("active_today"))
    c = V.table(spark, sf_dir, "labels").agg(R.percent(F.count(F.when(F.col("quality") == 1, 1)), F.count("*")).alias("progress"))
    # One row each, so the products are one row.
    return a.join(b, F.lit(True)).join(c, F.lit(True))


@query(f"""WITH {V.EVENTS_SQL} SELECT source, model, CAST(grouping(source, model) AS BIGINT) AS level, count(*) AS events, CAST(sum(words) AS BIGINT) AS words FROM metric GROUP BY ROLLUP (source, model)""")
def source_model_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.metric_events(spark, sf_dir).rollup("source", "model").agg(F.grouping_id().alias("level"), F.count("*").alias("events"), F.sum("words").alias("words"))


@query("SELECT lang AS language, source AS project_id, count(*) AS files FROM documents GROUP BY ALL")
def language_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language"), F.col("source").alias("project_id")).agg(F.count("*").alias("files"))


@query(f"""WITH {V.EVENTS_SQL} SELECT event_id FROM metric m WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = m.event_id)""")
def backfill_events_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that no file answers to."""
    return V.metric_events(spark, sf_dir).join(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id")), "event_id", "left_anti").select("event_id")
