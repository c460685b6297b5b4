"""Streaming queries run to completion over the events table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexibridge.plans import views as V
from lexibridge.plans.memory import fuzzy_sql
from lexibridge.plans.registry import query
from lexibridge.streaming import deltas as D
from lexibridge.streaming import incremental as I


def _folder(spark: SparkSession) -> str:
    """A folder that all executors share: the cluster's checkpoint folder; a temporary one only on a session without executors."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/streams/{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream; watermarks need instants."""
    schema = V.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _completed(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there, into Parquet in the shared folder."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is repeated writes its own folder anew.
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def stream_daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _completed(I.daily_activity(_events(spark, sf_dir)), "update")
    # In update mode a day may be written by several batches; the last has the most requests.
    return done.groupBy("user_id", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.max("requests").alias("requests"), F.min("first_seen").cast("timestamp_ntz").alias("first_seen"), F.max("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("SELECT DISTINCT user_id * 1000 + event_id % 50 AS event_key FROM events")
def stream_dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _events(spark, sf_dir).withColumn("event_key", F.col("user_id") * 1000 + F.col("event_id") % 50)
    return _completed(I.deduplicated(keyed, late="400 days").select("event_key"), "append")


@query()
def stream_rematch_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _events(spark, sf_dir).select((F.col("user_id") % 5).alias("collection_id"), "ts")
    return _completed(I.rematch_triggers(changes), "append")


@query("SELECT user_id % 10 AS project_id, event_type AS source_key, max(event_id) AS event_id, max(ts) AS ts, count(*) AS coalesced FROM events GROUP BY 1, 2")
def outbox_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = V.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("project_id"), F.col("event_type").alias("source_key"), "ts").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"))
    return I.coalesced(feed, ["project_id", "source_key"], "ts").join(feed.groupBy("project_id", "source_key").agg(F.sum("n").alias("total"), F.max("event_id").alias("top")), ["project_id", "source_key"]).select("project_id", "source_key", F.col("top").alias("event_id"), "ts", F.col("total").alias("coalesced"))


@query("""WITH w AS (SELECT user_id, unnest([time_bucket(INTERVAL 6 HOURS, ts), time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS]) AS start FROM events)
SELECT user_id, start, start + INTERVAL 12 HOURS AS stop, count(*) AS requests FROM w GROUP BY 1, 2""")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every user in windows of twelve hours that begin every six."""
    done = _completed(I.sliding_activity(_events(spark, sf_dir), "6 hours", "12 hours", late="400 days"), "update")
    return done.groupBy("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop")).agg(F.max("requests").alias("requests"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 HOURS THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT user_id, min(ts) AS start, max(ts) AS "last", count(*) AS requests FROM s GROUP BY user_id, n""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a pause of thirty hours."""
    rows = V.table(spark, sf_dir, "events")
    return I.sessions(rows, "30 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "requests")


@query(f"""WITH d AS (SELECT doc_id % 3 AS collection_id, lang AS source_language, text AS source_text, 'T' || doc_id AS target_text, doc_id AS updated_at, sha256({V.normalize_sql("text")}) AS source_hash FROM documents WHERE doc_id % 2 = 0 AND {V.normalize_sql("text")} <> '')
SELECT collection_id, source_language, source_hash, max_by(target_text, updated_at) AS target_text, max(updated_at) AS updated_at, count(*) AS coalesced FROM d GROUP BY 1, 2, 3""")
def memory_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed documents on their way to a memory, the last of equal sources."""
    i = F.col("doc_id")
    rows = V.table(spark, sf_dir, "documents").select((i % 3).alias("collection_id"), F.col("lang").alias("source_language"), F.lit("xx").alias("target_language"), F.col("text").alias("source_text"), F.concat(F.lit("T"), i).alias("target_text"), (i % 2 == 0).alias("confirmed"), i.alias("updated_at"))
    return I.memory_outbox(rows).select("collection_id", "source_language", "source_hash", "target_text", "updated_at", "coalesced")


@query("""SELECT user_id AS key, CASE WHEN bool_or(event_type = 'purchase' AND value > 100) THEN 'done' WHEN count(*) >= 3 THEN 'failed' ELSE 'pending' END AS state, count(*) AS attempts FROM events GROUP BY 1""")
def outbox_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), ((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("ok"))
    return I.outbox_states(tries)


@query("""WITH s AS (SELECT doc_id, doc_id % 3 = 0 AS confirmed, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'mine' END AS target, doc_id % 5 <> 0 AS met FROM documents)
SELECT doc_id AS segment_id, CASE WHEN NOT confirmed AND met AND target = '' THEN 'T' || doc_id ELSE target END AS target_text, CAST(CASE WHEN NOT confirmed AND met THEN 0.5 + doc_id % 2 * 0.25 ELSE 0.5 END AS DOUBLE) AS score, CASE WHEN NOT confirmed AND met AND (doc_id % 2 = 1 OR target = '') THEN 2 ELSE 1 END AS version FROM s""")
def rematched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments after a rematch."""
    i = F.col("doc_id")
    docs = V.table(spark, sf_dir, "documents")
    rows = docs.select(i.alias("segment_id"), (i % 3 == 0).alias("confirmed"), F.when(i % 2 == 0, "").otherwise("mine").alias("target_text"), F.lit("m").alias("matched_text"), F.lit(0.5).alias("score"), F.lit(1).alias("version"))
    new = docs.where(i % 5 != 0).select(i.alias("segment_id"), F.lit("m").alias("matched_text"), (F.lit(0.5) + i % 2 * 0.25).alias("score"), F.concat(F.lit("T"), i).alias("matched_target"))
    return I.refreshed(rows, new).select("segment_id", "target_text", "score", "version")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN -1 END, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT)) AS words FROM documents")
def backfilled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts filled in where there were none."""
    rows = V.table(spark, sf_dir, "documents").withColumn("words", F.when(F.col("doc_id") % 4 == 0, F.lit(-1).cast("long")))
    return I.backfilled(rows, "words", F.regexp_count("text", F.lit("[A-Za-z0-9]+")).cast("long")).select("doc_id", "words")


@query("SELECT user_id, max(ts) AS ts, max_by(struct_pack(event_id := event_id, event_type := event_type), struct_pack(ts := ts, event_id := event_id)).event_type AS event_type, true AS known FROM events GROUP BY user_id")
def delta_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user from a delta table: batches come out of order, one twice, and are compacted in between."""
    path, events = f"{_folder(spark)}/latest", V.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    merge = D.latest(["user_id"], "ts")
    add = D.writer(path, ["user_id"], merge, 16)
    for number, part in enumerate((3, 0, 0, 2, 1)):
        add(events.where(F.floor(F.col("event_id") / 7) % 4 == part), number)
        if number == 2:
            D.compact(spark, path, events.schema, ["user_id"], merge, 16)
            add(events.where(F.floor(F.col("event_id") / 7) % 4 == 0), 2)
    return D.read(spark, path, events.schema, merge).select("user_id", "ts", "event_type", F.lit(True).alias("known"))


@query("SELECT event_type AS status, CAST(count(*) AS BIGINT) AS segments FROM (SELECT user_id, max_by(event_type, struct_pack(ts := ts, event_id := event_id)) AS event_type FROM events GROUP BY user_id) GROUP BY 1")
def delta_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their present status, from signed changes: each event takes a user out of the status before and into its own."""
    path, order = f"{_folder(spark)}/counters", Window.partitionBy("user_id").orderBy("ts", "event_id")
    changes = V.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("after"), F.lag("event_type").over(order).alias("before"))
    signed = I.signed_changes(changes, "before", "after", "status").select("event_id", "status", F.col("change").alias("segments"))
    schema, merge = signed.drop("event_id").schema, D.summed(["status"], "segments")
    add = D.writer(path, ["status"], merge, 4)
    for number in (2, 0, 1):
        add(signed.where(F.col("event_id") % 3 == number).drop("event_id"), number)
    D.compact(spark, path, schema, ["status"], merge, 4)
    add(signed.where("event_id % 3 = 1").drop("event_id"), 1)
    return D.read(spark, path, schema, merge)


_AFFECTED_SQL = f"""{V.MEMORY_SQL}, changed AS (SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN source_text ELSE source_text || ' and more' END AS source_text FROM memory WHERE entry_id % 4 = 1),
segs AS (SELECT entry_id * 2 + n AS segment_id, source_text, sha256({V.normalize_sql("source_text")}) AS h FROM memory, (VALUES (0), (1)) v(n) WHERE (entry_id + n) % 5 <> 0), texts AS (SELECT h AS query_id, min(source_text) AS text FROM segs GROUP BY 1),
equal_ones AS (SELECT sha256({V.normalize_sql("source_text")}) AS query_id, min(entry_id) AS entry_id FROM changed GROUP BY 1 HAVING query_id IN (SELECT query_id FROM texts))"""


@query(f"""WITH {_AFFECTED_SQL}, {fuzzy_sql("texts", "changed")}, found AS (SELECT query_id, entry_id, 1.0::DOUBLE AS similarity FROM equal_ones UNION ALL SELECT r.query_id, r.entry_id, r.similarity FROM ranked r ANTI JOIN equal_ones USING (query_id, entry_id))
SELECT segment_id, entry_id, similarity FROM segs JOIN found ON h = query_id""")
def affected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory texts as segments, twice each, a fifth of them confirmed; a quarter of the entries changed."""
    memory = V.memory_entries(spark, sf_dir).select("entry_id", "source_text")
    i = F.col("entry_id")
    changed = memory.where(i % 4 == 1).select("entry_id", F.when(i % 3 == 0, F.col("source_text")).otherwise(F.concat("source_text", F.lit(" and more"))).alias("source_text"))
    twice = memory.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select((i * 2 + F.col("n")).alias("segment_id"), "source_text", ((i + F.col("n")) % 5 == 0).alias("confirmed"))
    return I.affected_segments(twice, changed)
