"""Views of the test tables as the tables of a translation workplace, with their SQL forms.

documents are files of segments, benchmark is a translation memory, conversations are
bilingual segments (a user turn and the assistant turn after it), events are metric events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.functions import text as T

SEGMENT_END = "[\n.]+"
#: The day that relative reports look back from.
AS_OF = "2024-01-30"


#: Tables whose texts cost far more to look through than to move.
TEXTS = ("documents", "pages", "conversations", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts in no more partitions than the session has cores is dealt out to all of them.

    Files of a single row group would keep one core busy. A table large enough to fill the cluster is never moved.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() <= cores else rows


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt out to all cores, for work that costs far more than moving them: a file's few row groups keep as few cores busy."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def _split(df: DataFrame, *keys: str) -> DataFrame:
    """Non-empty segments of the text with their places."""
    parts = df.select(*keys, F.posexplode(F.split("text", SEGMENT_END)).alias("seg_idx", "part"))
    return parts.select(*keys, "seg_idx", F.trim("part").alias("source_text")).where("source_text <> ''")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, project_id, lang, seg_idx, source_text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("project_id"), "lang", "text")
    return _split(docs, "file_id", "project_id", "lang")


def memory_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, collection_id, source_text, target_text: a deterministic pseudo-translation."""
    parts = _split(table(spark, sf_dir, "benchmark"), "item_id")
    return parts.select((F.col("item_id") * 1000 + F.col("seg_idx")).alias("entry_id"), (F.col("item_id") % 3).alias("collection_id"), "source_text", F.concat(F.lit("T "), F.col("source_text")).alias("target_text"))


def bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, source_text, target_text: each user turn with the assistant's next turn."""
    turns = table(spark, sf_dir, "conversations")
    user, reply = turns.where("role = 'user'"), turns.where("role = 'assistant'")
    return user.alias("u").join(reply.alias("r"), (F.col("u.conv_id") == F.col("r.conv_id")) & (F.col("r.turn") == F.col("u.turn") + 1)).select(F.col("u.conv_id"), F.col("u.turn"), F.col("u.text").alias("source_text"), F.col("r.text").alias("target_text"))


#: What segments with faults end in, and by the remainder of conv_id + turn what is put into the end of the target instead.
SOUND_END = " <b>x</b> 12 {name} a@b.org http://x.org/y $ Aa."
FAULTY_ENDS = [
    " x 12 {name} a@b.org http://x.org/y $ Aa.",
    " <b>x</b> 13 {name} a@b.org http://x.org/y $ Aa.",
    " <i>x</i> 12 {nom} a@b.org http://x.org/y $ Aa.",
    " <b>x</b> 12 {name} c@b.org http://x.org/y $ Aa.",
    " <b>x</b> 12 {name} a@b.org http://x.org/z $ Aa.",
    " <b>x</b> 12 {name} a@b.org http://x.org/y € Aa.",
    " <b>x</b>  12 {name}   a@b.org http://x.org/y $ Aa. ",
    " <b>x</b> 12 {name} a@b.org http://x.org/y $ , aA .  Aa.\t",
    " <b>x</b> 12 {name} a@b.org http://x.org/y $ one,two Two;b Aa!",
    " <b>x</b> 12 {name} a@b.org http://x.org/y $ CamelCase, NoteBook and CamelCase Aa",
    " <b>x</b> (12 {name} a@b.org] http://x.org/y $ word word!! Aa.",
    SOUND_END,
]


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilingual segments whose targets have each kind of fault somewhere and are sound elsewhere; some equal their sources, some are cut short."""
    kind, ends = (F.col("conv_id") + F.col("turn")) % 13, F.array(*[F.lit(e) for e in FAULTY_ENDS])
    rows = bilingual(spark, sf_dir).withColumn("kind", kind.cast("int")).withColumn("source_text", F.concat("source_text", F.lit(SOUND_END)))
    return rows.withColumn("target_text", F.when(F.col("kind") == 12, F.col("source_text")).when(F.col("kind") == 3, F.concat(F.left("target_text", F.lit(3)), F.lit(" Aa."))).otherwise(F.concat("target_text", F.get(ends, F.col("kind"))))).drop("kind")


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, source, words, target_was_empty, model, lang_pair, created_at."""
    events = table(spark, sf_dir, "events")
    source = F.element_at(F.create_map(*[F.lit(x) for pair in SOURCE_OF.items() for x in pair]), F.col("event_type"))
    return events.select(
        "event_id",
        F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("user_id"),
        source.alias("source"),
        F.floor(F.abs("value")).cast("long").alias("words"),
        (F.col("event_id") % 2 == 0).alias("target_was_empty"),
        F.concat(F.lit("m"), F.col("event_id") % 9).alias("model"),
        (F.col("event_id") % 20).alias("project_no"),
        F.col("ts").alias("created_at"),
    )


SOURCE_OF = {"click": "manual", "view": "tm", "purchase": "llm", "signup": "llm_review", "error": "project_sync"}

# The same views as common table expressions.
SEGMENTS_SQL = r"""segments AS (
    SELECT file_id, project_id, lang, seg_idx, trim(part) AS source_text FROM (
        SELECT doc_id AS file_id, source AS project_id, lang, unnest(string_split_regex(text, '[\n.]+')) AS part,
               generate_subscripts(string_split_regex(text, '[\n.]+'), 1) - 1 AS seg_idx FROM documents)
    WHERE trim(part) <> '')"""
MEMORY_SQL = r"""memory AS (
    SELECT item_id * 1000 + seg_idx AS entry_id, item_id % 3 AS collection_id, trim(part) AS source_text, 'T ' || trim(part) AS target_text FROM (
        SELECT item_id, unnest(string_split_regex(text, '[\n.]+')) AS part, generate_subscripts(string_split_regex(text, '[\n.]+'), 1) - 1 AS seg_idx FROM benchmark)
    WHERE trim(part) <> '')"""
BILINGUAL_SQL = """bilingual AS (
    SELECT u.conv_id, u.turn, u.text AS source_text, r.text AS target_text FROM conversations u JOIN conversations r
    ON u.conv_id = r.conv_id AND r.turn = u.turn + 1 WHERE u.role = 'user' AND r.role = 'assistant')"""
_QUOTED = lambda t: "'" + t.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"
FAULTY_SQL = f"""{BILINGUAL_SQL}, faulty AS (
    SELECT conv_id, turn, source_text || {_QUOTED(SOUND_END)} AS source_text, CASE WHEN (conv_id + turn) % 13 = 12 THEN source_text || {_QUOTED(SOUND_END)} WHEN (conv_id + turn) % 13 = 3 THEN left(target_text, 3) || ' Aa.'
           ELSE target_text || ([{', '.join(map(_QUOTED, FAULTY_ENDS))}])[CAST((conv_id + turn) % 13 AS INTEGER) + 1] END AS target_text FROM bilingual)"""
EVENTS_SQL = """metric AS (
    SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN user_id END AS user_id,
           CASE event_type WHEN 'click' THEN 'manual' WHEN 'view' THEN 'tm' WHEN 'purchase' THEN 'llm' WHEN 'signup' THEN 'llm_review' WHEN 'error' THEN 'project_sync' END AS source,
           CAST(floor(abs(value)) AS BIGINT) AS words, event_id % 2 = 0 AS target_was_empty, 'm' || (event_id % 9) AS model, event_id % 20 AS project_no, ts AS created_at FROM events)"""


def normalize_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '[\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{200B}}-\x{{200D}}\x{{FEFF}}]', ' ', 'g'), '[\s\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), ' +([。！？!?.，,、；;：:）)\]}}])', '\1', 'g'))"


def match_sql(x: str) -> str:
    return rf"trim(regexp_replace({normalize_sql(x)}, '[。！？!?.]+$', ''))"


def core_sql(x: str) -> str:
    return rf"regexp_replace({match_sql(x)}, '[^\pL\pN_]+', '', 'g')"


def hashed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).withColumn("source_hash", T.source_hash("source_text"))


HASHED_SQL = f"{SEGMENTS_SQL}, hashed AS (SELECT *, sha256({normalize_sql('source_text')}) AS source_hash FROM segments)"
