"""Queries of entry lists, work lists, imports, numbers and lexicons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexibridge.functions import text as T
from lexibridge.functions.sentences import sentences
from lexibridge.operators import imports as I
from lexibridge.operators import lexicon as L
from lexibridge.operators import numbers as N
from lexibridge.operators import search as S
from lexibridge.operators import terms as TM
from lexibridge.operators import worklists as W
from lexibridge.operators.segmenting import simple_spans
from lexibridge.plans import views as V
from lexibridge.plans.registry import query

LONG = "long"


@query("SELECT doc_id FROM documents WHERE text ILIKE '%th_n%' OR source ILIKE '%th_n%'")
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcards in the text that is looked for keep their meaning."""
    return V.table(spark, sf_dir, "documents").where(S.contains(["text", "source"], "TH_N")).select("doc_id")


@query(r"SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(text, ' the ', ' the_') WHEN 1 THEN text || ' 100%' ELSE text END AS text FROM documents) WHERE contains(lower(text), '_') OR contains(lower(text), '00%') OR contains(lower(text), '@example')")
def search_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcards that stand for themselves, in documents of which some hold them."""
    rest = F.col("doc_id") % 5
    text = F.when(rest == 0, F.replace("text", F.lit(" the "), F.lit(" the_"))).when(rest == 1, F.concat("text", F.lit(" 100%"))).otherwise(F.col("text"))
    docs = V.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return docs.where(S.contains_literally(["text"], "_") | S.contains_literally(["text"], "00%") | S.contains_literally(["text"], "@Example")).select("doc_id")


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic IN (0)")
def entries_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chosen(V.table(spark, sf_dir, "labels"), quality=1, toxic=[0]).select("doc_id")


@query("SELECT p_partkey, p_name, p_retailprice, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey DESC LIMIT 50 OFFSET 100")
def entries_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty by price, with the number of all entries."""
    rows = V.table(spark, sf_dir, "part")
    got, total = S.page(rows, S.ordering("price", {"price": "p_retailprice", "name": "p_name"}, True, "p_partkey"), 3, 50)
    return got.select("p_partkey", "p_name", "p_retailprice", F.lit(total).cast(LONG).alias("total"))


@query("SELECT o_orderkey, c_name AS customer, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def hydrated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = V.table(spark, sf_dir, "customer")
    orders = V.table(spark, sf_dir, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    named = S.hydrated(orders, customers, {"customer": "o_custkey"}, "c_custkey", "c_name")
    return S.hydrated(named, V.table(spark, sf_dir, "nation"), {"nation": "c_nationkey"}, "n_nationkey", "n_name").select("o_orderkey", "customer", "nation")


@query(f"WITH {V.SEGMENTS_SQL}, {V.MEMORY_SQL}, b AS (SELECT source_text, max_by(target_text, entry_id) AS target_text FROM memory GROUP BY 1) SELECT b.source_text, b.target_text FROM b WHERE source_text IN (SELECT source_text FROM segments)")
def target_text_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.target_map(V.segments(spark, sf_dir), V.memory_entries(spark, sf_dir))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("file_id"), F.col("l_orderkey").alias("segment_id"), F.col("l_returnflag").alias("category"))


@query("""WITH i AS (SELECT l_suppkey % 20 AS file_id, l_orderkey AS segment_id, l_returnflag AS category FROM lineitem), p AS (SELECT file_id, segment_id, category, count(*) AS n FROM i GROUP BY 1, 2, 3), k AS (SELECT file_id, segment_id, count(*) AS kinds, sum(n) AS n FROM p GROUP BY 1, 2)
SELECT file_id, category, CAST(sum(n) AS BIGINT) AS items, count(*) AS segments, CAST(NULL AS BIGINT) AS several FROM p GROUP BY GROUPING SETS ((file_id, category), (category))
UNION ALL SELECT file_id, NULL, CAST(sum(n) AS BIGINT), count(*), count(*) FILTER (WHERE kinds > 1) FROM k GROUP BY GROUPING SETS ((file_id), ())""")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.report_counts(_items(spark, sf_dir))


@query("""SELECT l_suppkey % 20 AS file_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY l_orderkey % 7, coalesce(CASE WHEN l_linenumber > 1 THEN l_linenumber END, -1), l_partkey % 3, l_orderkey, l_linenumber) AS place FROM lineitem""")
def report_item_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the items of every file; rows that are missing come first."""
    rows = V.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("file_id"), (F.col("l_orderkey") % 7).alias("block"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("row"), (F.col("l_partkey") % 3).alias("cell"), F.col("l_orderkey").alias("sentence"), "l_orderkey", "l_linenumber")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(*S.report_order(), "l_linenumber"))
    return rows.select("file_id", "l_orderkey", "l_linenumber", place.cast(LONG).alias("place"))


@query(r"""WITH w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS word, generate_subscripts(string_split(lower(text), ' '), 1) AS pos FROM benchmark), f AS (SELECT item_id, word, min(pos) AS pos FROM w WHERE word <> '' GROUP BY 1, 2)
SELECT item_id, string_agg(word, ' ' ORDER BY pos) AS words FROM f GROUP BY 1""")
def ordered_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(S.ordered_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


@query("""SELECT k.key, CAST(coalesce(sum(floor(abs(e.value))), 0) AS BIGINT) AS words, count(e.event_id) AS segments FROM (VALUES ('click'), ('view'), ('exact')) k(key) LEFT JOIN events e ON e.event_type = k.key GROUP BY 1""")
def merged_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the known keys alone; a key that no analysis has counts 0."""
    parts = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.floor(F.abs("value")).cast(LONG).alias("words"), F.lit(1).cast(LONG).alias("segments"))
    return S.merged_analyses(parts, ["click", "view", "exact"]).select("key", "words", "segments")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments: status, target, confirmation and metadata by their ids."""
    i = F.col("doc_id")
    docs = V.table(spark, sf_dir, "documents")
    return docs.select(
        i.alias("segment_id"), F.col("source").alias("file_id"), F.col("text").alias("source_text"), F.when(i % 3 == 0, "").when(i % 3 == 1, F.concat(F.lit("T "), F.col("text"))).alias("target_text"),
        F.when(i % 4 == 0, "exact").when(i % 4 == 1, "fuzzy").when(i % 4 == 2, "none").otherwise("project_sync").alias("status"), (i % 5 == 0).alias("confirmed"), (i % 11 == 0).alias("sync_disabled"),
        F.concat(F.lit('{"runs":[{"format":"b"},{"format":"'), F.when(i % 7 == 0, "i").otherwise("b"), F.lit('"}]}')).alias("metadata"),
    )


_TASKS_SQL = """tasks AS (SELECT doc_id AS segment_id, source AS file_id, text AS source_text, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'T ' || text END AS target_text,
CASE doc_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'none' ELSE 'project_sync' END AS status, doc_id % 5 = 0 AS confirmed, doc_id % 11 = 0 AS sync_disabled, doc_id % 7 = 0 AS two_styles FROM documents)"""
_SCOPED = " UNION ALL ".join([f"SELECT '{s}' AS scope, segment_id FROM tasks WHERE status IN ({', '.join(repr(x) for x in v)})" for s, v in W.SCOPES.items()] + ["SELECT 'empty_target_only', segment_id FROM tasks WHERE coalesce(target_text, '') = ''"])


@query(f"WITH {_TASKS_SQL} {_SCOPED}")
def translation_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work list of every scope."""
    rows, out = _tasks(spark, sf_dir), None
    for scope in [*W.SCOPES, "empty_target_only"]:
        own = W.in_translation_scope(rows, scope).select(F.lit(scope).alias("scope"), "segment_id")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH {_TASKS_SQL} SELECT file_id, count(*) FILTER (WHERE coalesce(target_text, '') <> '' AND (confirmed OR status = 'exact')) AS protected, count(*) FILTER (WHERE NOT sync_disabled AND coalesce(target_text, '') <> '' AND confirmed) AS eligible,
count(*) FILTER (WHERE NOT sync_disabled AND coalesce(target_text, '') <> '') AS eligible_any, count(*) FILTER (WHERE two_styles) AS styled, count(*) FILTER (WHERE status IN ('fuzzy', 'none') AND coalesce(target_text, '') = '') AS wanted FROM tasks GROUP BY 1""")
def segment_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that models leave alone, that may propagate, that hold several styles, that references would translate."""
    rows = W.reference_tasks(_tasks(spark, sf_dir), "all", True)
    return rows.groupBy("file_id").agg(
        F.count_if(W.is_protected(F.col("status") == "exact")).alias("protected"), F.count_if(W.may_propagate()).alias("eligible"), F.count_if(W.may_propagate(False)).alias("eligible_any"),
        F.count_if(W.has_several_styles()).alias("styled"), F.count_if("wanted").alias("wanted"),
    )


_REVIEW_SQL = f"""{V.BILINGUAL_SQL}, r AS (SELECT conv_id * 1000 + turn AS segment_id, CAST(conv_id % 2 AS VARCHAR) AS language, source_text, target_text, sha256({V.normalize_sql("source_text")}) AS source_hash FROM bilingual),
g AS (SELECT language, source_hash, min_by(source_text, segment_id) AS source_text, count(DISTINCT target_text) FILTER (WHERE target_text <> '') AS variants, count(*) AS copies, min(segment_id) AS first_segment FROM r GROUP BY 1, 2)"""


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.bilingual(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"), (F.col("conv_id") % 2).cast("string").alias("language"), "source_text", "target_text")
    return W.review_groups(rows)


@query(f"WITH {_REVIEW_SQL} SELECT * FROM g")
def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir)


@query(f"""WITH {_REVIEW_SQL}, m AS (SELECT source_hash, min_by(target_text, segment_id) AS memory_target FROM r WHERE segment_id % 2 = 0 GROUP BY 1) SELECT first_segment, copies, memory_target FROM g LEFT JOIN m USING (source_hash)""")
def review_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review groups with the best memory target; their glossary spans are counted in glossary_top8."""
    groups = _review(spark, sf_dir)
    turns = V.bilingual(spark, sf_dir).withColumn("entry_id", F.col("conv_id") * 1000 + F.col("turn")).where(F.col("entry_id") % 2 == 0)
    memory = turns.select(T.source_hash("source_text").alias("source_hash"), "entry_id", "target_text")
    terms = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0).alias("term")).where("term <> ''")
    spans = TM.glossary_matches(groups.select(F.col("first_segment").alias("text_id"), F.col("source_text").alias("text")), terms).withColumnRenamed("text_id", "first_segment")
    return W.with_references(groups, memory, spans).select("first_segment", "copies", "memory_target")


@query("""WITH n AS (SELECT user_id % 40 AS batch_id, max_by(event_id, ts) AS report_id FROM events GROUP BY 1) SELECT DISTINCT batch_id, unnest([report_id, report_id % 10]) AS segment_id FROM n""")
def latest_failed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = V.table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("batch_id"), F.col("event_id").alias("report_id"), F.col("ts").alias("created_at"), F.array("event_id", F.col("event_id") % 10).alias("failed"))
    return W.latest_failed(reports)


@query("""WITH i AS (SELECT o_custkey AS segment_id, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS verdict, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS reviewed_text FROM orders GROUP BY 1) SELECT c_custkey AS segment_id, c_name AS baseline, verdict, reviewed_text FROM customer LEFT JOIN i ON c_custkey = segment_id""")
def latest_review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("segment_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderpriority").alias("reviewed_text"))
    base = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment_id"), F.col("c_name").alias("baseline"))
    return W.latest_review(base, items)


@query(f"""WITH RECURSIVE {V.SEGMENTS_SQL}, s AS (SELECT file_id, seg_idx, length(source_text) AS size, row_number() OVER (PARTITION BY file_id ORDER BY seg_idx) AS n FROM segments),
g(file_id, seg_idx, n, items, total, batch) AS (SELECT file_id, seg_idx, n, 1, size, 0 FROM s WHERE n = 1 UNION ALL
SELECT s.file_id, s.seg_idx, s.n, CASE WHEN full_ THEN 1 ELSE items + 1 END, CASE WHEN full_ THEN size ELSE total + size END, CASE WHEN full_ THEN batch + 1 ELSE batch END
FROM (SELECT s.*, g.items, g.total, g.batch, g.items + 1 > 20 OR g.total + s.size > 900 AS full_ FROM g JOIN s ON s.file_id = g.file_id AND s.n = g.n + 1) s)
SELECT file_id, CAST(seg_idx AS BIGINT) AS seg_idx, CAST(batch AS BIGINT) AS batch FROM g""")
def packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every file in order, packed greedily by 20 rows and 900 characters."""
    rows = V.segments(spark, sf_dir).select("file_id", F.col("seg_idx").cast(LONG).alias("seg_idx"), F.length("source_text").cast(LONG).alias("size"))
    return W.greedy_batches(rows, ["file_id"], ["seg_idx"], "size", 20, 900).select("file_id", "seg_idx", "batch")


@query()
def task_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of every file by kind, paragraphs kept whole where they fit a batch."""
    rows = V.segments(spark, sf_dir).select("file_id", F.col("seg_idx").cast(LONG).alias("seg_idx"), F.lit("none").alias("status"), "source_text").withColumn("kind", W.task_type())
    sized = rows.select("file_id", "kind", F.floor(F.col("seg_idx") / 4).cast(LONG).alias("paragraph"), "seg_idx", F.length("source_text").cast(LONG).alias("size"))
    return W.greedy_batches(sized, ["file_id", "kind"], ["paragraph", "seg_idx"], "size", 20, 900, ["paragraph"]).drop("size")


@query(rf"""WITH s AS (SELECT item_id, text AS source, CASE item_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN replace(text, '.', '※') ELSE text END AS target, item_id % 3 AS k FROM benchmark),
p AS (SELECT item_id, CASE k WHEN 0 THEN '※ ' || source || ' ⟦MATH_1⟧' WHEN 1 THEN '<b>' || source || '</b>' || chr(10) ELSE '12.5' END AS source_text, CASE WHEN target = '' THEN '' WHEN k = 0 THEN '※ ' || target WHEN k = 1 THEN '<b>' || target || '</b>' ELSE '12.50' END AS target_text FROM s)
SELECT item_id, CASE WHEN {V.normalize_sql("target_text")} = '' THEN 'empty' WHEN source_text = '12.5' AND target_text <> '12.5' THEN 'numeric' WHEN len(regexp_extract_all(source_text, '※')) > 0 AND len(regexp_extract_all(source_text, '※')) <> len(regexp_extract_all(target_text, '※')) THEN 'symbols'
WHEN source_text LIKE '%⟦MATH_1⟧%' AND target_text NOT LIKE '%⟦MATH_1⟧%' THEN 'formulas' WHEN source_text LIKE '%<b>%' AND target_text NOT LIKE '%<b>%' THEN 'tags' WHEN contains(source_text, chr(10)) AND length(replace(source_text, chr(10), '')) - length(source_text) <> length(replace(target_text, chr(10), '')) - length(target_text) THEN 'lines' END AS fault FROM p""")
def output_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of made-up outputs: texts without symbols, formulas or line breaks that their sources have."""
    k, m, text = F.col("item_id") % 3, F.col("item_id") % 5, F.col("text")
    target = F.when(m == 0, "").when(m == 1, "x").when(m == 2, F.replace(text, F.lit("."), F.lit("※"))).otherwise(text)
    rows = V.table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.when(k == 0, F.concat(F.lit("※ "), text, F.lit(" ⟦MATH_1⟧"))).when(k == 1, F.concat(F.lit("<b>"), text, F.lit("</b>\n"))).otherwise("12.5").alias("source_text"),
        F.when(target == "", "").when(k == 0, F.concat(F.lit("※ "), target)).when(k == 1, F.concat(F.lit("<b>"), target, F.lit("</b>"))).otherwise("12.50").alias("target_text"),
    )
    return rows.select("item_id", W.output_fault().alias("fault"))


@query(r"""WITH r AS (SELECT conv_id AS sheet, turn + 1 AS "row", string_split(text, ' ') AS cells FROM conversations), s AS (SELECT sheet, "row", len(list_filter(cells, lambda c: trim(c) <> '')) + 3 * len(list_filter(cells, lambda c: regexp_matches(lower(trim(c)), '^th'))) + 2 * len(list_filter(cells, lambda c: regexp_matches(lower(trim(c)), '^an'))) AS score FROM r WHERE "row" <= 20)
SELECT sheet, CAST(min("row") AS BIGINT) AS "row", CAST(score AS BIGINT) AS score FROM s JOIN (SELECT sheet, max(score) AS score FROM s GROUP BY 1) USING (sheet, score) GROUP BY sheet, score""")
def header_row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sheet"), (F.col("turn") + 1).alias("row"), F.split("text", " ").alias("cells"))
    return W.header_rows(rows, "^th", "^an").select("sheet", F.col("row").cast(LONG).alias("row"), F.col("score").cast(LONG).alias("score"))


@query(r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{400}-\x{4FF}\x{600}-\x{6FF}]')) AS others, regexp_matches(text, '[\x{400}-\x{4FF}]') AS russian FROM documents WHERE text IS NOT NULL)
SELECT doc_id, latin + others < 3 OR others < 3 OR others <= latin AS in_script, latin + others < 3 OR russian AS in_russian FROM n""")
def target_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", W.expected_script(F.lit("en"), F.col("text")).alias("in_script"), W.expected_script(F.lit("ru-RU"), F.col("text")).alias("in_russian"))


@query(rf"""WITH a AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN substr(text, 3, 12) WHEN 1 THEN translate(substr(text, 3, 12), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE 'no such words' END AS anchor FROM documents), t AS (SELECT *, CASE WHEN anchor = '' THEN 0 ELSE (length(text) - length(replace(text, anchor, ''))) / length(anchor) END AS times FROM a)
SELECT doc_id, CASE WHEN times = 1 THEN 'unique' WHEN times > 1 THEN 'ambiguous' WHEN {V.normalize_sql("anchor")} <> '' AND contains(lower({V.normalize_sql("text")}), lower({V.normalize_sql("anchor")})) THEN 'normalized' ELSE 'unlocatable' END AS state, CASE WHEN times = 1 THEN CAST(strpos(text, anchor) - 1 AS BIGINT) END AS start FROM t""")
def anchor_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.substring("text", 3, 12)
    anchor = F.when(F.col("doc_id") % 3 == 0, part).when(F.col("doc_id") % 3 == 1, F.translate(part, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise("no such words")
    found = V.table(spark, sf_dir, "documents").select("doc_id", W.anchored(F.col("text"), anchor).alias("a"))
    return found.select("doc_id", "a.state", F.col("a.start").cast(LONG).alias("start"))


_IMPORT_SQL = f"""inc AS (SELECT item_id * 2 + n AS place, CASE n WHEN 0 THEN text ELSE ' ' || text END AS source_text, 'T' || CASE WHEN item_id % 3 = 0 THEN 0 ELSE item_id + n END AS target_text FROM benchmark, (VALUES (0), (1)) v(n)),
old AS (SELECT item_id AS entry_id, CASE WHEN item_id % 4 = 0 THEN text || ' x' ELSE ' ' || text END AS source_text, 'T' || CASE WHEN item_id % 3 = 0 THEN 0 ELSE -1 END AS target_text FROM benchmark WHERE item_id % 2 = 0),
last AS (SELECT max_by(struct_pack(place := place, source_text := source_text, target_text := target_text), place) AS r, sha256({V.normalize_sql("source_text")}) AS h FROM inc GROUP BY 2),
oh AS (SELECT *, sha256({V.normalize_sql("source_text")}) AS h FROM old)"""


@query(f"""WITH {_IMPORT_SQL}, m AS (SELECT l.r.place AS place, l.r.source_text AS source_text, l.r.target_text AS target_text, (SELECT min(entry_id) FROM oh WHERE oh.h = l.h) AS by_hash, (SELECT min(entry_id) FROM oh WHERE oh.source_text = l.r.source_text) AS by_text FROM last l)
SELECT m.place, coalesce(by_hash, by_text) AS entry_id, CASE WHEN coalesce(by_hash, by_text) IS NULL THEN 'created' WHEN o.source_text = m.source_text AND o.target_text = m.target_text THEN 'skipped' ELSE 'updated' END AS action FROM m LEFT JOIN old o ON o.entry_id = coalesce(by_hash, by_text)""")
def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import of every item twice against a table of half of them."""
    i, text = F.col("item_id"), F.col("text")
    items = V.table(spark, sf_dir, "benchmark")
    incoming = items.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select((i * 2 + F.col("n")).alias("place"), F.when(F.col("n") == 0, text).otherwise(F.concat(F.lit(" "), text)).alias("source_text"), F.concat(F.lit("T"), F.when(i % 3 == 0, 0).otherwise(i + F.col("n"))).alias("target_text"))
    existing = items.where(i % 2 == 0).select(i.alias("entry_id"), F.when(i % 4 == 0, F.concat(text, F.lit(" x"))).otherwise(F.concat(F.lit(" "), text)).alias("source_text"), F.concat(F.lit("T"), F.when(i % 3 == 0, 0).otherwise(-1)).alias("target_text"))
    return I.plan_import(incoming, existing).select("place", "entry_id", "action")


_SAVE_SQL = """n AS (SELECT lower(trim(p_name)) AS key, max_by(p_brand, p_partkey) AS target_text FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), o AS (SELECT lower(trim(p_name)) AS key, min_by(p_brand, p_partkey) AS target_text FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)"""


def _save(spark: SparkSession, sf_dir: str, overwrite: bool) -> tuple[DataFrame, DataFrame]:
    parts = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("source_text"), F.col("p_brand").alias("target_text"))
    return I.save_terms(parts.where("place % 2 = 0"), parts.where("place % 3 = 0"), overwrite)


@query(f"WITH {_SAVE_SQL} SELECT key, o.target_text, n.target_text AS new_target_text FROM o JOIN n USING (key) WHERE o.target_text <> n.target_text")
def term_save_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _save(spark, sf_dir, False)[0]


@query(f"WITH {_SAVE_SQL} SELECT key, coalesce(o.target_text, n.target_text) AS kept, coalesce(n.target_text, o.target_text) AS overwritten FROM o FULL JOIN n USING (key)")
def term_save_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, over = (_save(spark, sf_dir, v)[1].select("key", F.col("target_text").alias(c)) for v, c in ((False, "kept"), (True, "overwritten")))
    return kept.join(over, "key")


@query("SELECT c_nationkey AS profile_id, c_custkey AS entry_id, 'old' AS origin FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 2 = 0) UNION ALL SELECT c_nationkey, c_custkey, 'new' FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 2 = 0 AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 2 = 0) UNION ALL SELECT c_nationkey, c_custkey, 'old' FROM customer WHERE c_nationkey % 2 = 0 AND c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 2 = 0)")
def replaced_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("profile_id"), F.col("c_custkey").alias("entry_id"))
    new = rows.where("profile_id % 2 = 0 AND entry_id % 2 = 0").withColumn("origin", F.lit("new"))
    return I.replaced(rows.withColumn("origin", F.lit("old")), new)


@query("SELECT p_partkey, p_name AS source_text, 'en-GB' AS source_language, 'de-AT' AS target_language FROM part")
def copied_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("source_text"), F.lit("en-US").alias("source_language"), F.lit("de-DE").alias("target_language"))
    return I.copied(rows, "en-GB", "de-AT")


@query("SELECT min(p_partkey) AS place, min_by(p_name, p_partkey) AS term FROM part GROUP BY lower(trim(p_name)) ORDER BY 1 LIMIT 300")
def merged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 distinct terms: the limit is the operator's."""
    return I.merged_terms(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("term")))


@query(rf"WITH {V.SEGMENTS_SQL} SELECT file_id, CAST(seg_idx AS BIGINT) AS seg_idx, len(string_split_regex(source_text, '\s+')) <= 5 AND length(source_text) <= 50 AND NOT regexp_matches(source_text, '[.。!！?？;；]') AS is_term FROM segments")
def term_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(spark, sf_dir).select("file_id", F.col("seg_idx").cast(LONG).alias("seg_idx"), I.is_term("source_text").alias("is_term"))


@query(r"""WITH p AS (SELECT conv_id AS doc_id, turn AS place, CASE role WHEN 'assistant' THEN repeat('译', length(text)) || text ELSE text END AS text FROM conversations WHERE trim(text) <> ''), h AS (SELECT *, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) / greatest(length(text), 1) AS share FROM p),
n AS (SELECT *, lead(text) OVER w AS nxt, lead(share) OVER w AS next_share FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY place)) SELECT doc_id, place, trim(text) AS source_text, trim(nxt) AS target_text FROM n WHERE share < 0.1 AND next_share > 0.3""")
def alternating_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("role") == "assistant", F.concat(F.repeat(F.lit("译"), F.length("text")), "text")).otherwise(F.col("text"))
    rows = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("place"), text.alias("text"))
    return I.alternating_pairs(rows).select("doc_id", "place", "source_text", "target_text")


@query(f"SELECT item_id, {V.normalize_sql('text')} AS source_normalized, sha256({V.normalize_sql('text')}) AS source_hash, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT) AS source_words, 'b1' AS import_batch_id FROM benchmark")
def rebuilt_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived columns of all entries made anew in one pass, with the batch that they came by."""
    rows = V.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source_text"))
    return I.lineage(I.rebuilt(rows), "b1").select("item_id", "source_normalized", "source_hash", "source_words", "import_batch_id")


@query("WITH c AS (SELECT user_id % 30 AS base_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS sign FROM events) SELECT base_id, CAST(sum(sign) AS BIGINT) AS entries FROM c GROUP BY 1 HAVING sum(sign) <> 0")
def entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = V.table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("base_id"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("sign"))
    return I.entry_counts(changes, "base_id")


_NUMBERS = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?i:thousand|percent|million|hundred|trillion|billion|百|千|万|亿|%|％)?"
_VALUE = "list_transform(regexp_extract_all(@, '" + _NUMBERS + r"'), lambda x: round(CAST(replace(regexp_extract(x, '^[0-9,]+(?:\.[0-9]+)?'), ',', '') AS DOUBLE) * CASE lower(regexp_extract(x, '(?i)(thousand|percent|million|hundred|trillion|billion|百|千|万|亿|%|％)$', 1)) WHEN '百' THEN 1e2 WHEN '千' THEN 1e3 WHEN '万' THEN 1e4 WHEN '亿' THEN 1e8 WHEN 'hundred' THEN 1e2 WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'trillion' THEN 1e12 WHEN '%' THEN 1e-2 WHEN '％' THEN 1e-2 WHEN 'percent' THEN 1e-2 ELSE 1 END, 6))"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves with their numbers changed by id: one dropped, two swapped, a unit spelt out."""
    i, text = F.col("doc_id"), F.col("text")
    target = F.when(i % 5 == 0, F.concat(F.lit("7 "), text)).when(i % 5 == 1, F.regexp_replace(text, "[0-9]+", "")).when(i % 5 == 2, F.concat(text, F.lit(" 1,500 2%"))).when(i % 5 == 3, F.concat(F.lit("0.02 1.5 thousand "), text)).otherwise("")
    source = F.when(i % 5 == 2, F.concat(text, F.lit(" 1.5 thousand 2 percent"))).when(i % 5 == 3, F.concat(F.lit("1500 2% "), text)).otherwise(text)
    return V.table(spark, sf_dir, "documents").select("doc_id", source.alias("source_text"), target.alias("target_text"))


@query(rf"""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN text || ' 1.5 thousand 2 percent' WHEN 3 THEN '1500 2% ' || text ELSE text END AS s, CASE doc_id % 5 WHEN 0 THEN '7 ' || text WHEN 1 THEN regexp_replace(text, '[0-9]+', '', 'g') WHEN 2 THEN text || ' 1,500 2%' WHEN 3 THEN '0.02 1.5 thousand ' || text ELSE '' END AS t FROM documents),
v AS (SELECT doc_id, {_VALUE.replace("@", "s")} AS s, {_VALUE.replace("@", "t")} AS t FROM d WHERE trim(t) <> ''), e AS (SELECT doc_id, unnest(s) AS x, 1 AS a, 0 AS b FROM v UNION ALL SELECT doc_id, unnest(t), 0, 1 FROM v), b AS (SELECT doc_id, x, sum(a) - sum(b) AS more FROM e GROUP BY 1, 2),
n AS (SELECT doc_id, CAST(sum(CASE WHEN more > 0 THEN more ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN more < 0 THEN -more ELSE 0 END) AS BIGINT) AS extra FROM b GROUP BY 1)
SELECT v.doc_id, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, coalesce(missing, 0) = 0 AND coalesce(extra, 0) = 0 AND v.s <> v.t AS reordered FROM v LEFT JOIN n USING (doc_id) WHERE coalesce(missing, 0) > 0 OR coalesce(extra, 0) > 0 OR v.s <> v.t""")
def number_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = N.number_report(_numbered(spark, sf_dir))
    return got.select("doc_id", F.size("missing").cast(LONG).alias("missing"), F.size("extra").cast(LONG).alias("extra"), "reordered")


_LEXICON_SQL = "l AS (SELECT 'w' || (p_partkey % 97) AS source, 'w' || ((p_partkey * 89 + p_partkey % 97 // 50) % 397) AS target, p_brand AS tag, p_type AS origin FROM part)"


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return V.table(spark, sf_dir, "part").select(F.concat(F.lit("W"), k % 97).alias("source"), F.concat(F.lit("w"), (k * 89 + F.floor(k % 97 / 50)) % 397).alias("target"), F.col("p_brand").alias("tag"), F.col("p_type").alias("origin"))


@query(f"WITH {_LEXICON_SQL} SELECT source, target, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM l WHERE source <> target GROUP BY 1, 2")
def lexicon_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merged(_lexicon(spark, sf_dir)).select("source", "target", F.array_join("tags", ",").alias("tags"), F.array_join("origins", ",").alias("origins"))


_WORDS_SQL = "p AS (SELECT DISTINCT 'w' || (c_custkey % 211) AS source, 'w' || (c_custkey % 211 * 3 + 200 + CASE WHEN c_custkey % 211 < 60 THEN c_custkey % 2 ELSE 0 END) AS target FROM customer)"


@query(f"WITH {_WORDS_SQL}, u AS (SELECT source FROM p GROUP BY 1 HAVING count(DISTINCT target) = 1), e AS (SELECT p.* FROM p JOIN u USING (source)) SELECT source, target, source IN (SELECT source FROM u) AND source NOT IN (SELECT target FROM e) AS enabled FROM p")
def lexicon_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 211
    rows = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("w"), k).alias("source"), F.concat(F.lit("w"), k * 3 + 200 + F.when(k < 60, F.col("c_custkey") % 2).otherwise(0)).alias("target"))
    return L.enabled(rows)


@query()
def lexicon_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts with their commonest short words replaced."""
    pairs = spark.createDataFrame([("the", "ye"), ("and", "et"), ("that and", "eke")], "source string, target string")
    return L.converted(V.table(spark, sf_dir, "benchmark").select("item_id", "text"), pairs)


@query()
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents by the rules for dots, lines and headings."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences("text")).alias("place", "sentence"))
    return docs.select("doc_id", F.col("place").cast(LONG).alias("place"), "sentence")


@query()
def simple_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents by the simpler rules, with their places."""
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("unit"), "text")
    return simple_spans(docs).select(F.col("path").alias("doc_id"), F.col("sentence").cast(LONG).alias("sentence"), "source_text", "start", "end")
