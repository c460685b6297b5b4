"""Translation-memory queries: lookups, upserts, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.functions import similarity as S
from lexibridge.functions import text as T
from lexibridge.operators import memory as M
from lexibridge.operators import vectorindex as X
from lexibridge.plans import views as V
from lexibridge.plans.registry import also, query

_BEST_SQL = f"""best AS (SELECT source_hash, arg_min(entry_id, collection_id * 1000000000 + entry_id) AS entry_id, arg_min(target_text, collection_id * 1000000000 + entry_id) AS target_text
FROM (SELECT *, sha256({V.normalize_sql('source_text')}) AS source_hash FROM memory) GROUP BY source_hash)"""


@query(f"WITH {V.HASHED_SQL}, {V.MEMORY_SQL}, {_BEST_SQL} SELECT file_id, seg_idx, entry_id, target_text FROM hashed LEFT JOIN best USING (source_hash)")
def exact_tm_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exact_matches(V.hashed_segments(spark, sf_dir), V.memory_entries(spark, sf_dir)).select("file_id", F.col("seg_idx").cast("long").alias("seg_idx"), "entry_id", "target_text")


@query(f"WITH {V.HASHED_SQL}, {V.MEMORY_SQL} SELECT file_id, count(*) AS unmatched FROM hashed WHERE source_hash NOT IN (SELECT sha256({V.normalize_sql('source_text')}) FROM memory) GROUP BY file_id")
def exact_tm_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.memory_entries(spark, sf_dir).select(T.source_hash("source_text").alias("source_hash"))
    return V.hashed_segments(spark, sf_dir).join(known, "source_hash", "left_anti").groupBy("file_id").agg(F.count("*").alias("unmatched"))


@query(f"WITH {V.MEMORY_SQL} SELECT entry_id, collection_id FROM memory WHERE collection_id IN (0, 2)")
def tm_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.in_scope(V.memory_entries(spark, sf_dir), [0, 2]).select("entry_id", "collection_id")


@query(f"WITH {V.HASHED_SQL} SELECT file_id, seg_idx FROM hashed WHERE source_hash IN (SELECT source_hash FROM hashed GROUP BY source_hash HAVING count(DISTINCT file_id) > 1)")
def existing_key_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose hash occurs in several files."""
    rows = V.hashed_segments(spark, sf_dir)
    shared = rows.groupBy("source_hash").agg(F.countDistinct("file_id").alias("n")).where("n > 1")
    return rows.join(shared, "source_hash", "left_semi").select("file_id", F.col("seg_idx").cast("long").alias("seg_idx"))


def fuzzy_sql(queries: str, entries: str, recall: int = M.TRIGRAM_RECALL) -> str:
    """CTEs that give `ranked` (query_id, entry_id, similarity, rank) of queries (query_id, text) and entries (entry_id, source_text), both
    names of CTEs: all pairs that share a trigram, scored."""
    matched = lambda c: f"coalesce(nullif({V.match_sql(c)}, ''), {V.normalize_sql(c)})"
    grams = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(m), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
    allowed = f"regexp_matches({V.match_sql('text')}, '[\\pL\\pN]') AND NOT (length({V.core_sql('text')}) <= 4 AND regexp_matches({V.core_sql('text')}, '{T.NUMBERING}'))"
    return f"""asked AS (SELECT query_id, length(m) AS length, {grams} AS grams FROM (SELECT query_id, {matched("text")} AS m FROM {queries} WHERE {allowed})),
    held AS (SELECT entry_id, length(m) AS length, {grams} AS grams FROM (SELECT entry_id, {matched("source_text")} AS m FROM {entries})),
    shared AS (SELECT query_id, entry_id, count(*) AS n FROM (SELECT query_id, unnest(grams) AS gram FROM asked) JOIN (SELECT entry_id, unnest(grams) AS gram FROM held) USING (gram) GROUP BY 1, 2),
    scored AS (SELECT s.query_id, s.entry_id, s.n / (len(a.grams) + len(h.grams) - s.n) AS similarity FROM shared s JOIN asked a USING (query_id) JOIN held h USING (entry_id)
        WHERE h.length BETWEEN greatest(1, CAST(floor(a.length * 0.4) AS BIGINT) - 4) AND greatest(a.length + 12, CAST(floor(a.length * 2.2) AS BIGINT) + 12)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS rank FROM scored WHERE similarity >= 0.3 QUALIFY rank <= {recall})"""


@query(f"WITH {V.HASHED_SQL}, {V.MEMORY_SQL}, texts AS (SELECT source_hash AS query_id, min(source_text) AS text FROM hashed GROUP BY 1), {fuzzy_sql('texts', 'memory')} SELECT query_id, entry_id, similarity, CAST(rank AS INTEGER) AS rank FROM ranked")
def fuzzy_topk_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct segment text against the memory; checked against brute force in the tests."""
    return M.trigram_candidates(_texts(spark, sf_dir), V.memory_entries(spark, sf_dir))


@query()
def fuzzy_rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct segment text against the memory by the whole score, whatever the rank by trigrams; checked against brute force in the tests."""
    return M.fuzzy_matches(_texts(spark, sf_dir), V.memory_entries(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct segment texts by hash: repeated segments are looked up once. Normalised texts move, of which hashes are made after: a hash is longer than most."""
    texts = V.segments(spark, sf_dir).groupBy(T.normalize_text("source_text").alias("normalized")).agg(F.min("source_text").alias("text"))
    return texts.select(F.sha2("normalized", 256).alias("query_id"), "text")


@query("""WITH g AS (SELECT item_id, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS grams FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))), 6) AS similarity FROM g a JOIN g b ON a.item_id % 50 = 0 AND a.item_id <> b.item_id""")
def trigram_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set, every fiftieth item, against all items."""
    grams = V.table(spark, sf_dir, "benchmark").select("item_id", S.word_trigrams("text").alias("grams"))
    a, b = grams.where("item_id % 50 = 0").alias("a"), grams.alias("b")
    return a.join(b, F.col("a.item_id") != F.col("b.item_id")).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(S.jaccard(F.col("a.grams"), F.col("b.grams")), 6).alias("similarity"))


_VECTOR_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, x.vec_id AS entry_id, list_cosine_similarity(q.e, x.e) AS score FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s WHERE score >= {floor}) SELECT query_id, entry_id, round(score, 6) AS score, rank FROM r WHERE rank <= 6"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = V.table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"))


@query(_VECTOR_SQL.format(floor=0.45))
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = _vectors(spark, sf_dir)
    return M.vector_matches(q, e).select("query_id", "entry_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_VECTOR_SQL.format(floor=0.2))
def vector_floor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = _vectors(spark, sf_dir)
    return M.vector_matches(q, e, floor=0.2).select("query_id", "entry_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_VECTOR_SQL.format(floor=0.45))
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index of cells, of which only those are looked into that may hold a result."""
    q, e = _vectors(spark, sf_dir)
    return X.nearest(q, X.build(e)).select("query_id", "entry_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {V.MEMORY_SQL}, w AS (SELECT entry_id, list_distinct(list_filter(regexp_split_to_array(lower(source_text), '[^\\pL\\pN]+'), lambda x: x <> '')) AS words FROM memory),
q AS (SELECT DISTINCT conv_id * 1000 + turn AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '')) AS word FROM conversations),
s AS (SELECT query_id, entry_id, count(*) / any_value(len(words)) AS score FROM q JOIN (SELECT entry_id, words, unnest(words) AS word FROM w) e USING (word) GROUP BY query_id, entry_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s WHERE score >= 0.2) SELECT query_id, entry_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def lexical_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return M.word_overlap(turns, V.memory_entries(spark, sf_dir)).select("query_id", "entry_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.memory_entries(spark, sf_dir).select("entry_id", S.hashed_embedding("source_text").alias("embedding"))


_KEYED = f"sha256({V.normalize_sql('text')})"


@query(f"""WITH k AS (SELECT doc_id, source, {_KEYED} AS key, lang AS target, n_chars FROM documents), v AS (SELECT *, count(*) OVER (PARTITION BY key, target) AS votes FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY votes DESC, n_chars DESC, doc_id) AS place FROM v) SELECT key, doc_id, target, votes FROM r WHERE place = 1""")
def dedupe_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.majority_vote(_keyed(spark, sf_dir), "key", "target", "n_chars", "doc_id").select("key", "doc_id", "target", "votes")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed by the hash of the whole normalised text."""
    return V.table(spark, sf_dir, "documents").select("doc_id", "source", T.source_hash("text").alias("key"), F.col("lang").alias("target"), "n_chars")


@query(f"""WITH g AS (SELECT {_KEYED} AS key, count(*) AS n, count(DISTINCT lang) AS targets FROM documents GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN key IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_keys, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_to_delete, count(*) FILTER (WHERE n > 1 AND targets > 1) AS conflicts FROM g""")
def duplicate_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _keyed(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"))
    several = F.col("n") > 1
    return groups.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("null_keys"), F.count_if(several).alias("duplicate_groups"), F.coalesce(F.sum(F.when(several, F.col("n") - 1)), F.lit(0)).alias("rows_to_delete"), F.count_if(several & (F.col("targets") > 1)).alias("conflicts"))


def _merge_sql(order: str, first: str, action: str) -> str:
    return f"""WITH inc AS (SELECT key, arg_{order}(target, doc_id) AS target FROM (SELECT doc_id, {_KEYED} AS key, lang AS target FROM documents WHERE doc_id % 2 = 1) GROUP BY key),
    old AS (SELECT {_KEYED} AS key, min(lang) AS target FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
    SELECT coalesce(old.key, inc.key) AS key, coalesce({first}) AS target, CASE WHEN old.key IS NULL THEN 'created' WHEN {action} THEN 'unchanged' ELSE 'updated' END AS action FROM old FULL JOIN inc ON old.key = inc.key"""


def _merged(spark: SparkSession, sf_dir: str, keep: bool) -> DataFrame:
    """Even documents are the table, odd ones come in."""
    rows = _keyed(spark, sf_dir)
    old = rows.where("doc_id % 2 = 0").groupBy("key").agg(F.min("target").alias("target"))
    return M.upsert(old, rows.where("doc_id % 2 = 1").select("key", "target", "doc_id"), ["key"], "doc_id", keep)


@query(_merge_sql("max", "inc.target, old.target", "inc.key IS NULL"))
def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, False)


@query(_merge_sql("min", "old.target, inc.target", "true"))
def upsert_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, True)


@query(f"""SELECT key, arg_max(target, rank * 1000000000000 + doc_id) AS target, count(*) AS entries, count(DISTINCT rank) AS bases FROM (SELECT doc_id, {_KEYED} AS key, lang AS target, CAST(substr(source, 4) AS BIGINT) AS rank FROM documents) GROUP BY key""")
def merge_bases_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered union of bases (sources by number), where the later entry of a key wins."""
    rows = _keyed(spark, sf_dir).withColumn("rank", F.substring("source", 4, 9).cast("long"))
    return rows.groupBy("key").agg(F.max_by("target", F.struct("rank", "doc_id")).alias("target"), F.count("*").alias("entries"), F.countDistinct("rank").alias("bases"))


for _name in ("dedupe_majority_vote", "duplicate_group_stats", "upsert_overwrite", "upsert_keep", "merge_bases_last_wins"):
    also(f"{_name}_whole", _name)


@query(f"WITH {V.MEMORY_SQL} SELECT collection_id, CAST(CASE WHEN length(source_text) >= 321 THEN 321 WHEN length(source_text) >= 161 THEN 161 WHEN length(source_text) >= 81 THEN 81 WHEN length(source_text) >= 41 THEN 41 WHEN length(source_text) >= 17 THEN 17 ELSE 0 END AS BIGINT) AS bucket, count(*) AS entries FROM memory GROUP BY 1, 2")
def search_projection_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.memory_entries(spark, sf_dir).groupBy("collection_id", M.length_bucket(F.length("source_text")).cast("long").alias("bucket")).agg(F.count("*").alias("entries"))


@query()
def tm_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.signature(V.memory_entries(spark, sf_dir), "collection_id", "entry_id", "source_text", "target_text")
