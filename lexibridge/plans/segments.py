"""Queries on segments: normalisation, hashing, counting, language, document order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexibridge.functions import languages as G
from lexibridge.functions import text as T
from lexibridge.plans import views as V
from lexibridge.plans.registry import query
from lexibridge.sources.documents import html_blocks


@query(f"WITH {V.SEGMENTS_SQL} SELECT file_id, seg_idx, {V.normalize_sql('source_text')} AS normalized, {V.match_sql('source_text')} AS match_text FROM segments")
def normalized_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(spark, sf_dir).select("file_id", F.col("seg_idx").cast("long").alias("seg_idx"), T.normalize_text("source_text").alias("normalized"), T.match_text("source_text").alias("match_text"))


@query(f"WITH {V.HASHED_SQL} SELECT source_hash, count(*) AS n, count(DISTINCT file_id) AS n_files FROM hashed GROUP BY source_hash")
def segment_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hashed_segments(spark, sf_dir).groupBy("source_hash").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


@query(rf"""WITH {V.SEGMENTS_SQL}, c AS (SELECT file_id, seg_idx, {V.core_sql('source_text')} AS core, {V.match_sql('source_text')} AS m FROM segments)
SELECT file_id, seg_idx, core, length(core) <= 4 AND regexp_matches(core, '^(?:[0-9]+[A-Za-z]?|[A-Za-z]|[ivxlcdmIVXLCDM]{{1,4}})$') AS structural, regexp_matches(m, '[\pL\pN]') AS searchable FROM c""")
def match_text_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(spark, sf_dir).select("file_id", F.col("seg_idx").cast("long").alias("seg_idx"), T.compact_core("source_text").alias("core"), T.is_structural_fragment("source_text").alias("structural"), T.has_searchable_content("source_text").alias("searchable"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}]')) AS words FROM documents")
def source_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", T.source_words("text").alias("words"))


@query(r"""SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '\s', '', 'g')) AS chars_no_space,
len(regexp_extract_all(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}]')) AS asian_chars,
len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[.,:/_-][A-Za-z0-9]+)*%?|\pL+(?:[-'']\pL+)*')) AS non_asian_words FROM documents""")
def char_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = r"[A-Za-z0-9]+(?:[.,:/_-][A-Za-z0-9]+)*%?|\p{L}+(?:[-']\p{L}+)*"
    return V.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length("text").cast("long").alias("chars"),
        F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("chars_no_space"),
        F.regexp_count("text", F.lit(T.EAST_ASIAN)).cast("long").alias("asian_chars"),
        F.regexp_count("text", F.lit(words)).cast("long").alias("non_asian_words"),
    )


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines,
len(list_filter(string_split_regex(text, '\n\s*\n'), lambda x: trim(x) <> '')) AS blocks FROM documents""")
def line_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = lambda parts: F.size(F.filter(parts, lambda x: F.trim(x) != "")).cast("long")
    return V.table(spark, sf_dir, "documents").select("doc_id", full(F.split("text", "\n")).alias("lines"), full(F.split("text", r"\n\s*\n")).alias("blocks"))


@query(r"""SELECT doc_id, CASE WHEN letters = 0 THEN NULL WHEN kana >= 3 THEN 'ja-JP' WHEN hangul >= 3 THEN 'ko-KR' WHEN cyr >= 3 THEN 'ru-RU' WHEN arab >= 3 THEN 'ar-SA' WHEN thai >= 3 THEN 'th-TH'
WHEN han >= 4 AND han / letters >= 0.18 THEN 'zh-CN' END AS script_language, letters FROM (SELECT doc_id, len(regexp_extract_all(text, '\pL')) AS letters,
len(regexp_extract_all(text, '[\x{3040}-\x{30FF}]')) AS kana, len(regexp_extract_all(text, '[\x{AC00}-\x{D7AF}]')) AS hangul, len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')) AS cyr,
len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) AS arab, len(regexp_extract_all(text, '[\x{0E00}-\x{0E7F}]')) AS thai, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) AS han FROM documents)""")
def language_detect_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").withColumn("found", T.script_language("text"))
    return docs.select("doc_id", F.col("found.language").alias("script_language"), F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("letters"))


def _latin_sql() -> str:
    column = lambda k: "s_" + k.replace("-", "_").lower()
    hits = lambda ws: f"len(list_filter(t, lambda x: list_contains([{', '.join(map(repr, ws))}], x)))"
    scores = ", ".join(hits(ws) + (f" + CASE WHEN regexp_matches(low, '[{G.LETTERS[k]}]') THEN {G.HINT} ELSE 0 END" if k in G.LETTERS else "") + f" AS {column(k)}" for k, ws in G.STOPWORDS.items())
    first = " ".join(f"WHEN {column(k)} = best THEN '{k}'" for k in G.STOPWORDS)
    return rf"""SELECT doc_id, n_tokens, CASE WHEN n_tokens < 4 THEN NULL WHEN best <= 0 AND n_tokens >= 8 AND letters > 0 AND plain >= letters * {G.BASIC} THEN 'en-US' WHEN best <= 0 THEN NULL WHEN best < 2 AND n_tokens > 12 THEN NULL
    {first} END AS latin_language, best AS best_score FROM (
    SELECT *, greatest({', '.join(map(column, G.STOPWORDS))}) AS best FROM (SELECT doc_id, letters, plain, len(t) AS n_tokens, {scores} FROM (
    SELECT doc_id, lower(text) AS low, len(regexp_extract_all(text, '\pL')) AS letters, len(regexp_extract_all(text, '[A-Za-z]')) AS plain, list_transform(list_slice(regexp_extract_all(text, '{G.TOKEN}'), 1, {G.TOKENS}), lambda x: lower(x)) AS t FROM documents)))"""


@query(_latin_sql())
def language_detect_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent-word hits among the first 300 tokens, three more for a telling letter; ties by the listed order."""
    found = V.table(spark, sf_dir, "documents").select("doc_id", G.latin_language("text").alias("l"))
    return found.select("doc_id", F.col("l.tokens").cast("long").alias("n_tokens"), F.col("l.language").alias("latin_language"), F.col("l.score").cast("long").alias("best_score"))


@query(f"WITH {V.SEGMENTS_SQL} SELECT file_id, seg_idx, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN seg_idx % 3 = 0 THEN NULL ELSE seg_idx % 3 END NULLS FIRST, seg_idx) - 1 AS display_index FROM segments")
def display_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place in document order: a composite key whose missing parts come first."""
    row = F.when(F.col("seg_idx") % 3 != 0, F.col("seg_idx") % 3)
    order = Window.partitionBy("file_id").orderBy(F.asc_nulls_first("row"), "seg_idx")
    return V.segments(spark, sf_dir).withColumn("row", row).select("file_id", F.col("seg_idx").cast("long").alias("seg_idx"), (F.row_number().over(order) - 1).cast("long").alias("display_index"))


@query(f"""WITH {V.SEGMENTS_SQL}, n AS (SELECT file_id, seg_idx, row_number() OVER w AS seq, left(coalesce(lag(source_text) OVER w, ''), 200) AS previous_text, left(coalesce(lead(source_text) OVER w, ''), 200) AS next_text
FROM segments WINDOW w AS (PARTITION BY file_id ORDER BY seg_idx)) SELECT * FROM n""")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy("seg_idx")
    near = lambda f: F.left(F.coalesce(f("source_text").over(w), F.lit("")), F.lit(200))
    return V.segments(spark, sf_dir).select("file_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.row_number().over(w).cast("long").alias("seq"), near(F.lag).alias("previous_text"), near(F.lead).alias("next_text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS lines_text FROM documents")
def normalized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", T.normalize_lines("text").alias("lines_text"))


@query()
def html_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of every page with the tags above them."""
    pages = V.table(spark, sf_dir, "pages").select("page_id", F.posexplode(html_blocks("html")).alias("unit", "u"))
    return pages.select("page_id", "unit", F.col("u.key").alias("key"), F.col("u.text").alias("text"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, place, trim(regexp_replace(piece, '[\s\x{A0}\x{3000}]+', ' ', 'g')) AS piece FROM l),
b AS (SELECT *, coalesce(sum(CASE WHEN piece <> '' THEN length(piece) + 1 END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
s AS (SELECT doc_id, coalesce(string_agg(substr(piece, 1, CAST(6000 - before AS BIGINT)), ' ' ORDER BY place) FILTER (piece <> ''), '') AS sample FROM b WHERE before < 6000 GROUP BY doc_id)
SELECT doc_id, length(sample) AS sample_length, sha256(sample) AS sample_sha256 FROM s""")
def language_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that the languages of documents, given line by line, are told from."""
    lines = V.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "piece"))
    return G.language_samples(lines, "doc_id", "place", "piece").select("doc_id", F.length("sample").cast("long").alias("sample_length"), F.sha2("sample", 256).alias("sample_sha256"))
