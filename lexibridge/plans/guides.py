"""Queries of marks, numbering and client files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.functions import guides as G
from lexibridge.functions import marks as M
from lexibridge.plans import views as V
from lexibridge.plans.registry import query

_QUOTED_SQL = """q AS (SELECT doc_id, replace(replace(text, ' t', ' "t'), ' a', ' “a') AS text FROM documents)"""
_HAN_SQL = r"len(regexp_extract_all({0}, '[\x{{4E00}}-\x{{9FFF}}]')) / greatest(length({0}), 1)"


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with straight and curly marks put in."""
    text = F.replace(F.replace("text", F.lit(" t"), F.lit(' "t')), F.lit(" a"), F.lit(" “a"))
    return V.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"""WITH {_QUOTED_SQL} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '“([^"＂“”]*)["＂]', '“\\1”', 'g'), '["＂]([^"＂“”]*)["＂]', '“\\1”', 'g'), '["＂]', '“', 'g'), '‘([^''＇‘’]*)[''＇]', '‘\\1’', 'g'), '[''＇]([^''＇‘’]*)[''＇]', '‘\\1’', 'g'), '[''＇]', '‘', 'g') AS text FROM q""")
def quotes_curly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quoted(spark, sf_dir).select("doc_id", M.quotes("text").alias("text"))


@query(f"""WITH {_QUOTED_SQL} SELECT doc_id, translate(text, '"“”''‘’', '＂＂＂＇＇＇') AS text FROM q""")
def quotes_straight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quoted(spark, sf_dir).select("doc_id", M.quotes("text", "straight", target_width="full").alias("text"))


@query(f"""WITH {V.BILINGUAL_SQL}, b AS (SELECT conv_id, turn, CAST(turn + 1 AS VARCHAR) AS n, source_text, target_text AS t FROM bilingual)
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 2 OR {V.normalize_sql("t")} = '' OR {V.normalize_sql("source_text")} = '' THEN CASE conv_id % 3 WHEN 0 THEN n || '. ' WHEN 1 THEN 'Chapter ' || n || ' ' ELSE '(' || n || ') ' END || t ELSE regexp_replace(t, '^\\s+', '') END AS text FROM b""")
def numbering_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that begin with a number, a chapter's name or a number that their source does not show."""
    n, k = (F.col("turn") + 1).cast("string"), F.col("conv_id") % 3
    rows = V.bilingual(spark, sf_dir)
    shown = F.concat(F.when(k == 0, F.concat(n, F.lit(". "))).when(k == 1, F.concat(F.lit("第"), n, F.lit("章 "))).otherwise(""), "source_text")
    target = F.concat(F.when(k == 0, F.concat(n, F.lit(". "))).when(k == 1, F.concat(F.lit("Chapter "), n, F.lit(" "))).otherwise(F.concat(F.lit("("), n, F.lit(") "))), "target_text")
    return rows.select("conv_id", "turn", M.without_numbering(target, F.col("source_text"), shown, F.lit(None).cast("string")).alias("text"))


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN text || ' Tone style AVOID' ELSE text END AS t, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'terminology' WHEN len(list_filter([{", ".join(f"'{w}'" for w in G.STYLE_WORDS)}], lambda w: contains(lower(t), w))) >= 3 THEN 'style_guide' WHEN doc_id % 4 = 2 AND {_HAN_SQL.format("text")} < 0.1 THEN 'translation_memory' ELSE 'unknown' END AS kind FROM d""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: with a term table, with style words, between lines of Han, and as they are."""
    docs, k, text = V.table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("doc_id") % 4, F.col("text")
    headers = F.when(k == 0, F.array(F.lit("Source term"), F.lit("Target term")))
    body = F.when(k == 1, F.concat(text, F.lit(" Tone style AVOID"))).otherwise(text)
    lines = F.when(k == 2, F.array(text, F.lit("译文译文"), text, F.lit("译文译文"))).otherwise(F.array(text))
    return docs.select("doc_id", G.file_kind(headers, F.lit(None).cast("double"), body, lines).alias("kind"))


@query(rf"""WITH {V.BILINGUAL_SQL}, b AS (SELECT conv_id, turn, source_text || CASE conv_id % 5 WHEN 1 THEN ' shall not be liable' WHEN 2 THEN ' at $ 1,200.50' WHEN 3 THEN ' do good to all' ELSE '' END AS s, target_text AS t FROM bilingual)
SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches(s || t, '(?i){"|".join(G.LEGAL)}') THEN 'legal' END, CASE WHEN regexp_matches(s || t, '{G.MONEY}') THEN 'number' END, CASE WHEN regexp_matches(s, '{G.LITERAL_ENGLISH}') THEN 'chinglish' END) AS categories FROM b""")
def risk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 5
    source = F.concat("source_text", F.when(k == 1, " shall not be liable").when(k == 2, " at $ 1,200.50").when(k == 3, " do good to all").otherwise(""))
    return V.bilingual(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(G.risks(source, F.col("target_text")), lambda r: r["category"]), ",").alias("categories"))


_NAME_SQL = "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_brand || ' ' || p_type || ' x' ELSE p_name END"


@query(rf"""WITH p AS (SELECT p_partkey, {_NAME_SQL} AS name FROM part) SELECT p_partkey, (regexp_matches(name, '[A-Z]') AND NOT regexp_matches(name, '[a-z]')) OR (regexp_matches(name, '[A-Z]') AND len(list_filter(regexp_extract_all(name, '[A-Za-z]+'), lambda w: NOT regexp_full_match(w, '[A-Z][a-z]*'))) = 0) OR (len(string_split_regex(trim(name), '\s+')) <= 2 AND regexp_matches(name, '^[A-Z]')) AS is_name FROM p""")
def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat_ws(" ", "p_brand", "p_type", F.lit("x"))).otherwise(F.col("p_name"))
    return V.table(spark, sf_dir, "part").select("p_partkey", G.is_name(name).alias("is_name"))


@query(f"""WITH {V.BILINGUAL_SQL} SELECT conv_id, turn FROM bilingual WHERE regexp_matches(lower(source_text || CASE WHEN conv_id % 4 = 0 THEN ' We HEREBY agree' ELSE '' END || target_text), '{"|".join(G.FIXED_PHRASES)}')""")
def fixed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat("source_text", F.when(F.col("conv_id") % 4 == 0, " We HEREBY agree").otherwise(""))
    return V.bilingual(spark, sf_dir).where(G.is_fixed(source, F.col("target_text"))).select("conv_id", "turn")


@query("""WITH c AS (SELECT source, count(*) FILTER (WHERE n_chars < 200) AS terms, count(*) FILTER (WHERE n_chars >= 200) AS pairs, bool_or(lang = 'de') AS a, bool_or(n_chars > 20000) AS b, bool_or(regexp_matches(text, '[0-9],[0-9]{3}')) AS f, bool_or(regexp_matches(text, '[A-Z]{3}')) AS g FROM documents GROUP BY 1)
SELECT source, least(1.0::DOUBLE, round(CASE WHEN terms >= 20 THEN 0.3 WHEN terms >= 10 THEN 0.2 WHEN terms >= 5 THEN 0.1 ELSE 0 END + CASE WHEN pairs >= 10 THEN 0.2 WHEN pairs >= 5 THEN 0.1 ELSE 0 END + CASE WHEN a THEN 0.2 ELSE 0 END + CASE WHEN b THEN 0.15 ELSE 0 END + CASE WHEN f THEN 0.1 ELSE 0 END + CASE WHEN g THEN 0.05 ELSE 0 END, 2)::DOUBLE) AS confidence FROM c""")
def profile_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.col("n_chars") < 200
    c = V.table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(short).alias("terms"), F.count_if(~short).alias("pairs"), F.bool_or(F.col("lang") == "de").alias("a"), F.bool_or(F.col("n_chars") > 20000).alias("b"), F.bool_or(F.col("text").rlike("[0-9],[0-9]{3}")).alias("f"), F.bool_or(F.col("text").rlike("[A-Z]{3}")).alias("g"))
    return c.select("source", G.profile_confidence(*map(F.col, ("terms", "pairs", "a", "b", "f", "g"))).alias("confidence"))
