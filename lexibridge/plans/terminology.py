"""Terminology queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.operators import terms as T
from lexibridge.plans import views as V
from lexibridge.plans.registry import query

# Terms: the first two words of every benchmark item, and the capital runs of documents.
_TERMS_SQL = "terms AS (SELECT item_id AS term_id, regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+') AS term FROM benchmark)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0).alias("term")).where("term <> ''")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


@query(rf"""WITH {_TERMS_SQL}, w AS (SELECT doc_id AS text_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents),
p AS (SELECT text_id, words[i] || ' ' || words[i + 1] AS pair FROM (SELECT *, unnest(generate_series(1, len(words) - 1)) AS i FROM w))
SELECT text_id, term_id, count(*) AS hits FROM p JOIN terms ON lower(term) = pair WHERE term <> '' GROUP BY 1, 2""")
def term_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.term_matches(_texts(spark, sf_dir), _terms(spark, sf_dir))


@query(r"""SELECT doc_id AS text_id, count(*) AS hits, 1::BIGINT AS term_id FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS word FROM documents) WHERE word = 'THE' GROUP BY 1""")
def term_acronym_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An all-capital term meets capitals only."""
    one = spark.range(1).select((F.col("id") + 1).alias("term_id"), F.lit("THE").alias("term"))
    return T.term_matches(_texts(spark, sf_dir), one)


@query()
def glossary_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.glossary_matches(_texts(spark, sf_dir), _terms(spark, sf_dir))


@query(rf"""WITH {V.BILINGUAL_SQL}, rows AS (SELECT source_text, target_text FROM bilingual UNION ALL SELECT source_text, 'reply ' || conv_id % 5 FROM bilingual UNION ALL SELECT 'term ' || conv_id % 40, 'T' || turn % 3 FROM bilingual)
SELECT lower(trim(source_text)) AS source_key, count(DISTINCT target_text) AS targets, count(*) AS entries FROM rows WHERE len(string_split_regex(trim(source_text), '\s+')) <= 5 GROUP BY 1 HAVING count(DISTINCT target_text) > 1""")
def term_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole user turns as sources and the replies as targets, each with a second reply, and terms that conversations share."""
    rows = V.bilingual(spark, sf_dir).select("conv_id", "turn", "source_text", "target_text")
    again = rows.withColumn("target_text", F.concat(F.lit("reply "), F.col("conv_id") % 5))
    shared = rows.withColumns({"source_text": F.concat(F.lit("term "), F.col("conv_id") % 40), "target_text": F.concat(F.lit("T"), F.col("turn") % 3)})
    return T.conflicts(rows.unionByName(again).unionByName(shared))


@query(rf"""WITH {V.BILINGUAL_SQL} SELECT lower(trim(source_text)) AS source_key, count(DISTINCT target_text) AS targets, count(*) AS entries FROM bilingual WHERE len(string_split_regex(trim(source_text), '\s+')) <= 5 GROUP BY 1 HAVING count(DISTINCT target_text) > 1""")
def term_conflicts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole user turns as sources and the replies as targets."""
    return T.conflicts(V.bilingual(spark, sf_dir))


@query(r"""SELECT abbr, count(*) AS n, count(DISTINCT text_id) AS texts FROM (SELECT doc_id AS text_id, unnest(list_filter(regexp_split_to_array(text, '[^\pL\pN_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,6}'))) AS abbr FROM documents) WHERE abbr NOT IN ('THE', 'AND', 'FOR', 'ARE', 'BUT', 'NOT', 'YOU', 'ALL') GROUP BY 1""")
def abbreviation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.abbreviations(_texts(spark, sf_dir))


@query(r"""SELECT source, count(*) AS texts, count(*) FILTER (WHERE regexp_matches(text, '[0-9],[0-9]{3}')) AS comma_thousands, count(*) FILTER (WHERE regexp_matches(text, '[0-9]\.[0-9]')) AS decimal_point, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS iso_date,
count(*) FILTER (WHERE regexp_matches(text, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}')) AS slash_date, count(*) FILTER (WHERE regexp_matches(text, '\$ ?[0-9]')) AS dollar, count(*) FILTER (WHERE regexp_matches(text, '€ ?[0-9]|[0-9] ?€')) AS euro FROM documents GROUP BY source""")
def format_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.format_profile(V.table(spark, sf_dir, "documents").select("source", "text"), "source")
