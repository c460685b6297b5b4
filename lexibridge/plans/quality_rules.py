"""Quality queries: each rule over all bilingual segments, with the same rule in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.functions import text as T
from lexibridge.operators import quality_rules as Q
from lexibridge.plans import views as V
from lexibridge.plans.registry import QUERIES, SQL, query

_COUNT = r"len(regexp_extract_all({}, '[A-Za-z0-9]+|[一-鿿]'))"
_S, _T = _COUNT.format("source_text"), _COUNT.format("target_text")
_END = "CASE right(rtrim({}), 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.ENDINGS.items()) + " END"
_E, _F = _END.format("source_text"), _END.format("target_text")


def _all(pattern: str) -> str:
    """Number of matches in the target."""
    return f"len(regexp_extract_all(target_text, '{pattern}'))"


def _bag(pattern: str) -> str:
    """Number of tokens by which the bags of both sides differ."""
    p = pattern[1:-1].replace("'", "''")
    s, t = f"regexp_extract_all(source_text, '{p}')", f"regexp_extract_all(target_text, '{p}')"
    one = lambda a, b: f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: greatest(0, len(list_filter({a}, lambda y: y = x)) - len(list_filter({b}, lambda y: y = x))))), 0)"
    return f"{one(s, t)} + {one(t, s)}"


_LETTER = "regexp_extract({}, '[A-Za-z]')"
_A, _B = _LETTER.format("source_text"), _LETTER.format("target_text")

# Findings of each rule in a row, as a number.
RULES_SQL = {
    "target_without_tag": "CAST(regexp_matches(source_text, '<[a-zA-Z/][^>]*>') AND NOT regexp_matches(target_text, '<[a-zA-Z/][^>]*>') AS INTEGER)",
    "target_tag_missing": " + ".join(rf"CAST(len(regexp_extract_all(lower(source_text), '<{t}\b[^>]*>')) > len(regexp_extract_all(lower(target_text), '<{t}\b[^>]*>')) AS INTEGER)" for t in Q.FORMAT_TAGS),
    "ending_punctuation_mismatch": f"CAST({_E} IS NOT NULL AND {_E} IS DISTINCT FROM {_F} AS INTEGER)",
    "extra_space_after_punctuation": _all("[,;:!?.] {2,}|[，。；：！？、] +"),
    "missing_space_after_punctuation": _all("[,;:!?][A-Za-z]"),
    "space_before_punctuation": _all(" +[,;:!?.]"),
    "multiple_spaces": _all(" {2,}"),
    "trailing_space": "CAST(regexp_matches(target_text, '[ \\t\\x{A0}\\x{202F}]$') AS INTEGER)",
    "initial_case_mismatch": f"CAST({_A} <> '' AND {_B} <> '' AND ({_A} = upper({_A})) <> ({_B} = upper({_B})) AS INTEGER)",
    "source_target_identical": "CAST(trim(source_text) = trim(target_text) AND regexp_matches(target_text, '[A-Za-z]') AS INTEGER)",
    "word_count_exceeds": f"CAST({_S} > 0 AND {_T} > 0 AND {_T} > {_S} * 1.5 AS INTEGER)",
    "word_count_below": f"CAST({_S} > 0 AND {_T} > 0 AND {_T} < {_S} * 0.5 AS INTEGER)",
    "word_count_gap": f"CAST({_S} > 0 AND {_T} > 0 AND abs({_T} - {_S}) * 100 > {_S} * 50 AS INTEGER)",
    "multiple_upper_initials": "len(list_distinct(list_filter(regexp_extract_all(target_text, '[A-Za-z]+'), lambda x: regexp_matches(x, '^[A-Z][a-z]+[A-Z]') AND NOT list_contains(regexp_extract_all(source_text, '[A-Za-z]+'), x))))",
    "same_word_case_mismatch": "len(list_distinct(list_filter(regexp_extract_all(target_text, '[A-Za-z]+'), lambda x: list_contains(regexp_extract_all(lower(source_text), '[a-z]+'), lower(x)) AND NOT list_contains(regexp_extract_all(source_text, '[A-Za-z]+'), x))))",
    "number_mismatch": _bag(Q.NUMBER),
    "parameter_mismatch": _bag(Q.PARAMETER),
    "email_mismatch": _bag(Q.EMAIL),
    "link_mismatch": _bag(Q.LINK),
    "symbol_mismatch": _bag(Q.SYMBOL),
}


def _spots(pattern: str) -> str:
    """Places and lengths of all matches in the target, as text."""
    hits, free = f"regexp_extract_all(target_text, '{pattern}')", f"string_split_regex(target_text, '{pattern}')"
    return f"""array_to_string(list_transform(range(len({hits})), lambda i: CAST(list_sum(list_transform({free}[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform({hits}[1:i], lambda x: length(x))), 0) AS BIGINT) || ':' || length({hits}[i + 1])), ',')"""


def _words_spots(odd: str) -> str:
    """First places of words of the target that `odd` holds of x."""
    return rf"""array_to_string(list_transform(list_sort(list_distinct(list_filter(regexp_extract_all(target_text, '[A-Za-z]+'), lambda x: {odd}))), lambda x: (length(regexp_extract(target_text, '^(.*?[^A-Za-z])??' || x || '([^A-Za-z]|$)', 0, 's')) - length(x) - length(regexp_extract(target_text, '^(.*?[^A-Za-z])??' || x || '([^A-Za-z]|$)', 2, 's'))) || ':' || length(x)), ',')"""


_SPOTS_SQL = {
    "extra_space_after_punctuation": _spots("[,;:!?.] {2,}|[，。；：！？、] +"),
    "missing_space_after_punctuation": _spots("[,;:!?][A-Za-z]"),
    "space_before_punctuation": _spots(" +[,;:!?.]"),
    "multiple_spaces": _spots(" {2,}"),
    "multiple_upper_initials": _words_spots("regexp_matches(x, '^[A-Z][a-z]+[A-Z]') AND NOT list_contains(regexp_extract_all(source_text, '[A-Za-z]+'), x)"),
    "same_word_case_mismatch": _words_spots("list_contains(regexp_extract_all(lower(source_text), '[a-z]+'), lower(x)) AND NOT list_contains(regexp_extract_all(source_text, '[A-Za-z]+'), x)"),
    # RE2 has no back-references: the marks and their repetitions are written out.
    "repeated_punctuation": _spots("|".join(f"[{m}]{{2,}}" for m in ".,;:!?、，。；：！？")),
}
RULES_SQL["repeated_punctuation"] = _all("|".join(f"[{m}]{{2,}}" for m in ".,;:!?、，。；：！？"))


def _register(rule: str) -> None:
    """The rule over segments with faults: how often it finds something in each and, where SQL can say it, where."""
    spots = rule in _SPOTS_SQL

    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        all_ = Q.rules()[rule]
        places = [F.array_join(F.transform(all_, lambda x: F.concat_ws(":", x.offset.cast("string"), x.length.cast("string"))), ",").alias("places")] if spots else []
        return V.faulty(spark, sf_dir).select("conv_id", "turn", F.size(all_).cast("long").alias("issues"), *places).where("issues > 0")

    QUERIES[f"qa_{rule}"] = found
    if rule in RULES_SQL:
        places = f", {_SPOTS_SQL[rule]} AS places" if spots else ""
        SQL[f"qa_{rule}"] = f"WITH {V.FAULTY_SQL}, n AS (SELECT conv_id, turn, CAST({RULES_SQL[rule]} AS BIGINT) AS issues{places} FROM faulty) SELECT * FROM n WHERE issues > 0"


#: Rules that compare words with a back-reference have no form in the oracle's expressions.
for _rule in (*RULES_SQL, "consecutive_duplicate_words"):
    _register(_rule)


@query()
def qa_unpaired_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.issues(V.faulty(spark, sf_dir), ["unpaired_marks"])


@query()
def qa_tag_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbalanced format tags of whole pages."""
    pages = V.table(spark, sf_dir, "pages").select("page_id", F.lit("").alias("source_text"), F.col("html").alias("target_text"))
    return Q.issues(pages, ["unbalanced_tags"])


@query()
def qa_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one scan, counted by rule."""
    return Q.issues(V.bilingual(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("issues"), F.countDistinct("conv_id").alias("conversations"))


@query(f"""WITH {V.BILINGUAL_SQL}, n AS (SELECT lower({V.normalize_sql("source_text")}) AS source_key, trim(target_text) AS target_text FROM bilingual UNION ALL SELECT lower({V.normalize_sql("source_text")}), 'reply ' || conv_id % 5 || ' ' || turn % 2 FROM bilingual WHERE turn % 4 = 0)
SELECT source_key, count(DISTINCT target_text) AS targets, count(*) AS segments FROM n WHERE source_key <> '' AND target_text <> '' GROUP BY 1 HAVING count(DISTINCT target_text) > 1""")
def context_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal whole user turns, normalised, with different replies: every second of a conversation comes again with another one."""
    rows = V.bilingual(spark, sf_dir).select("conv_id", "turn", "source_text", "target_text")
    again = rows.where("turn % 4 = 0").withColumn("target_text", F.concat(F.lit("reply "), F.col("conv_id") % 5, F.lit(" "), F.col("turn") % 2))
    return Q.context_variants(rows.unionByName(again).withColumn("source_text", T.normalize_text("source_text")))


@query(f"""WITH {V.BILINGUAL_SQL}, n AS (SELECT lower({V.normalize_sql("source_text")}) AS source_key, trim(target_text) AS target_text FROM bilingual)
SELECT source_key, count(DISTINCT target_text) AS targets, count(*) AS segments FROM n WHERE source_key <> '' AND target_text <> '' GROUP BY 1 HAVING count(DISTINCT target_text) > 1""")
def context_inconsistency_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal whole user turns, normalised, with different replies."""
    return Q.context_variants(V.bilingual(spark, sf_dir).withColumn("source_text", T.normalize_text("source_text")))


@query(rf"""WITH {V.BILINGUAL_SQL}, b AS (SELECT conv_id, turn, '⟦MATH_1⟧ ' || source_text || ' ⟦LB_2⟧ ⟦LB_2⟧' AS s, CASE WHEN conv_id % 3 = 0 THEN '⟦LB_2⟧ ' WHEN conv_id % 3 = 1 THEN '⟦MATH_1⟧ ⟦LB_2⟧ ⟦LB_2⟧' ELSE '' END || target_text AS t FROM bilingual)
SELECT conv_id, turn, detail FROM (SELECT *, unnest(['LB_2', 'MATH_1']) AS detail FROM b) WHERE len(regexp_extract_all(t, '⟦' || detail || '⟧')) < len(regexp_extract_all(s, '⟦' || detail || '⟧'))""")
def qa_placeholder_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders put into segments and partly taken from their targets."""
    k = F.col("conv_id") % 3
    rows = V.bilingual(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit("⟦MATH_1⟧ "), "source_text", F.lit(" ⟦LB_2⟧ ⟦LB_2⟧")).alias("source_text"), F.concat(F.when(k == 0, "⟦LB_2⟧ ").when(k == 1, "⟦MATH_1⟧ ⟦LB_2⟧ ⟦LB_2⟧").otherwise(""), "target_text").alias("target_text"))
    return Q.issues(rows, ["target_placeholder_missing"]).select("conv_id", "turn", "detail")


@query(rf"""WITH {V.BILINGUAL_SQL}, b AS (SELECT conv_id, turn, replace(target_text, '.', CASE WHEN turn % 4 = 0 THEN ' ?' ELSE '?' END) AS t FROM bilingual WHERE conv_id % 2 = 0) SELECT conv_id, turn, CAST(len(regexp_extract_all(t, '[^\s\x{{A0}}\x{{202F}}«:;!?/][!?;:]')) AS BIGINT) AS findings FROM b WHERE regexp_matches(t, '[^\s\x{{A0}}\x{{202F}}«:;!?/][!?;:]')""")
def qa_french_leading_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High marks without the space that French asks for; other languages are not looked at."""
    rows = V.bilingual(spark, sf_dir).withColumn("target_language", F.when(F.col("conv_id") % 2 == 0, "fr-FR").otherwise("en")).withColumn("target_text", F.when(F.col("turn") % 4 == 0, F.replace("target_text", F.lit("."), F.lit(" ?"))).otherwise(F.replace("target_text", F.lit("."), F.lit("?"))))
    found = Q.issues(rows, ["punctuation_leading_missing_space"], french=True)
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("findings"))


@query(rf"""WITH {V.BILINGUAL_SQL}, b AS (SELECT conv_id, turn, lower(source_text) AS s, lower(target_text) AS t FROM bilingual), w AS (SELECT * FROM (VALUES (1, 'the', 'zzz'), (2, 'and', 'th'), (3, 'that and', 'th')) v(term_id, term, translation))
SELECT conv_id, turn, term_id FROM b JOIN w ON regexp_matches(s, '(^|[^a-z0-9])' || replace(term, ' ', '[^a-z0-9]+') || '([^a-z0-9]|$)') WHERE NOT contains(t, translation)""")
def qa_term_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(1, "the", "zzz"), (2, "and", "TH"), (3, "that and", "th")], "term_id int, term string, translation string")
    return Q.term_inconsistencies(V.bilingual(spark, sf_dir), terms, "conv_id", "turn")
