"""Term matching and mining."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Glossary entries that a text gets at most.
GLOSSARY_RESULTS = 8


def is_acronym(term: Column) -> Column:
    """Only upper-case letters among its ASCII letters, and at least one: matched by case."""
    return term.rlike("[A-Z]") & ~term.rlike("[a-z]")


#: Terms up to which they are sent to every task.
BROADCAST_TERMS = 1_000_000


def term_matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Texts (text_id, text) that hold a term (term_id, term) between word boundaries: text_id, term_id, hits.

    Texts are cut into words once, and into runs of as many words as some term has; a run meets the terms that are
    equal to it in an equi-join, so no text meets a term by a frequent first word. Case is ignored but for acronyms.
    """
    split = lambda c: F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda w: w != "")
    wanted = terms.select("term_id", split("term").alias("parts"), is_acronym(F.col("term")).alias("exact")).where(F.size("parts") > 0)
    wanted = wanted.select("term_id", "exact", F.array_join("parts", " ").alias("term"), F.size("parts").alias("n"))
    lengths = sorted(r[0] for r in wanted.select("n").distinct().collect())  # the lengths of terms in words
    keyed = wanted.withColumn("key", F.lower("term")).drop("n")
    keyed = F.broadcast(keyed) if wanted.count() <= BROADCAST_TERMS else keyed
    words = texts.select("text_id", split("text").alias("words"))

    def runs(n: int) -> Column:
        at = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.col("words") if n == 1 else F.transform(at, lambda i: F.array_join(F.slice("words", i, n), " "))

    found = None
    for n in lengths:
        own = words.select("text_id", F.explode(runs(n)).alias("run")).withColumn("key", F.lower("run"))
        hits = own.join(keyed, "key").where(~F.col("exact") | (F.col("run") == F.col("term"))).select("text_id", "term_id")
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        found = texts.join(terms.select("term_id"), F.lit(False)).select("text_id", "term_id")
    return found.groupBy("text_id", "term_id").agg(F.count("*").alias("hits"))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("term", T.StringType())]))


@F.pandas_udf(_SPANS)
def longest_spans(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """Spans of a text's candidate terms that do not overlap: longer terms first, then from the left."""

    def choose(text: str, wanted: list[str]) -> list[dict]:
        low, taken = text.lower(), []
        word = lambda c: c.isascii() and c.isalnum()
        for term in sorted(dict.fromkeys(wanted), key=lambda t: (-len(t), t)):
            at = low.find(term.lower())
            while term and at >= 0:
                end = at + len(term)
                edges = not (at and word(text[at - 1]) and word(term[0])) and not (end < len(text) and word(text[end]) and word(term[-1]))
                if edges and all(end <= s["start"] or at >= s["stop"] for s in taken):
                    taken.append({"start": at, "stop": end, "term": term})
                    at = low.find(term.lower(), end)
                else:
                    at = low.find(term.lower(), at + 1)
        return sorted(taken, key=lambda s: s["start"])

    return pd.Series([choose(t or "", list(w) if w is not None else []) for t, w in zip(texts, terms, strict=True)], dtype="object")


def glossary_matches(texts: DataFrame, terms: DataFrame, results: int = GLOSSARY_RESULTS) -> DataFrame:
    """text_id, spans: the non-overlapping terms of every text that has any, longest first, at most `results`.

    Candidate terms come from the equi-join; only they reach the fold, with their text once.
    """
    found = term_matches(texts, terms).join(terms, "term_id").groupBy("text_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    spans = texts.join(found, "text_id").select("text_id", longest_spans("text", "terms").alias("spans"))
    ranked = F.array_sort("spans", lambda a, b: (F.length(b["term"]) - F.length(a["term"])) * 1_000_000 + a["start"] - b["start"])
    return spans.select("text_id", F.slice(ranked, 1, results).alias("spans"))


def conflicts(entries: DataFrame, words: int = 5) -> DataFrame:
    """Short sources with several targets: source_key, targets, entries."""
    short = F.size(F.split(F.trim("source_text"), r"\s+")) <= words
    return entries.where(short).groupBy(F.lower(F.trim("source_text")).alias("source_key")).agg(F.countDistinct("target_text").alias("targets"), F.count("*").alias("entries")).where("targets > 1")


STOP = ["THE", "AND", "FOR", "ARE", "BUT", "NOT", "YOU", "ALL"]


def abbreviations(texts: DataFrame) -> DataFrame:
    """Standalone runs of two to six capitals but for common words: abbr, n, texts."""
    found = texts.select("text_id", F.explode(F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z]{2,6}$"))).alias("abbr"))
    return found.where(~F.col("abbr").isin(STOP)).groupBy("abbr").agg(F.count("*").alias("n"), F.countDistinct("text_id").alias("texts"))


def format_profile(texts: DataFrame, *keys: str) -> DataFrame:
    """How texts write numbers, dates and currency: counts of texts by style."""
    styles = {"comma_thousands": r"[0-9],[0-9]{3}", "decimal_point": r"[0-9]\.[0-9]", "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "slash_date": r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", "dollar": r"\$ ?[0-9]", "euro": r"€ ?[0-9]|[0-9] ?€"}
    return texts.groupBy(*keys).agg(F.count("*").alias("texts"), *[F.count_if(F.col("text").rlike(p)).alias(n) for n, p in styles.items()])
