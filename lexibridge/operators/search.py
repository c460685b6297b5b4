"""Filters, search, sorting and pages of entry lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(columns: list[str], text: str, case_sensitive: bool = False) -> Column:
    """Whether any column is LIKE %text%: wildcards in the text keep their meaning."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.col(c).like(f"%{text}%") if case_sensitive else F.col(c).ilike(f"%{text}%"), F.lit(False))
    return found


def contains_literally(columns: list[str], text: str) -> Column:
    """Whether any column holds the text, its %, _ and backslashes taken as they are; case is ignored."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
    return found


def chosen(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns have these values; None asks nothing of a column, a list any of its values."""
    for c, v in values.items():
        if v is not None:
            rows = rows.where(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
    return rows


def hydrated(rows: DataFrame, names: DataFrame, by: dict[str, str], key: str = "id", name: str = "name") -> DataFrame:
    """`rows` with the display names of their references: by says which new column names which id column."""
    for new, column in by.items():
        rows = rows.join(names.select(F.col(key).alias(column), F.col(name).alias(new)), column, "left")
    return rows


def target_map(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_text, target_text) of the distinct non-empty texts that entries have, that of the greatest entry_id."""
    wanted = texts.where(F.coalesce("source_text", F.lit("")) != "").select("source_text").distinct()
    best = entries.groupBy("source_text").agg(F.max_by("target_text", "entry_id").alias("target_text"))
    return wanted.join(best, "source_text")


def ordering(sort: str, columns: dict[str, str], descending: bool, tie: str = "entry_id") -> list[Column]:
    """The chosen sort key, nulls last, with the id as tie-break in the same direction; an unknown key is an error."""
    c = columns[sort]
    return [F.desc_nulls_last(c), F.desc(tie)] if descending else [F.asc_nulls_last(c), F.asc(tie)]


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 200) -> tuple[DataFrame, int]:
    """One page in order and the number of all rows. Pages count from 1; sizes are held within 1..most."""
    size, number = min(max(size, 1), most), max(number, 1)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), rows.count()


def report_order() -> list[Column]:
    """Items of a report: by file, block, row (none first), cell and sentence."""
    return [F.asc("file_id"), F.asc("block"), F.coalesce("row", F.lit(-1)).asc(), F.coalesce("cell", F.lit(-1)).asc(), F.asc("sentence")]


def report_counts(items: DataFrame) -> DataFrame:
    """(file_id, category, items, segments) of report items (file_id, segment_id, category), with the totals of
    files and categories as rows of null, and `several`: segments that have more than one category."""
    per = items.groupBy("file_id", "segment_id", "category").agg(F.count("*").alias("n"))
    kinds = per.groupBy("file_id", "segment_id").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    cube = per.groupingSets([[F.col("file_id"), F.col("category")], [F.col("category")]], F.col("file_id"), F.col("category")).agg(F.sum("n").alias("items"), F.count("*").alias("segments")).withColumn("several", F.lit(None).cast("long"))
    files = kinds.groupingSets([[F.col("file_id")], []], F.col("file_id")).agg(F.sum("n").alias("items"), F.count("*").alias("segments"), F.count_if(F.col("kinds") > 1).alias("several")).withColumn("category", F.lit(None).cast("string"))
    return cube.select("file_id", "category", "items", "segments", "several").unionByName(files.select("file_id", "category", "items", "segments", "several"))


def ordered_distinct(c: Column | str) -> Column:
    """Distinct non-empty elements of an array in the order of their first places."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x.cast("string") != "")))


def merged_analyses(analyses: DataFrame, keys: list[str]) -> DataFrame:
    """One analysis of many (key, words, segments, collections): sums of the known keys, a row for each
    of them, and the collections of all in order of their first place."""
    known = analyses.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], "place int, key string")
    sums = analyses.groupBy("key").agg(F.sum("words").alias("words"), F.sum("segments").alias("segments"))
    return known.join(sums, "key", "left").select("place", "key", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("segments", F.lit(0)).alias("segments"))
